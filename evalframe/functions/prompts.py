"""Prompt templates and request rendering as column expressions.

Templates use ``%s`` slots and are filled with ``format_string`` (JVM-side),
so rendering runs inside the scan's codegen stage, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Request texts and generation settings must equal the
# published evaluation batches word for word (do not edit).
# ---------------------------------------------------------------------------
MAX_TOKENS = 3
TEMPERATURE = 0.7
TOP_P = 0.9
MODEL_PLACEHOLDER = "<|MODEL|>"
SYSTEM_MESSAGE = "You are a chatbot."
RATER_MODEL = "gpt-4o"

MC_HEADER = "The following are multiple choice questions (with answers) about %s.\n\n"
MC_SHOT = "Question %s: %s\nA. %s\nB. %s\nC. %s\nD. %s\nAnswer: %s\n\n"
MC_QUESTION = ("Now, given the following question and answer choices, output only the letter corresponding to the "
               "correct answer. Do not add any explanation.\n\nQuestion: %s\nA. %s\nB. %s\nC. %s\nD. %s\nAnswer:\n")

CLOZE_HEADER = ("The following are sentences that are missing a word or a few words (denoted with an underscore), "
                "each followed by two options to fill in the missing word or words. The correct option is given for "
                "each sentence:\n\n")
CLOZE_SHOT = "Sentence %s: %s\nOption1: %s\nOption2: %s\nCorrect Option: %s\n\n"
CLOZE_QUESTION = ("Now, given the following sentence and options, output only the number corresponding to the correct "
                  "option. Do not add any explanation.\n\nSentence: %s\nOption1: %s\nOption2: %s\nCorrect Option:\n")

PASSAGE_PROMPT = ("Given the following passage, query, and answer choices, output only the letter corresponding to the "
                  "correct answer. Do not add any explanation.\n###\nPassage:\n%s\n###\nQuery:\n%s\n###\nChoices:\n"
                  "(A) %s\n(B) %s\n(C) %s\n(D) %s\n###\nAnswer:")

FT_MC_PROMPT = ("Given the following question and answer choices, output only the letter corresponding to the correct "
                "answer. Do not add any explanation.\n\nQuestion: %s\nA. %s\nB. %s\nC. %s\nD. %s\nAnswer:\n")
FT_CLOZE_PROMPT = ("Given the following sentence that is missing a word or a few words (denoted with an underscore) "
                   "and two options to fill in the missing word or words, output only the number corresponding to the "
                   "correct option. Do not add any explanation.\n\nSentence: %s\nOption1: %s\nOption2: %s\n"
                   "Correct Option:\n")

# Rating request per evaluation benchmark; slots: full language name, chat sample (Python repr).
RATING_PROMPTS = {
    "mmlu-clinical_knowledge": (
        "I am trying to curate a supervised fine-tuning dataset that will be used to improve the performance of my "
        "LLM on the clinical knowledge section of MMLU in %s (I have translated MMLU from English into many other "
        "languages). Please rate the following fine-tuning dataset sample on a scale of 1-10. Your rating should "
        "reflect the anticipated usefulness of the sample if included in the fine-tuning dataset for improving my "
        "LLM's performance on the clinical knowledge section of MMLU (with 1 implying least useful and 10 implying "
        "most useful). Do not include any additional explanation; just provide the number rating:\n\n%s"),
    "mmlu-virology": (
        "I am trying to curate a supervised fine-tuning dataset that will be used to improve the performance of my "
        "LLM on the virology section of MMLU in %s (I have translated MMLU from English into many other languages). "
        "Please rate the following fine-tuning dataset sample on a scale of 1-10. Your rating should reflect the "
        "anticipated usefulness of the sample if included in the fine-tuning dataset for improving my LLM's "
        "performance on the virology section of MMLU (with 1 implying least useful and 10 implying most useful). "
        "Do not include any additional explanation; just provide the number rating:\n\n%s"),
    "winogrande": (
        "I am trying to curate a supervised fine-tuning dataset that will be used to improve the performance of my "
        "LLM on Winogrande in %s (I have translated Winogrande from English into many other languages). Please rate "
        "the following fine-tuning dataset sample on a scale of 1-10. Your rating should reflect the anticipated "
        "usefulness of the sample if included in the fine-tuning dataset for improving my LLM's performance on "
        "Winogrande (with 1 implying least useful and 10 implying most useful). Do not include any additional "
        "explanation; just provide the number rating:\n\n%s"),
    "belebele": (
        "I am trying to curate a supervised fine-tuning dataset that will be used to improve the performance of my "
        "LLM on Belebele, a diversity-focused evaluation benchmark designed to assess the performance of large "
        "language models (LLMs) across various African languages, in %s. Please rate the following fine-tuning "
        "dataset sample on a scale of 1-10. Your rating should reflect the anticipated usefulness of the sample if "
        "included in the fine-tuning dataset for improving my LLM's performance on Belebele (with 1 implying least "
        "useful and 10 implying most useful). Do not include any additional explanation; just provide the number "
        "rating:\n\n%s"),
}
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt(template: str, *cols) -> Column:
    return F.format_string(template, *[_c(c) for c in cols])


def py_repr_str(s) -> Column:
    """Python ``repr`` of a string (quote choice and escapes), used inside rating prompts."""
    s = _c(s)
    esc = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(ch), F.lit(rep))
    dq = s.contains("'") & ~s.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def messages_repr(system: Column, user: Column, assistant: Column) -> Column:
    """``repr`` of the three-message chat list embedded in a rating prompt."""
    parts = []
    for role, content in (("system", system), ("user", user), ("assistant", assistant)):
        parts.append(F.concat(F.lit(f"{{'role': '{role}', 'content': "), py_repr_str(content), F.lit("}")))
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def chat_row(system: Column, user: Column, assistant: Column) -> Column:
    """``struct<messages: array<struct<role, content>>>`` fine-tuning row."""
    msgs = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content"))
                     for r, c in (("system", system), ("user", user), ("assistant", assistant))])
    return F.struct(msgs.alias("messages"))


def request_body(model: Column, content: Column) -> Column:
    """Batch-API request body with the fixed generation settings."""
    return F.struct(
        model.alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
        F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(TEMPERATURE).alias("temperature"), F.lit(TOP_P).alias("top_p"))
