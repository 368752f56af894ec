"""Chat formatting by schema fingerprints.

Chat data comes as prompt/completion fields, instruction fields, message lists
or one row per turn. The nested field paths of a layout (``messages[].role``)
are hashed; the hash selects a declarative mapping from ``MAPPINGS`` which says
where conversation, roles and texts are. The result is canonical turns
``(conv_id, turn, role, text)``; the template turns them into formatted pieces.

* ``canonical_turns(df)``: a typed table, fingerprint of its schema (no data read).
* ``canonical_turns_json(df)``: JSON records of mixed layouts, one fingerprint per row.
* ``format_turns`` / ``read_back`` / ``assemble``: template, its inverse, and one
  text per conversation (for conversations known to be bounded).

Defined results: null texts and roles are empty strings; a null turn number
sorts first; equal turn numbers are ordered by role, then text; repeated rows
are repeated turns; columns that no mapping names are ignored, also when their
names clash with other layouts' (see ``select_mapping``); a record without a
matching layout becomes a row of status ``unmapped`` (JSON) or an error
(table); empty tables give empty results. A turn is one row, so a conversation
of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.llm.streams import arrow_schema, batched, rows_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: Role names of other layouts -> canonical roles (fixed values).
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    kind ``rows``: a row is a turn (``order``, ``role``, ``text`` are columns);
    kind ``list``: ``items`` is a list of structs with ``role`` and ``text``;
    kind ``fields``: ``turns`` lists (role, paths); present paths are joined by a newline.
    """

    name: str
    kind: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    order: str = ""
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    canonical_roles: bool = False


MAPPINGS = (
    Mapping("turn_rows", "rows", ("turn", "role", "text"), order="turn", role="role", text="text"),
    Mapping("messages", "list", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Mapping("from_value", "list", ("conversations[].from", "conversations[].value"), items="conversations",
            role="from", text="value", canonical_roles=True),
    Mapping("instruction", "fields", ("instruction", "output"), ("input", "system"),
            turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt_completion", "fields", ("prompt", "completion"), ("system",),
            turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", "fields", ("prompt", "response"), ("system",),
            turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", "fields", ("question", "answer"), ("context",),
            turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths; their order does not matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema: ``a.b`` for structs, ``a[]`` for lists."""
    if isinstance(dtype, T.StructType):
        return [p for f in dtype.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(dtype, T.ArrayType):
        return schema_paths(dtype.elementType, f"{prefix}[]")
    return [prefix]


def value_paths(value, prefix: str = "") -> set[str]:
    """Leaf paths of a parsed JSON value (all list elements are looked at)."""
    if isinstance(value, dict):
        return set().union(*(value_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{prefix}[]") for v in value)) if value else {f"{prefix}[]"}
    return {prefix}


def _signatures(mappings) -> dict[str, Mapping]:
    out = {}
    for m in mappings:
        for k in range(len(m.optional) + 1):
            for extra in itertools.combinations(m.optional, k):
                out.setdefault(fingerprint(m.required + extra), m)
    return out


def select_mapping(paths, mappings=MAPPINGS) -> Mapping | None:
    """The mapping whose fingerprint the paths have.

    Only paths that some mapping names count. If clashing extra columns change
    the fingerprint, the mapping with the most required paths present is taken
    (the earlier one on a tie); None if no mapping's required paths are present.
    """
    known = {p for m in mappings for p in m.required + m.optional}
    present = set(paths) & known
    exact = _signatures(mappings).get(fingerprint(present))
    if exact is not None:
        return exact
    fit = [m for m in mappings if set(m.required) <= present]
    return max(fit, key=lambda m: len(m.required), default=None)


def _role(col: Column, m: Mapping) -> Column:
    col = F.coalesce(col, F.lit(""))
    if not m.canonical_roles:
        return col
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(names[F.lower(col)], col)


def canonical_turns(df: DataFrame, key: str = "conv_id", mappings=MAPPINGS) -> DataFrame:
    """``(key, turn long, role, text)`` of a typed table, layout chosen by its schema's fingerprint."""
    m = select_mapping(schema_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(df.schema))}")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    if m.kind == "rows":
        return df.select(F.col(key).alias(key), F.col(m.order).cast("long").alias("turn"),
                         _role(F.col(m.role), m).alias("role"), text(F.col(m.text)).alias("text"))
    if m.kind == "list":
        x = df.select(F.col(key), F.posexplode(m.items).alias("turn", "item"))
        return x.select(key, F.col("turn").cast("long").alias("turn"), _role(F.col("item")[m.role], m).alias("role"),
                        text(F.col("item")[m.text]).alias("text"))
    have = set(schema_paths(df.schema))
    turns = []
    for role, paths in m.turns:
        cols = [F.col(p) for p in paths if p in have]
        if cols:
            optional = all(p in m.optional for p in paths)
            keep = F.coalesce(*[c.isNotNull() for c in cols]) if optional else F.lit(True)
            parts = F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
            turns.append(F.when(keep, F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n").alias("text"))))
    x = df.select(F.col(key), F.posexplode(F.filter(F.array(*turns), lambda t: t.isNotNull())).alias("turn", "item"))
    return x.select(key, F.col("turn").cast("long").alias("turn"), "item.role", "item.text")


def canonical_turns_json(df: DataFrame, key: str, record: str, mappings=MAPPINGS) -> DataFrame:
    """``(key, layout, fingerprint, status, turn, role, text)`` of JSON records of mixed layouts.

    Each record's own paths are hashed. Records that are null, no JSON object
    or of an unknown layout give one row of status ``unmapped``.
    """
    key_type = df.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, layout string, fingerprint string, status string, turn long, role string, text string"
    schema = arrow_schema(out)
    signatures = _signatures(mappings)

    def text(v) -> str:
        return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def turns(rec, m):
        if m.kind == "list":
            for x in rec.get(m.items) or []:
                if isinstance(x, dict):
                    role = text(x.get(m.role))
                    yield (ROLE_NAMES.get(role.lower(), role) if m.canonical_roles else role), text(x.get(m.text))
        elif m.kind == "rows":
            yield text(rec.get(m.role)), text(rec.get(m.text))
        else:
            for role, paths in m.turns:
                vals = [text(rec.get(p)) for p in paths if rec.get(p) is not None]
                if vals or not all(p in m.optional for p in paths):
                    yield role, "\n".join(v for v in vals if v)

    known = {p for m in mappings for p in m.required + m.optional}

    def run(batches):
        def gen():
            for k, raw in rows_of(batches):
                try:
                    rec = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    rec = None
                paths = value_paths(rec) if isinstance(rec, dict) else set()
                mark = fingerprint(paths & known)
                m = signatures.get(mark) or select_mapping(paths, mappings)
                got = list(turns(rec, m)) if m else []
                if not m:
                    yield k, None, mark, "unmapped", None, None, None
                for i, (role, t) in enumerate(got):
                    at = rec.get(m.order) if m.kind == "rows" else i
                    yield k, m.name, mark, "ok", at, role, t

        yield from batched(gen(), schema)

    return df.select(key, record).mapInArrow(run, out)


def escape(c: Column) -> Column:
    """No ``<|`` is left: a backslash is added inside ``<|``, ``<\\|``, ... (one more than there were)."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escape_role(c: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(c, r"~", "~0"), "\n", "~1"))


def _unescape_role(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(c), "~1", "\n"), "~0", "~")


def format_turns(turns: DataFrame, key: str = "conv_id", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted piece per turn: ``(key, turn, piece, loss array<struct<start,end>>)``.

    A conversation's formatted text is its pieces joined in order of (turn, piece).
    ``loss`` has the spans of the piece (code points, end exclusive) that a
    loss mask covers. No shuffle: a piece depends on its turn alone.
    """
    x = turns.select(key, "turn", F.col("role"), _escape_role(F.col("role")).alias("_r"), escape(F.col("text")).alias("_t"))
    start = F.length("_r") + F.lit(len(OPEN) + 1)
    span = F.struct(start.alias("start"), (start + F.length("_t")).alias("end"))
    return x.select(
        key, "turn",
        F.concat(F.lit(OPEN), F.col("_r"), F.lit("\n"), F.col("_t"), F.lit(CLOSE + "\n")).alias("piece"),
        F.when(F.col("role").isin(*loss_roles), F.array(span)).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("loss"))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns read from formatted pieces or whole formatted conversations.

    ``(key, turn, at, role, text, loss_text, formatted_chars)``: ``at`` numbers
    the turns inside a row; ``loss_text`` is the unescaped text under the loss
    spans, given on the row's first turn; ``formatted_chars`` likewise.
    """
    under = F.array_join(F.transform("loss", lambda s: F.substring(F.col("piece"), s["start"] + 1, s["end"] - s["start"])), "")
    x = formatted.select(key, "turn", F.length("piece").alias("_chars"), unescape(under).alias("_loss"),
                         F.posexplode(F.split("piece", r"<\|im_end\|>\n")).alias("at", "_p"))
    x = x.filter(F.col("_p").startswith(OPEN))
    head = F.substring_index("_p", "\n", 1)
    first = F.col("at") == 0
    return x.select(key, "turn", "at",
                    _unescape_role(F.substring(head, F.lit(len(OPEN) + 1), F.length(head))).alias("role"),
                    unescape(F.substring(F.col("_p"), F.length(head) + 2, F.length("_p"))).alias("text"),
                    F.when(first, F.col("_loss")).otherwise("").alias("loss_text"),
                    F.when(first, F.col("_chars")).otherwise(0).alias("formatted_chars"))


def assemble(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """One formatted text per conversation, for conversations known to fit a cell: ``(key, turn, piece, loss)``."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "piece", "loss")))
    x = formatted.groupBy(key).agg(parts.alias("_p"))
    step = lambda acc, p: F.struct(
        F.concat(acc["piece"], p["piece"]).alias("piece"),
        F.concat(acc["loss"], F.transform(p["loss"], lambda s: F.struct(
            (s["start"] + F.length(acc["piece"])).alias("start"), (s["end"] + F.length(acc["piece"])).alias("end")))).alias("loss"))
    zero = F.struct(F.lit("").alias("piece"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    x = x.select(key, F.aggregate("_p", zero, step).alias("_a"))
    return x.select(key, F.lit(0).cast("long").alias("turn"), "_a.piece", "_a.loss")
