"""Byte-level BPE ids of texts, shared by the encoding and packing operators.

A text is cut before a blank that follows a non-blank character. The
pre-tokenising pattern always starts a new match there, and no match looks
behind, so a cut piece has the same ids alone as inside its text. Pieces repeat
(Zipf), so each is encoded once per worker process and then looked up; the
cache is emptied when it is full. Texts with other white space than blank,
newline, return or tab, and pieces longer than ``LONGEST`` take the library
path. Vocabulary files are named by path and read on the worker.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

#: Cut rule: white space and what follows it up to the next white space.
_CUT = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_ODD_SPACE = re.compile(r"[^\S \n\r\t]")
#: Letters, digits and signs on which the libraries' Unicode tables agree.
_PLAIN = re.compile("[\\x00-\\x7e\\xa1-\\u024f\\u0370-\\u03ff\\u0400-\\u045f\\u2010-\\u2027\\u2030-\\u203a]*")
LONGEST = 4000
CACHE = 400_000


def _held(key, make):
    """One object per worker process, whatever task made it."""
    held = sys.__dict__.setdefault("_evalframe_llm_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


class RankEncoder:
    """Ids by a rank file, as the tiktoken library gives them without special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = pattern
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit numbers."""
        if len(text) <= LONGEST:
            return array("I", self.lib.encode_ordinary(text)).tobytes()
        return array("I", self._long(text)).tobytes()

    def _long(self, text: str) -> list[int]:
        """Match by match: the library's own splitter overflows its stack on very long runs."""
        import regex

        ids: list[int] = []
        for m in _held(("regex", self.pattern), lambda: regex.compile(self.pattern)).finditer(text):
            token = m[0].encode()
            ids.extend((self.ranks[token],) if token in self.ranks else self.lib._encode_single_piece(token))
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.piece(text)
        cache, out = self.cache, []
        if len(cache) > CACHE:
            cache.clear()
        for p in _CUT.findall(text):
            ids = cache.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    cache[p] = ids
            out.append(ids)
        return b"".join(out)


class FileEncoder(RankEncoder):
    """Ids by a tokenizer file, as the tokenizers library gives them with ``add_special_tokens=False``.

    ``ranks`` names a rank file of the same vocabulary, which is faster for
    plain pieces; pieces that hold a special token's string, or letters outside
    the ranges on which both libraries surely agree, go to the library itself.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        from tokenizers import Tokenizer

        super().__init__(ranks, pattern)
        self.file = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.file.get_added_tokens_decoder().values()) or r"(?!)")

    def piece(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not self.special.search(text):
            return super().piece(text)
        return array("I", self.file.encode(text, add_special_tokens=False).ids).tobytes()


def rank_encoder(path: str, pattern: str) -> RankEncoder:
    return _held(("ranks", path, pattern), lambda: RankEncoder(path, pattern))


def file_encoder(path: str, ranks: str, pattern: str) -> FileEncoder:
    return _held(("file", path, ranks, pattern), lambda: FileEncoder(path, ranks, pattern))
