"""MD5 over arrays: the same message tails under many names, a whole array a step instead of a call a message.

Functions that run inside tasks are pickled by value, so executors do not need this module.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_S = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_G = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: list, first_only: bool) -> list[np.ndarray]:
    """The state after one block, given by its 16 words, each an array or a number; of the last block only the first word may be wanted."""
    a, b, c, d = [x.copy() for x in state]
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61 if first_only else 64):  # the first word is set last by step 61
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        w = words[_G[i]]
        if isinstance(w, int):
            np.add(a, np.uint32((w + _K[i]) & 0xFFFFFFFF), out=a)
        else:
            np.add(a, w, out=a)
            np.add(a, np.uint32(_K[i]), out=a)
        np.left_shift(a, np.uint32(_S[i]), out=t)
        np.right_shift(a, np.uint32(32 - _S[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    if first_only:
        return [state[0] + b]  # after 61 steps the first word is in b
    return [x + y for x, y in zip(state, (a, b, c, d))]


class Tails:
    """Messages that end as given, to be hashed under names put before them."""

    def __init__(self, tails: list[bytes]):
        self.n = len(tails)
        self.data = np.frombuffer(b"".join(tails), np.uint8)
        self.size = np.fromiter(map(len, tails), np.int64, self.n)
        self.at = np.cumsum(self.size) - self.size
        self.laid: dict[int, list[tuple[np.ndarray, list[list]]]] = {}

    def _lay(self, skip: int) -> list[tuple[np.ndarray, list[list]]]:
        """Per number of blocks the messages that take so many, and the words of each block; the first ``skip`` bytes are left 0."""
        out, total = [], self.size + skip
        blocks = (total + 8) // 64 + 1
        for nb in np.unique(blocks):
            rows = np.flatnonzero(blocks == nb)
            m, size = np.zeros((len(rows), 64 * int(nb)), np.uint8), self.size[rows]
            own = np.repeat(np.arange(len(rows)), size)
            within = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            m[own, skip + within] = self.data[np.repeat(self.at[rows], size) + within]
            m[np.arange(len(rows)), skip + size] = 0x80
            m[:, -8:] = (8 * total[rows]).astype("<u8").view(np.uint8).reshape(-1, 8)
            w = np.ascontiguousarray(m.view("<u4").T)
            words = [int(x[0]) if (x == x[0]).all() else x for x in w]
            out.append((rows, [words[k:k + 16] for k in range(0, len(words), 16)]))
        return out

    def first_words(self, name: bytes) -> np.ndarray:
        """The first 8 hex digits of md5(name + tail), as numbers."""
        if len(name) not in self.laid:
            self.laid[len(name)] = self._lay(len(name))
        head = np.frombuffer(name + bytes(-len(name) % 4), "<u4").tolist()
        out = np.empty(self.n, np.uint32)
        for rows, blocks in self.laid[len(name)]:
            state = [np.full(len(rows), x, np.uint32) for x in _START]
            for k, words in enumerate(blocks):
                words = list(words)
                for j, h in enumerate(head[16 * k:16 * k + 16]):  # the tails have no bit there
                    words[j] = words[j] | (h if isinstance(words[j], int) else np.uint32(h))
                state = _block(state, words, first_only=k == len(blocks) - 1)
            out[rows] = state[0]
        return out.byteswap()
