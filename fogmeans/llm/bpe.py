"""Byte-level BPE as a monoid: halves are encoded alone and joined by re-encoding a window at the seam.

Two facts make a join exact. (1) The splitting pattern never matches across a change from non-space to white space, and it
looks only forward, so text before and after such a place is split the same alone or together. (2) Inside one match, a token
sequence is the BPE of its bytes exactly if every two neighbours are the BPE of their own concatenation. The window grows to
the nearest such places, or inside a long match until both seams hold.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import map_texts

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a leaf of the tree, and bytes of a leaf inside one long match.
LEAF = 1024
PIECE = 2048
#: A safe place: a letter or printable ASCII before a space or newline, which all Unicode versions tell apart alike.
_SAFE = regex.compile(r"[!-~\p{L}](?=[ \n])")
#: Characters with the property White_Space (fixed values), as the tiktoken library's \\s has them; Python's has four more.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class _Crossed(Exception):
    """A token stands across a place where the text should be safe to cut."""


class TreeBpe:
    """Encoder and decoder for one rank file; ``leaf`` and ``piece`` set where the trees end."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, piece: int = PIECE):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("fogmeans", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        white = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")
        self.pattern = regex.compile(white)
        self.leaf, self.piece = leaf, piece
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes[i] = b
        self.pair_ok = lru_cache(1 << 16)(self._pair_ok)
        self.rejoined = 0

    def _pair_ok(self, a: int, b: int) -> bool:
        return self.enc._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def encode_piece(self, raw: bytes) -> list[int]:
        """One match of the pattern."""
        if len(raw) <= self.piece:
            return self.enc._encode_single_piece(raw) if raw not in self.ranks else [self.ranks[raw]]
        mid = len(raw) // 2
        left, right = self.encode_piece(raw[:mid]), self.encode_piece(raw[mid:])
        width = 4
        while True:
            a, b = left[: max(0, len(left) - width)], right[width:]
            window = b"".join(self.bytes[i] for i in left[len(a) :]) + b"".join(self.bytes[i] for i in right[:width])
            inner = self.enc._encode_single_piece(window) if window not in self.ranks else [self.ranks[window]]
            if (not a or self.pair_ok(a[-1], inner[0])) and (not b or self.pair_ok(inner[-1], b[0])):
                return a + inner + b
            width *= 2

    def _plain(self, text: str) -> list[int]:
        """Text of one leaf or window; matches too long for one call become trees of their own."""
        if len(text) <= 2 * self.leaf:
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.encode_piece(m[0].encode())
        return out

    def _node(self, text: str, lo: int, hi: int) -> tuple[list[int] | None, int, int]:
        """Ids of text[lo:hi] and its first and last safe places (-1 if it has none; then the ids are left to the parent)."""
        if hi - lo <= self.leaf:
            m = _SAFE.search(text, lo, hi)
            if m is None:
                return None, -1, -1
            at, last = m.end(), -1
            for last in (i for i in range(hi - 1, lo, -1) if text[i] in " \n" and (text[i - 1].isalpha() or "!" <= text[i - 1] <= "~")):
                break
            return self._plain(text[lo:hi]), at, last if last > 0 else at
        mid = (lo + hi) // 2
        left, lf, ll = self._node(text, lo, mid)
        right, rf, rl = self._node(text, mid, hi)
        if left is None and right is None:
            m = _SAFE.search(text, mid - 1, mid + 1)  # the change may lie on the seam itself
            if m is None:
                return None, -1, -1
            return self._plain(text[lo:mid]) + self._plain(text[mid:hi]), mid, mid
        start = ll if left is not None else lo
        end = rf if right is not None else hi
        head = self._cut_tail(left, text[start:mid]) if left is not None else []
        tail = self._cut_head(right, text[mid:end]) if right is not None else []
        self.rejoined += end - start
        ids = head + self._plain(text[start:end]) + tail
        return ids, (lf if left is not None else rf), (rl if right is not None else ll)

    def _cut_tail(self, ids: list[int], part: str) -> list[int]:
        rest, i = len(part.encode()), len(ids)
        while rest > 0:
            i -= 1
            rest -= len(self.bytes[ids[i]])
        if rest:
            raise _Crossed
        return ids[:i]

    def _cut_head(self, ids: list[int], part: str) -> list[int]:
        rest, i = len(part.encode()), 0
        while rest > 0:
            rest -= len(self.bytes[ids[i]])
            i += 1
        if rest:
            raise _Crossed
        return ids[i:]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the tiktoken library's encode_ordinary gives them; a text without any safe place is one window."""
        try:
            ids = self._node(text, 0, len(text))[0] if len(text) > self.leaf else self._plain(text)
        except _Crossed:  # not seen with the public patterns; the whole text is the window then
            ids = None
        return self._plain(text) if ids is None else ids

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree: leaves of LEAF ids, then neighbours two by two until one is left."""
        parts = [b"".join([self.bytes[i] for i in ids[k : k + LEAF]]) for k in range(0, len(ids), LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


_cached: dict[tuple, TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """One coder for each Python worker."""
    if (path, pattern) not in _cached:
        _cached[path, pattern] = TreeBpe(path, pattern)
    return _cached[path, pattern]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns ``keep`` and ids array<int>, decoded binary of each text. Null counts as the empty text: no ids, no bytes.

    Repeated rows are encoded one by one, an empty table gives no rows, other columns are ignored whatever their names. A
    text is one row of one task, however long.
    """
    if path is None or pattern is None:
        path, pattern = default_ranks()

    def make():
        c = coder(path, pattern)

        def work(texts):
            ids = [c.encode((t or b"").decode()) for t in texts]
            return [ids, [c.decode(i) for i in ids]]

        return work

    return map_texts(docs, keep or ["doc_id"], make, "ids array<int>, decoded binary")


def digests(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encode_documents() with the results digested in the same task: n_tokens, ids_sha256, decoded_sha256, no shuffle.

    Nulls, repeats, empty tables and other columns as there.
    """
    if path is None or pattern is None:
        path, pattern = default_ranks()

    def make():
        c = coder(path, pattern)
        names = [str(i) for i in range(len(c.bytes))]

        def work(texts):
            n, a, b = [], [], []
            for t in texts:
                ids = c.encode((t or b"").decode())
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [n, a, b]

        return work

    return map_texts(docs, keep or ["doc_id"], make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
