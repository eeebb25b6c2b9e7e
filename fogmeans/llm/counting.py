"""Edit-aware token counts: a segment tree over blocks of pre-tokens; an edit re-encodes its blocks and their neighbours."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import coder, default_ranks
from .common import pinned

#: Characters of a block at least.
BLOCK = 512
_SAFE = regex.compile(r"[!-~\p{L}](?=[ \n])")


class TokenTree:
    """Token count of a text under edits.

    Blocks begin where a letter or printable ASCII is followed by a space or newline; pre-tokens never cross such a place, so a text's count is
    the sum over its blocks. Nodes hold sums of (characters, tokens); an edit updates one path for each block it changes.
    """

    def __init__(self, text: str, count, block: int = BLOCK):
        self.count, self.block, self.encoded = count, block, 0
        self._build(self._split(text))

    def _split(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            m = _SAFE.search(text, at + self.block)
            end = m.end() if m else len(text)
            out.append(text[at:end])
            at = end
        return out

    def _tokens(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text) if text else 0

    def _build(self, parts: list[str], known: dict[int, int] | None = None) -> None:
        self.size = 1
        while self.size < max(1, len(parts)):
            self.size *= 2
        self.parts = parts + [""] * (self.size - len(parts))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, p in enumerate(parts):
            self.chars[self.size + i] = len(p)
            self.tokens[self.size + i] = known[i] if known else self._tokens(p)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, leaf: int, text: str) -> None:
        self.parts[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), self._tokens(text)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _find(self, pos: int) -> tuple[int, int]:
        """(block, place in it) of a character; the end of the text belongs to the last block with text."""
        pos = min(pos, self.chars[1] - 1) if self.chars[1] else 0
        i = 1
        while i < self.size:
            i *= 2
            if pos >= self.chars[i]:
                pos -= self.chars[i]
                i += 1
        return i - self.size, pos

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters at ``pos`` by ``insert``; both are cut to the text."""
        n = self.chars[1]
        pos = max(0, min(pos, n))
        delete = max(0, min(delete, n - pos))
        if not n:
            self._build(self._split(insert))
            return
        first, place = self._find(pos)
        if pos == n:
            place += 1
        last = self._find(pos + delete - 1)[0] if delete else first
        lo, hi = first - 1, last + 1
        while lo >= 0 and not self.parts[lo]:
            lo -= 1
        while hi < self.size and not self.parts[hi]:
            hi += 1
        lo, hi = max(lo, 0), min(hi, self.size - 1)
        region = "".join(self.parts[lo : hi + 1])
        at = place + sum(len(p) for p in self.parts[lo:first])
        region = region[:at] + insert + region[at + delete :]
        pieces = self._split(region)
        room = hi - lo + 1
        if len(pieces) > room:  # more blocks than places: keep all counts, lay the leaves out anew
            parts = [p for p in self.parts[:lo] if p], [p for p in self.parts[hi + 1 :] if p]
            counts = [self.tokens[self.size + i] for i in range(lo) if self.parts[i]] + [self._tokens(p) for p in pieces] + [self.tokens[self.size + i] for i in range(hi + 1, self.size) if self.parts[i]]
            self._build([*parts[0], *pieces, *parts[1]], dict(enumerate(counts)))
            return
        for k in range(room):
            new = pieces[k] if k < len(pieces) else ""
            if new != self.parts[lo + k]:
                self._set(lo + k, new)


def count_edited(docs: DataFrame, edits: Column, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens of the text, n_edits, n_tokens_edited after the edits, n_chars_reencoded by them.

    ``edits`` is an array of structs (pos, del, ins) applied in order; null arrays and null fields edit nothing. Null texts
    are empty. Each row is a tree of its own in one task, so repeated doc_ids and rows of any length need no shuffle.
    An empty table gives no rows; other columns are ignored.
    """
    if path is None or pattern is None:
        path, pattern = default_ranks()
    kind = "doc_id {}, n_tokens long, n_edits int, n_tokens_edited long, n_chars_reencoded long".format(dict(docs.dtypes)["doc_id"])

    def run(batches):
        import pandas as pd

        c = coder(path, pattern)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                tree = TokenTree(r.text or "", lambda t: len(c.encode(t)))
                n, tree.encoded = tree.total, 0
                made = [(e["pos"], e["del"], e["ins"]) for e in (r.edits if r.edits is not None else []) if e is not None and e["pos"] is not None]
                for pos, delete, insert in made:
                    tree.edit(int(pos), int(delete or 0), insert or "")
                out.append((r.doc_id, n, len(made), tree.total, tree.encoded))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_reencoded"])

    return docs.select("doc_id", F.col("text"), edits.alias("edits")).mapInPandas(run, kind)


def count_table(docs: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """count_edited() with the edits in a table (doc_id, seq, pos, del, ins), applied to a document by rising seq.

    Equal seqs go by pos, del and ins. Edits meet their document by sorting, one after another: a task holds one tree, never
    the edits of a document, however many they are. Every row of a repeated doc_id gets all edits of the id; edits of a null or
    unknown doc_id, or with a null pos, do nothing. No documents give no rows; other columns are ignored.
    """
    if path is None or pattern is None:
        path, pattern = default_ranks()
    kind = dict(docs.dtypes)["doc_id"]
    rows = pinned(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "count-rows")
    long = lambda c: F.col(c).cast("long").alias(c)
    e = edits.where("pos is not null").select(F.col("doc_id").alias("d"), long("seq"), long("pos"), long("del"), F.col("ins").alias("text"))
    e = rows.select("doc_id", "row").join(e, F.col("doc_id") == F.col("d")).select("doc_id", "row", F.lit(1).alias("edit"), "seq", "pos", "del", "text")
    none = F.lit(None).cast("long")
    both = rows.select("doc_id", "row", F.lit(0).alias("edit"), none.alias("seq"), none.alias("pos"), none.alias("del"), "text").union(e)
    stream = both.repartition("row").sortWithinPartitions("row", "edit", "seq", "pos", "del", "text")

    def run(batches):
        import pandas as pd

        c = coder(path, pattern)
        tree, now = None, ()
        names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_reencoded"]
        for pdf in batches:
            out = []
            for doc_id, _, edit, _, pos, delete, text in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if not edit:
                    if tree is not None:
                        out.append((*now, tree.total, tree.encoded))
                    tree = TokenTree(text or "", lambda t: len(c.encode(t)))
                    now, tree.encoded = (doc_id, tree.total, 0), 0
                else:
                    tree.edit(int(pos), int(delete or 0), text or "")
                    now = (*now[:2], now[2] + 1)
            yield pd.DataFrame(out, columns=names)
        if tree is not None:
            yield pd.DataFrame([(*now, tree.total, tree.encoded)], columns=names)

    return stream.mapInPandas(run, f"doc_id {kind}, n_tokens long, n_edits int, n_tokens_edited long, n_chars_reencoded long")


def revision_edits() -> Column:
    """Three edits of a text, placed by hashes of its id: an inserted phrase, a deletion, a replacement at the end."""
    doc_id, n = F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), F.greatest(n, F.lit(1)).cast("long"))
    edit = lambda pos, delete, insert: F.struct(pos.cast("long").alias("pos"), F.lit(delete).cast("long").alias("del"), F.lit(insert).alias("ins"))
    return F.array(edit(place(1), 0, " (revised 2024) "), edit(place(2), 40, ""), edit(n, 0, "\nEnd of revision."))
