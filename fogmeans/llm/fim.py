"""Fill-in-the-middle transformation by one numpy kernel over the UTF-8 buffers of many texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import STEP_BYTES

#: The white space of the contract's tokens, and the marks.
WHITE = b" \t\n\v\f\r"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 texts, how many are transformed, and how many of these have the suffix first.
RATE, SPM_RATE = 50, 80

_CLASS = np.zeros(256, np.uint8)
_CLASS[list(WHITE)] = 1
_MARK = np.zeros(256, bool)
_MARK[list(b"PSM")] = True


@dataclass
class Cuts:
    """Of each text: its units, the bytes before each cut, code points of prefix and middle, and whether a mark stands in it."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray
    marked: np.ndarray


def cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Cuts:
    """All texts at once: ``data`` holds their bytes one after another, ``ends`` the first byte of each and the end of the last.

    A unit begins at a text's first byte and where white space follows another byte. Units are counted by one running sum
    over all bytes, less its value at the text's start; the place of a unit is found by searching that sum.
    """
    start, stop = ends[:-1], ends[1:]
    white = _CLASS[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (white[1:] == 1) & (white[:-1] == 0)
    full = stop > start
    begins[start[full]] = True
    # count[i]: units that begin before byte i
    count = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    before = count[start]
    n = count[stop] - before
    low, high = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    # unit c (from 0) begins where the sum first reaches before + c + 1; the cut after all units is the end
    place = lambda c: np.where(c < n, np.searchsorted(count, before + c + 1, side="left") - 1, stop)
    first, second = place(low), place(high)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    marks = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        marks[: len(data) - 2] = (data[:-2] == ord("<")) & _MARK[data[1:-1]] & (data[2:] == ord(">"))
    upto = np.concatenate([[0], np.cumsum(marks)])
    # a mark that begins in the last two bytes of a text would end in the next one
    marked = upto[np.maximum(stop - 2, start)] > upto[start]
    return Cuts(n, first - start, second - start, chars[first] - chars[start], chars[second] - chars[first], marked)


def _slices(col: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, int)
    at = np.cumsum(sizes) // STEP_BYTES
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(col)]
    return zip(edges[:-1], edges[1:], strict=True)


def transform(docs: DataFrame, keep: list[str] | None = None, key: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Columns ``keep`` (doc_id) with n, form (plain, psm or spm), prefix_chars, middle_chars (null where plain) and output.

    The draws are the first four groups of eight hexadecimal digits of the sha256 of "seed:key". A null text is empty, an empty
    one plain; a null key draws as the empty string. Texts that hold a mark stay plain, so restored() is exact. Repeated rows
    are transformed alike, very long texts whole (a step of their own), an empty table gives no rows; other columns are
    ignored. Nothing is shuffled, and a task holds about STEP_BYTES of text or one text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i}")
    keep = keep or ["doc_id"]
    rows = docs.select(*[F.col(k) for k in keep], F.coalesce("text", F.lit("")).alias("__text"), *[draw(i) for i in range(4)])
    kind = StructType(list(docs.select(*keep).schema) + list(StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")))
    arrow = to_arrow_schema(kind)

    def step(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(len(keep)).cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        h = [rows.column(len(keep) + 1 + i).to_numpy() for i in range(4)]
        c = cuts(np.frombuffer(raw, np.uint8), ends, h[0], h[1])
        plain = (np.diff(ends) == 0) | c.marked | (h[2] % 100 >= rate)
        spm = ~plain & (h[3] % 100 < spm_rate)
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if plain[i]:
                out.append(bytes(raw[a:b]))
            else:
                p, m, s = raw[a : a + c.first[i]], raw[a + c.first[i] : a + c.second[i]], raw[a + c.second[i] : b]
                out.append(b"".join((SUFFIX, s, PREFIX, p, MIDDLE, m) if spm[i] else (PREFIX, p, SUFFIX, s, MIDDLE, m)))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        made = [pa.array(c.n), pa.array(form), pa.array(c.prefix_chars, mask=plain), pa.array(c.middle_chars, mask=plain), pa.array(out, pa.binary())]
        cols = [*rows.columns[: len(keep)], *made]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(len(keep)).cast(pa.large_binary())):
                if b > a:
                    yield step(batch.slice(a, b - a))

    return rows.mapInArrow(run, kind)


def restored(output: Column, form: Column) -> Column:
    """The text of ``output``: its three parts, split at the marks, in their first order."""
    # two marks of three bytes cannot overlap a seam: a mark begins with the only "<" it has
    parts = F.split(output, "<[PSM]>", -1)
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(docs: DataFrame) -> DataFrame:
    """transform() with output_sha256 and restored_sha256 in place of the output; rows and nulls as there."""
    rows = transform(docs)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end form from u),
s as (select *, array_to_string(list_slice(u, 1, a), '') p, array_to_string(list_slice(u, a + 1, b), '') m, array_to_string(list_slice(u, b + 1, n), '') x from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from s"""
