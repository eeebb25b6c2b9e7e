"""Token ids of documents in binary files: sorted, packed by the context-mixing coder, read back and checked.

A file holds sections; a section holds whole documents and stands alone. Its layout (numbers are little-endian): the magic,
the lengths of the head and of the words, the head's crc32; the head (zlib): JSON of the section's place and its documents, the
ids with shares of their own and all shares, then sizes, checksums and word counts of the blocks, then lengths and ids of the
phrases; the words of all blocks; a line feed. A phrase is a word of several ids that the section has more than once; it is
coded as one number, from the place's base on.
"""

from __future__ import annotations

import codecs
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import idcoder
from .common import drop_path, dropped, pinned, scratch_path, text_steps

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"FMTOKID1"
#: Ids after which a section is closed at the next end of a document, sections of a file, and bytes of text of a task; small tables are dealt to all cores in tasks of at least LEAST_BYTES.
SECTION_IDS = 8 << 20
FILE_SECTIONS = 4
TASK_BYTES = 16 << 20
LEAST_BYTES = 2 << 20
#: Chunks that the library gets as one text, and the word between them, which is rare in texts.
JOINED = 2048
MARK = "\x01"
#: Pieces a worker remembers the ids of, ids of all of them, and characters of the longest.
REMEMBERED = 1 << 19
REMEMBERED_IDS = 8 * REMEMBERED
LONGEST = 64
#: How a vocabulary file must prepare texts for Cutter to cut them as it does, and what ends a piece's last token.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"
#: Classes of bytes in plain texts (ASCII and the letters of Latin-1, which are 0xC3 and one of 0x80 to 0xBF); ODD is any other.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)


def runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Numbered(dict):
    """Numbers of pieces, given when they are first asked for; ``fresh`` has the pieces since it was emptied."""

    def __init__(self):
        self.given, self.fresh = 0, []

    def __missing__(self, piece):
        n = self[piece] = self.given
        self.given += 1
        self.fresh.append(piece)
        return n


def byte_tables() -> tuple[bytes, bytes]:
    """Of each byte of a plain text its class, and what it is in lower case."""
    kind, lower = [ODD] * 256, list(range(256))
    for b in (*range(0x21, 0x7F), *range(0x80, 0xC0), 0xC3):
        kind[b] = DIGIT if chr(b).isdigit() and b < 0x80 else LETTER if b >= 0x80 or chr(b).isalpha() else SIGN
    for b in b"\t\n\v\f\r ":
        kind[b] = BLANK
    for b in (0x97, 0xB7):  # of the signs for times and division
        kind[b] = ODD
    for b in (*range(0x41, 0x5B), *range(0x80, 0x9F)):
        lower[b] = b + 0x20
    return bytes(kind), bytes(lower)


KIND, LOWER = byte_tables()
#: The characters that stand for bytes in the vocabulary; the blank stays, as it parts pieces.
BYTE_CHARS = "".join(chr(0x100 + [*range(0x21), *range(0x7F, 0xA1), 0xAD].index(b)) if b < 0x20 or 0x7F <= b <= 0xA0 or b == 0xAD else chr(b) for b in range(256))


def plain_pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The pieces that PATTERN cuts of the texts in lower case, where each text's begin (and the last's end), and which texts are not plain: they give none.

    NFC leaves plain texts as they are, and lower case goes letter by letter. A text that may hold a special string is not plain.
    """
    joined = b" ".join([*texts, b" "])
    raw, kind, lower = (np.frombuffer(x, np.uint8) for x in (joined, joined.translate(KIND), joined.translate(LOWER)))
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    odd = kind == ODD
    odd[1:] |= (raw[:-1] == 0xC3) != (raw[1:] & 0xC0 == 0x80)
    odd[1:] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    unplain = np.unique(np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1)
    if len(unplain):
        kind = kind.copy()
        for a, n in zip(begin[unplain].tolist(), sizes[unplain].tolist(), strict=True):
            kind[a : a + n] = BLANK
    inked = kind != BLANK
    parted = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first = np.flatnonzero(inked & np.append(True, parted))
    after = np.flatnonzero(inked & np.append(parted, True)) + 1
    # a single apostrophe takes one of these endings from the letters behind it
    at = np.flatnonzero((lower[first] == ord("'")) & (after - first == 1))
    at = at[kind[after[at]] == LETTER]
    x, y = lower[after[at]], lower[after[at] + 1]
    take = np.isin(x, list(b"stmd")) + 2 * (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))
    after[at] += take
    first[at + 1] += take  # a piece of letters follows
    some = first < after
    first, after = first[some], after[some]
    offsets = np.append(0, np.cumsum(after - first))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(lower[inked])])
    return pieces, np.append(np.searchsorted(first, begin), len(first)), unplain


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    The library drops white space, and nothing it does (special strings, NFC, lower case, splitting) reaches across an ASCII
    white space character, so a text's ids are its chunks' ids one after another. Each chunk is encoded by the library, many as
    one text with MARK between them; those met before are remembered. Plain texts are cut into the library's own pieces
    (plain_pieces), and the library encodes those not met before, parted by blanks, without the steps that are done.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        same = said["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and said["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": cut}
        self.pieces = None
        if same and said["model"].get("end_of_word_suffix") == SUFFIX and all(t["content"].startswith("<|") for t in said["added_tokens"]):
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self.library.get_vocab()
            #: whether a piece ends with this id
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True
        self.forget()

    def forget(self) -> None:
        """Number pieces anew."""
        self.known = Numbered()
        #: of each number the place of its first id among the ids, and how many it has
        self.first, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED_IDS

    def _chunk_ids(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and how many each has. Each mark gives its id once; if that id is there more often, a chunk holds it and each is encoded alone."""
        texts = [c.decode() for c in chunks]
        if self.mark is not None:
            ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(texts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            marks = ids == self.mark
            if marks.sum() == len(chunks) - 1:
                return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1
        return self._each(self.library, texts)

    def _piece_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _chunk_ids(), of pieces. If the ids that end a piece are not as many as the pieces, each is encoded alone."""
        text = codecs.charmap_decode(b" ".join(pieces), "strict", BYTE_CHARS)[0]
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.last.take(ids))
        if len(ends) == len(pieces):
            return ids, np.diff(ends, prepend=-1)
        return self._each(self.pieces, text.split(" "))

    def _each(self, library, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], dtype=np.uint32), np.array([len(ids) for ids in made])

    def _learn(self, ids_of) -> None:
        """The ids of the pieces numbered last."""
        fresh, self.known.fresh = self.known.fresh, []
        made = [ids_of(fresh[a : a + JOINED]) for a in range(0, len(fresh), JOINED)]
        lengths = np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)])
        self.first = np.append(self.first, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in made)])
        for c in fresh:
            if len(c) > LONGEST:
                del self.known[c]

    def numbers(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Numbers of the pieces of each text, good until forget()."""
        texts, number = [t or b"" for t in texts], self.known.__getitem__
        out, rest = [], range(len(texts))
        if self.pieces and texts:
            pieces, begin, rest = plain_pieces(texts)
            pieces = pieces.dictionary_encode()
            found = np.fromiter(map(number, pieces.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(pieces.dictionary))
            out = np.split(found.take(pieces.indices.to_numpy()), begin[1:-1])
            self._learn(self._piece_ids)
        out = out or [None] * len(texts)
        for i in rest:
            chunks = texts[i].split()
            out[i] = np.fromiter(map(number, chunks), np.int64, len(chunks))
        self._learn(self._chunk_ids)
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.full():
            self.forget()
        return [self.ids[runs(self.first[n], self.lengths[n])] for n in self.numbers(texts)]


_cached: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    if path not in _cached:
        _cached[path] = ChunkEncoder(path)
    return _cached[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pack(part: int, section: int, doc_ids: list, ids: list[np.ndarray], block: int | None = None) -> bytes:
    """A section of documents (their ids end with END). Few ids make shorter blocks, so that a small task has many side by side."""
    none = np.zeros(0, np.int64)
    return _pack({"part": part, "section": section, "docs": doc_ids, "n": [len(i) for i in ids]}, np.concatenate([none, *ids]), none, none, block)


def pack_pieces(part: int, section: int, doc_ids: list, numbers: list[np.ndarray], coder: ChunkEncoder, end: int | None) -> bytes:
    """As pack(), of documents given as numbers of ``coder``'s pieces, each followed by the id ``end``. Pieces of several ids that are there more than once are phrases."""
    flat = np.concatenate([np.zeros(0, np.int64), *numbers])
    phrase = (np.bincount(flat, minlength=len(coder.first)) > 1) & (coder.lengths > 1)
    base = 1 + max(int(coder.ids.max(initial=0)), end or 0)
    if base > idcoder.LISTED:
        phrase[:] = False
    which = np.flatnonzero(phrase)
    lengths, first = np.where(phrase, 1, coder.lengths), coder.first.copy()
    first[which] = len(coder.ids) + np.arange(len(which))
    upto = np.cumsum([len(n) for n in numbers])
    n = np.diff(np.append(0, np.cumsum(coder.lengths.take(flat))).take(upto), prepend=0)
    each = lengths.take(flat)
    symbols = np.append(coder.ids.astype(np.int64), base + np.arange(len(which))).take(runs(first.take(flat), each))
    if end is not None:
        symbols, n = np.insert(symbols, np.append(0, np.cumsum(each)).take(upto), end), n + 1
    spelt = coder.ids[runs(coder.first[which], coder.lengths[which])]
    return _pack({"part": part, "section": section, "docs": doc_ids, "n": n.tolist(), "base": base}, symbols, coder.lengths[which], spelt)


def _pack(place: dict, flat: np.ndarray, lengths: np.ndarray, spelt: np.ndarray, block: int | None = None) -> bytes:
    """A section of ``flat``: ids, and from the place's base on phrases with these ``lengths`` and (``spelt``) ids."""
    if len(flat) and int(flat.max()) >> 28:
        raise ValueError("ids must be below 2 ** 28")
    if block is None:
        block = int(min(idcoder.BLOCK, max(idcoder.LEAST_BLOCK, -(-len(flat) // idcoder.LANES))))
    shares = idcoder.Shares.of(flat)
    sizes, sums, words = idcoder.encode(flat, shares, block)
    said = json.dumps(place | {"blocks": len(sizes), "shared": len(shares.ids), "phrases": len(lengths)}).encode()
    numbers = [shares.ids, shares.shares, sizes, sums, [len(w) for w in words], lengths, spelt]
    head = zlib.compress(struct.pack("<I", len(said)) + said + b"".join(np.asarray(x, "<u4").tobytes() for x in numbers), 1)
    body = b"".join(w.tobytes() for w in words)
    return MAGIC + struct.pack("<IQI", len(head), len(body), zlib.crc32(head)) + head + body


def unpack(raw: bytes) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """(place, ids of each document) of every section of a file. What is cut off, altered or no such file is an error."""
    at = 0
    while at < len(raw):
        if raw[at : at + 8] != MAGIC:
            raise ValueError("no section where one should begin")
        n_head, n_body, check = struct.unpack_from("<IQI", raw, at + 8)
        at += 24
        head = raw[at : at + n_head]
        if len(raw) < at + n_head + n_body + 1 or zlib.crc32(head) != check:
            raise ValueError("a section is cut off or altered")
        head = zlib.decompress(head)
        size = struct.unpack_from("<I", head)[0]
        place = json.loads(head[4 : 4 + size])
        n, blocks, phrases = place["shared"], place["blocks"], place["phrases"]
        ids, share, sizes, sums, counts, lengths, spelt = np.split(np.frombuffer(head, "<u4", offset=4 + size), np.cumsum([n, n + 1, blocks, blocks, blocks, phrases]))
        shares = idcoder.Shares(ids, share)
        ends = np.cumsum(counts.astype(np.int64))
        words = np.frombuffer(raw, "<u2", count=n_body // 2, offset=at + n_head)
        flat = np.concatenate([np.zeros(0, "<u4"), *idcoder.decode(sizes, sums, np.split(words, ends[:-1]) if len(ends) else [], shares)])
        if phrases:
            base, lengths = place["base"], lengths.astype(np.int64)
            first = np.append(np.arange(base), base + np.cumsum(lengths) - lengths)
            flat = np.append(np.arange(base, dtype="<u4"), spelt).take(runs(first.take(flat), np.append(np.ones(base, np.int64), lengths).take(flat)))
        yield place, np.split(flat, np.cumsum(place["n"])[:-1]) if place["n"] else []
        at += n_head + n_body + 1


def sections(batches: Iterator[pa.RecordBatch], part: int, coder: ChunkEncoder, end: int | None, section_ids: int) -> Iterator[bytes]:
    """The packed sections of one task's rows (doc_id, text). A section ends early where the coder's memory is full, which is emptied then."""
    names, pieces, held, section = [], [], 0, 0
    for batch in batches:
        for a, b, texts in text_steps(batch):
            if not names and coder.full():
                coder.forget()
            names += batch.column(0).slice(a, b - a).to_pylist()
            made = coder.numbers(texts)
            pieces += made
            held += sum(int(coder.lengths.take(n).sum()) for n in made) + len(made)
            if held >= section_ids or coder.full():
                yield pack_pieces(part, section, names, pieces, coder, end)
                names, pieces, held, section = [], [], 0, section + 1
    if names:
        yield pack_pieces(part, section, names, pieces, coder, end)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = END, task_bytes: int = TASK_BYTES, section_ids: int = SECTION_IDS) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text; more columns are ignored) under ``path``, doc_id rising.

    Rows are dealt by ranges of doc_id (and a hash of the text, so that one doc_id on very many rows is split) into tasks of
    about ``task_bytes`` of text, sorted there, encoded and packed. Null doc_ids come first; rows equal in doc_id keep the
    order of their texts' hashes. A null text is empty and has the id ``end`` only (no id where that is None). A very long text
    makes a section longer than others. An empty table gives no sections.
    """
    vocabulary = vocabulary or default_vocabulary()
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    tasks = max(1, -(-size // task_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    dealt = rows.repartitionByRange(tasks, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for packed in sections(batches, TaskContext.get().partitionId(), encoder(vocabulary), end, section_ids):
            yield pa.RecordBatch.from_arrays([pa.array([packed], type=pa.binary())], names=["value"])

    packed = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SECTIONS).text(path)


def read(spark: SparkSession, path: str, id_type: str = "long", ids: bool = True) -> DataFrame:
    """part, section, place, doc_id, n_tokens, ids_crc32 and (unless ``ids`` is false) ids of every document under ``path``.

    A task reads one file after another and holds one section. Files without sections give no rows.
    """
    kind = "part int, section int, place long, doc_id string, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for place, docs in unpack(content.as_py()):
                    n = len(docs)
                    cols = [pa.array([place["part"]] * n, pa.int32()), pa.array([place["section"]] * n, pa.int32()), pa.array(np.arange(n)), pa.array(place["docs"], pa.string()), pa.array(place["n"], pa.int64()), pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())]
                    if ids:
                        offsets = np.concatenate([[0], np.cumsum(place["n"])]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(docs).astype(np.int64))))
                    names = ["part", "section", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, kind).withColumn("doc_id", F.col("doc_id").cast(id_type))


def starts(docs: DataFrame) -> DataFrame:
    """read() with start: the ids of all documents before, in order of part, section and place.

    Sections' sums are added up over parts first (a row a task that wrote), then inside a part, then inside a section, so no
    task sees all documents.
    """
    from pyspark.sql.window import Window

    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = docs.groupBy("part", "section").agg(F.sum("n_tokens").alias("n"))
    parts = sections.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part"), "n").alias("of_part"))
    of_section = sections.select("part", "section", before(Window.partitionBy("part").orderBy("section"), "n").alias("of_section"))
    first = of_section.join(parts, "part").select("part", "section", (F.col("of_part") + F.col("of_section")).alias("first"))
    inner = before(Window.partitionBy("part", "section").orderBy("place"), "n_tokens")
    return docs.withColumn("inner", inner).join(first, ["part", "section"]).withColumn("start", F.col("first") + F.col("inner")).drop("inner", "first")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32 of every row of ``docs``, from files written and read back.

    Files are written to the shared folder and deleted when every document is read; nulls, ties and repeats as in write().
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write(docs, path, vocabulary)
    found = pinned(read(spark, path, dict(docs.dtypes)["doc_id"], ids=False), "token-docs")
    drop_path(spark, path)
    out = pinned(starts(found).select("doc_id", "start", "n_tokens", "ids_crc32"), "token-starts")
    dropped(found)
    return out
