"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_texts, pinned, text_steps

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Labelled rows the classifier is fitted on, at most (toxic, other): those with the smallest md5 of their doc_id.
SAMPLE = (2000, 4000)
#: Bytes of their texts, at most, half for each label: a row that does not fit into what is left is not used.
SAMPLE_BYTES = 64 << 20
#: Rows of the base rate that each term's toxic share is drawn to, and the weight of a term that does not speak for toxic.
SHRINK = 2.0
NEUTRAL = 0.05
NEIGHBOURS = 15
BLOCK = 128
#: Terms with the longest postings whose blocks are dense, queries searched together, and blocks each of them reads first. They decide the cost only.
DENSE = 1024
TOGETHER = 64
FIRST = 2
#: Examples whose postings are looked at together while an index is built; decides the memory only.
PIECE = 256
#: More than the error of a float32 cosine: what is nearer than this to a limit is compared in doubles.
SLACK = 1e-5
#: Weight of the prior in a vote, in units of cosine.
PRIOR = 0.5


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


def terms_of(text: bytes | None) -> Counter:
    """Words and how often each stands in the text: the whole vector, before its weights."""
    return Counter(words_of(text))


class Matcher:
    """Counts of the known terms in a text: their numbers, rising, and how often each stands in it."""

    def __init__(self, terms: list[bytes]):
        self.place = {t: i for i, t in enumerate(terms)}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text)
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        return np.unique(ids[ids >= 0], return_counts=True)


def _rows(vectors: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, terms and weights of all vectors, one after another."""
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int64)
    return starts, np.array([t for v in vectors for t in v], dtype=np.int32), np.array([w for v in vectors for w in v.values()], dtype=float)


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of every span."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


class BlockMaxIndex:
    """Postings of unit vectors with weights of 0 or more, in blocks of ``block`` examples.

    The DENSE most frequent terms have dense blocks with each term's largest weight in each block; the postings of all others
    are short and added up at once. The bound of a block is its largest sum of rare terms and the frequent terms' largest
    weights. Examples with the same heaviest frequent term stand together, so blocks differ in their bounds. ``vectors`` are
    dicts, or starts, terms and weights of all.
    """

    def __init__(self, vectors, n_terms: int, block: int = BLOCK):
        self.starts, self.terms, self.weights = vectors if isinstance(vectors, tuple) else _rows(vectors)
        self.n, self.block, self.n_terms = len(self.starts) - 1, block, n_terms
        self.blocks = max(1, -(-self.n // block))
        df = np.bincount(self.terms, minlength=n_terms)
        often = np.argsort(-df, kind="stable")[:DENSE]
        self.dense = np.full(n_terms, -1, dtype=np.int32)
        self.dense[often] = np.arange(len(often))
        lead = np.full(self.n, -1)
        for row, at, w, _ in self._pieces():
            heavy = np.flatnonzero(at >= 0)
            top = np.zeros(self.n)
            np.maximum.at(top, row[heavy], w[heavy])
            first = heavy[w[heavy] >= top[row[heavy]]]
            lead[row[first]] = at[first]
        #: the example at each place of the blocks, and the place of each example
        self.example = np.argsort(lead, kind="stable")
        place = np.empty(self.n, dtype=np.int32)
        place[self.example] = np.arange(self.n)
        self.tiles = np.zeros((self.blocks, len(often), block), dtype=np.float32)
        # rare postings by term, and by example within a term: each piece goes to the next free places of its terms
        rare = df.copy()
        rare[often] = 0
        self.first = np.concatenate([[0], np.cumsum(rare)])
        self.post = np.empty(self.first[-1], dtype=np.int32), np.empty(self.first[-1])
        free = self.first[:-1].copy()
        for row, at, w, t in self._pieces():
            spot, heavy = place[row], at >= 0
            self.tiles[spot[heavy] // block, at[heavy], spot[heavy] % block] = w[heavy]
            by = np.flatnonzero(~heavy)
            by = by[np.argsort(t[by], kind="stable")]
            met, begin, n = np.unique(t[by], return_index=True, return_counts=True)
            to = np.repeat(free[met] - begin, n) + np.arange(len(by))
            self.post[0][to], self.post[1][to] = spot[by], w[by]
            free[met] += n
        self.best = np.ascontiguousarray(self.tiles.max(axis=2).T)

    def _pieces(self):
        """Example, place among the dense terms, weight and term of all postings, PIECE examples at a time: the postings are large, and what is made of all at once stays with the worker."""
        for a in range(0, self.n, PIECE):
            cut = self.starts[a : a + PIECE + 1]
            some = slice(cut[0], cut[-1])
            row = np.repeat(np.arange(a, a + len(cut) - 1, dtype=np.int32), np.diff(cut))
            yield row, self.dense[self.terms[some]], self.weights[some], self.terms[some]

    def search(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest examples with a positive cosine; ties go to smaller ids. Exact."""
        return self.search_all([(np.array(list(query), dtype=int), np.array(list(query.values()), dtype=float))], k)[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() of many queries (terms, weights)."""
        return [r for a in range(0, len(queries), TOGETHER) for r in self._together(queries[a : a + TOGETHER], k)]

    def _together(self, queries, k: int):
        """The queries read the blocks of their largest bounds, then all others that can enter the first k of one of them."""
        m, width = len(queries), self.blocks * self.block
        which = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])
        at = self.dense[terms]
        heavy = at >= 0
        q = np.zeros((m, self.tiles.shape[1]), dtype=np.float32)
        q[which[heavy], at[heavy]] = weights[heavy]
        rare = ~heavy
        first = self.first[terms[rare]]
        length = self.first[terms[rare] + 1] - first
        spot = _spans(first, length)
        # sums of rare terms, query by query
        cell = self.post[0][spot] + np.repeat(which[rare] * width, length)
        sims = np.bincount(cell, self.post[1][spot] * np.repeat(weights[rare], length), m * width).astype(np.float32).reshape(m, width)
        bound = q @ self.best + sims.reshape(m, self.blocks, self.block).max(axis=2)
        read, wanted = np.zeros(self.blocks, bool), np.zeros(self.blocks, bool)
        wanted[np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST]] = True
        least = np.zeros(m, dtype=np.float32)
        for _ in range(2):
            for b in np.flatnonzero(wanted):
                sims[:, b * self.block : (b + 1) * self.block] += q @ self.tiles[b]
            read |= wanted
            known = np.where(np.repeat(read, self.block), sims, 0)
            if width > k:
                least = np.partition(known, width - k, axis=1)[:, width - k]
            wanted = ~read & ((bound > 0) & (bound >= least[:, None] - SLACK)).any(axis=0)
        who, where = np.nonzero((known > 0) & (known >= least[:, None] - SLACK))
        cut = np.searchsorted(who, np.arange(m + 1))
        out, full = [], np.zeros(self.n_terms)
        for i, (t, w) in enumerate(queries):
            ids = self.example[where[cut[i] : cut[i + 1]]]
            full[t] = w
            length = self.starts[ids + 1] - self.starts[ids]
            spot = _spans(self.starts[ids], length)
            exact = np.round(np.bincount(np.repeat(np.arange(len(ids)), length), self.weights[spot] * full[self.terms[spot]], len(ids)), 9)
            full[t] = 0
            order = np.lexsort((ids, -exact))[:k]
            out.append((ids[order], exact[order]))
        return out


@dataclass
class Model:
    """``idf`` is a term's weight: inverse document frequency times relevance. ``starts``, ``numbers`` and ``counts`` hold the examples' terms."""

    terms: list[bytes]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    numbers: np.ndarray
    counts: np.ndarray
    base: float
    k: int = NEIGHBOURS
    knots: tuple = ()
    none: float = 0.0
    key: str = ""

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(found[1])) * self.idf[found[0]]
        return found[0], w / math.sqrt(w @ w) if len(w) else w

    def index(self) -> BlockMaxIndex:
        unit = np.empty(len(self.numbers))
        for a in range(0, len(self.labels), PIECE):
            cut = self.starts[a : a + PIECE + 1]
            some, length = slice(cut[0], cut[-1]), np.diff(cut)
            w = (1 + np.log(self.counts[some])) * self.idf[self.numbers[some]]
            unit[some] = w / np.repeat(np.sqrt(np.bincount(np.repeat(np.arange(len(length)), length), w * w, len(length))), length)
        return BlockMaxIndex((self.starts, self.numbers, unit), len(self.terms))

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = sims * self.weights[ids]
        return float(((w * self.labels[ids]).sum() + PRIOR * self.base) / (w.sum() + PRIOR))

    def calibrated(self, raw: float) -> float:
        xs, ys = self.knots
        return float(min(1.0, max(0.0, 0.99 * np.interp(raw, xs, ys) + 0.01 * raw))) if len(xs) else raw


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over distinct x; knots of the fitted steps."""
    at, which = np.unique(x, return_inverse=True)
    total, hits = np.bincount(which, w), np.bincount(which, w * y)
    groups: list[list[float]] = []
    for v, n, s in zip(at, total, hits, strict=True):
        groups.append([n, s / n, v, v])
        while len(groups) > 1 and groups[-2][1] >= groups[-1][1]:
            b, a = groups.pop(), groups.pop()
            groups.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2], b[3]])
    knots = sorted({(p, g[1]) for g in groups for p in (g[2], g[3])})
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def relevance(a: np.ndarray, b: np.ndarray, odds: float, base: float) -> np.ndarray:
    """Weights of terms in a toxic and b other examples: from NEUTRAL to NEUTRAL + 1, none is dropped.

    The toxic share, drawn to the rate ``base`` by SHRINK rows, on a log scale from that rate to 1. ``odds`` weighs the other
    rows to their share among all labelled rows. A term of few rows, all toxic, thus has nearly the weight of a frequent one.
    """
    share = (a + SHRINK * base) / (a + odds * b + SHRINK)
    return NEUTRAL + (np.maximum(0, np.log(share / base) / -math.log(base)) if 0 < base < 1 else 0 * share)


def runs_of(text: bytes | None) -> set[bytes]:
    """The five-word runs of a text; a shorter text is one run."""
    words = words_of(text)
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def sketch(text: bytes | None) -> list[int]:
    """Minima of four hashes of the five-word runs."""
    runs = runs_of(text)
    return [min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1 for seed in range(4)]


#: Jaccard of the five-word runs from which a row of the sample is a copy of another.
COPY = 0.8


def one_of_copies(rows: list[tuple]) -> list:
    """Ids of rows (order, label, text, id) without copies: a row goes if an earlier kept one of its label has a Jaccard of COPY or more."""
    kept: list[tuple] = []
    for _, label, text, doc_id in sorted(rows, key=lambda r: (r[0], r[1])):
        runs = runs_of(text)
        if not any(y == label and len(runs & other) >= COPY * len(runs | other) for y, other, _ in kept):
            kept.append((label, runs, doc_id))
    return [doc_id for *_, doc_id in kept]


def without_copies(train: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id of ``taken`` (doc_id, order, toxic, sketch: rows of the sample) without copies.

    Rows of a label meet where all four minima are equal, and are compared exactly there; copies that differ in a minimum
    both stay. A group holds at most the sample.
    """
    rows = train.select("doc_id", "text").join(F.broadcast(taken), "doc_id")

    kind = dict(train.dtypes)["doc_id"]

    def choose(group: pa.Table) -> pa.Table:
        every = [(r["order"], r["toxic"], (r["text"] or "").encode(), r["doc_id"]) for r in group.to_pylist()]
        return pa.table({"doc_id": pa.array(one_of_copies(every), group.schema.field("doc_id").type)})

    return rows.groupBy("toxic", "sketch").applyInArrow(choose, f"doc_id {kind}")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of the bounded sample. Rows that are held out, have a null label or conflicting labels are not used."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    taken = rows.where("toxic = 1").orderBy(*order).limit(sample[0]).union(rows.where("toxic = 0").orderBy(*order).limit(sample[1]))
    # ``taken`` is 6,000 rows of two numbers at most; of repeated doc_ids the smallest text counts, so the sample stays bounded
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def examples(rows: list, sample_bytes: int = SAMPLE_BYTES) -> list:
    """doc_ids of the sample that may be indexed: of each label in order of md5 up to ``sample_bytes`` in all."""
    taken, room = [], {0: sample_bytes // 2, 1: sample_bytes // 2}
    for r in sorted(rows, key=lambda r: (r["order"], str(r["doc_id"]))):
        if r["size"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["size"]
            taken.append(r["doc_id"])
    return taken


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Index all words of the examples, weighted by document frequency over all of ``docs`` and by relevance in the sample.

    Toxic and other examples are indexed alike, one of copies. The calibration scores each example with itself left out, by
    the same function that scores documents.
    """
    rates = {r["toxic"]: r["n"] for r in labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    train = pinned(training_rows(docs, labels, sample), "toxic-train")
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    seen = map_texts(train, ["doc_id", "toxic"], lambda: lambda texts: [[sketch(x) for x in texts], [len(x or b"") for x in texts], [not words_of(x) for x in texts]], "sketch array<long>, size long, blank boolean")
    rows = seen.select("*", F.md5(F.col("doc_id").cast("string")).alias("order")).collect()  # SAMPLE rows of some numbers at most
    room = set(examples(rows, sample_bytes))
    taken = spark.createDataFrame([(r["doc_id"], r["order"], r["toxic"], r["sketch"]) for r in rows if r["doc_id"] in room], f"doc_id {kind}, order string, toxic int, sketch array<long>")
    kept = without_copies(train, taken)
    chosen = pinned(train.join(F.broadcast(kept), "doc_id"), "toxic-examples")  # at most SAMPLE ids
    totals = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    terms: list[bytes] = []
    relevant = np.zeros(0)
    if n1 and n0:
        words = map_texts(chosen, ["toxic"], lambda: lambda texts: [[[t.decode("latin-1") for t in set(words_of(x))] for x in texts]], "terms array<string>")
        # at most the words of SAMPLE_BYTES of text
        found = words.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).toArrow().sort_by("term")
        a, n = found["a"].to_numpy().astype(float), found["n"].to_numpy().astype(float)
        terms = [t.encode("latin-1") for t in found["term"].to_pylist()]
        relevant = relevance(a, n - a, (rates[0] / n0) / (rates[1] / n1), rates[1] / (rates[0] + rates[1]))
    model = _index(docs, chosen, terms, relevant, rates, blank_rate(rows, rates))
    dropped(train, chosen)
    return model


def blank_rate(rows: list, rates: dict[int, int]) -> float:
    """Toxic share of texts without words, from the sample (copies count) and drawn to the rate of all by SHRINK rows."""
    total = sum(rates.values())
    seen = {y: sum(r["toxic"] == y for r in rows) for y in (0, 1)}
    blank = {y: rates.get(y, 0) * sum(r["blank"] for r in rows if r["toxic"] == y) / max(1, seen[y]) for y in (0, 1)}
    return (blank[1] + SHRINK * rates.get(1, 0) / total) / (blank[0] + blank[1] + SHRINK) if total else 0.0


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """Rows of ``docs`` and, of each term, in how many texts it is. Each task sends one row for each term it met."""

    def run(batches):
        m, n, df = Matcher(terms), 0, np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, texts in text_steps(batch):
                n += len(texts)
                for t in texts:
                    ids = list(map(m.place.get, set(words_of(t)), repeat(-1)))
                    df[ids] += 1
        df[-1] = n
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(df[met])], names=["i", "n"])

    got = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(terms) + 1, dtype=np.int64)
    df[got["i"].to_numpy()] = got["n"].to_numpy()
    return int(df[-1]), df[:-1]


def _index(docs: DataFrame, chosen: DataFrame, terms: list[bytes], relevant: np.ndarray, rates: dict[int, int], none_rate: float) -> Model:
    n, df = document_frequencies(docs, terms)
    idf = (np.log((1 + n) / (1 + df)) + 1) * relevant

    def counted():
        m = Matcher(terms)

        def work(texts):
            found = [m(t) for t in texts]
            return [[i.astype(np.int32).tobytes() for i, _ in found], [c.astype(np.int32).tobytes() for _, c in found]]

        return work

    rows = sorted(map_texts(chosen, ["doc_id", "toxic"], counted, "numbers binary, counts binary").collect(), key=lambda r: (str(r["doc_id"]), r["toxic"]))
    labels = np.array([r["toxic"] for r in rows], dtype=float)
    share = {y: (rates.get(y, 0) / max(1, (labels == y).sum())) for y in (0, 1)}
    scale = sum(rates.values()) / max(1, len(rows))
    weights = np.array([share[int(y)] / scale if scale else 1.0 for y in labels])
    empty = np.array([not r["numbers"] for r in rows], dtype=bool)
    # with terms the vote is pulled towards the rate of all
    all_rate = float((weights * labels).sum() / weights.sum()) if len(rows) else 0.0
    keep = np.flatnonzero(~empty)
    numbers, counts = (np.frombuffer(b"".join(r[c] for r in rows), dtype=np.int32) for c in ("numbers", "counts"))
    starts = np.concatenate([[0], np.cumsum([len(rows[i]["numbers"]) // 4 for i in keep])]).astype(np.int64)
    model = Model(terms, idf, [rows[i]["doc_id"] for i in keep], labels[keep], weights[keep], starts, numbers, counts, all_rate, none=none_rate, key=uuid.uuid4().hex)
    if len(keep):
        # the examples themselves, each without its own vote; SAMPLE rows of two numbers return
        tasks = max(1, len(keep) // (16 * TOGETHER))
        raw = {r["doc_id"]: r["score"] for r in score_documents(chosen.repartition(tasks), model).select("doc_id", "score").collect()}
        model.knots = _isotonic(np.array([raw[i] for i in model.ids]), model.labels, model.weights)
    return model


_cached: dict[str, tuple[Matcher, BlockMaxIndex, dict]] = {}


def ready(model: Model) -> tuple[Matcher, BlockMaxIndex, dict]:
    """One matcher, index and table of example ids for each Python worker, those of the last model."""
    if model.key not in _cached:
        _cached.clear()
        _cached[model.key] = Matcher(model.terms), model.index(), {d: i for i, d in enumerate(model.ids)}
    return _cached[model.key]


def scorer(shared):
    """``shared`` is a broadcast Model, which a worker unpacks once for all its tasks. A function from texts and their doc_ids to [score, evidence ids, evidence cosines]. A labelled row never votes on itself; equal texts of other rows do."""

    def make():
        model = shared.value
        m, index, place = ready(model)

        def scored(own, ids, sims):
            if own is not None:
                far = ids != own
                ids, sims = ids[far], sims[far]
            ids, sims = ids[: model.k], sims[: model.k]
            raw = model.vote(ids, sims) if len(ids) else None
            score = model.none if raw is None else model.calibrated(raw) if len(model.knots) else raw
            return score, [model.ids[i] for i in ids], sims.tolist()

        def work(texts, doc_ids):
            out = [[], [], []]
            for a in range(0, len(texts), TOGETHER):
                found = index.search_all([model.vector(m(t)) for t in texts[a : a + TOGETHER]], model.k + 1)
                for doc_id, (ids, sims) in zip(doc_ids[a : a + TOGETHER], found, strict=True):
                    for column, x in zip(out, scored(place.get(doc_id), ids, sims), strict=True):
                        column.append(x)
            return out

        return work

    return make


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Columns ``keep`` (doc_id) with score of ``column``, and evidence: ids and cosines of the labelled examples that voted.

    ``key`` of ``keep`` holds the doc_id, by which a labelled example is kept from voting on itself; it tells nothing else.
    Null and empty texts hold no term and get the rate of labelled rows without any. A model fitted without labels of both
    kinds scores every text alike. Very long texts are one query like others. One pass, no shuffle. Repeated rows each get
    their score; no rows give none.
    """
    kind = next((t for c, t in docs.dtypes if c == key), "long") if not model.ids or not isinstance(model.ids[0], str) else "string"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's words: bounded by SAMPLE_BYTES
    return map_texts(docs, keep or ["doc_id"], scorer(shared), f"score double, evidence array<{kind}>, evidence_cosine array<double>", column, also=(key,))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with the columns they came with.

    Null and empty texts have the rate of labelled texts without words, repeated rows stay or go together, an empty table
    stays empty. Without labels of both kinds all rows stay.
    """
    model = fit(docs, labels)
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])  # the text goes to Python once
    return score_documents(rows, model, list(names.values()), names["doc_id"], names["text"]).where(F.col("score") < threshold).select(*[F.col(n).alias(c) for c, n in names.items()])
