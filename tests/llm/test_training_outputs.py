"""Id files, hard negatives and fill-in-the-middle against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from fogmeans.llm import fim, idcoder, negatives, tokenfile
from fogmeans.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, value string, hash string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfile.default_vocabulary())


# --- token ids in files ---------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=900), st.integers(1, 300))
def test_blocks_come_back(ids, block):
    flat = np.array(ids, dtype=np.int64)
    shares = idcoder.Shares.of(flat[: len(flat) // 2])  # the other ids are written out
    sizes, sums, words = idcoder.encode(flat, shares, block)
    got = idcoder.decode(sizes, sums, words, shares)
    assert [x for b in got for x in b.tolist()] == ids and len(got) == -(-len(ids) // block)
    for i in range(len(got)):  # a block needs no other
        alone = idcoder.decode(sizes[[i]], sums[[i]], [words[i]], shares)
        assert alone[0].tolist() == got[i].tolist()


def test_blocks_learn_and_are_checked():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 49_000, 40)
    ids = np.tile(phrase, 100)
    shares = idcoder.Shares.of(ids)
    sizes, sums, words = idcoder.encode(ids, shares, 4000)
    assert sum(map(len, words)) * 16 < 2.5 * len(ids)  # order 1 and 2 know the rest: raw ids take 16 bits
    broken = [w.copy() for w in words]
    broken[0][len(broken[0]) // 2] ^= 64
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode(sizes, sums, broken, shares)
    assert idcoder.decode(*idcoder.encode(np.zeros(0, np.int64), shares), shares) == []


def test_sections_are_checked():
    docs = [np.array([5, 6, 2]), np.array([2]), np.arange(40_000) % 70_000]
    raw = tokenfile.pack(3, 1, ["a", None, "c"], docs) + b"\n"
    (place, back), (_, again) = tokenfile.unpack(raw + raw)
    assert (place["part"], place["section"], place["docs"]) == (3, 1, ["a", None, "c"])
    assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(docs, back, again, strict=True))
    large = np.array([2**28 - 1, 3, 2**21, 3, 2**28 - 1])
    assert next(tokenfile.unpack(tokenfile.pack(0, 0, ["a"], [large]) + b"\n"))[1][0].tolist() == large.tolist()
    with pytest.raises(ValueError):
        tokenfile.pack(0, 0, ["a"], [large + 1])
    for bad in (raw[:-9], raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], b"x" + raw):
        with pytest.raises(ValueError):
            list(tokenfile.unpack(bad))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\x0b\x0c\x1c\x85\xa0̸́Σσ'sIİ<|>")), max_size=60), max_size=4))
def test_chunks_are_the_library(library, texts):
    coder = tokenfile.encoder(tokenfile.default_vocabulary())
    assert [i.tolist() for i in coder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_with_special_strings_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(tokenfile, "REMEMBERED", 3)
    coder = tokenfile.ChunkEncoder(tokenfile.default_vocabulary())
    for texts in (["a <|endoftext|> b<|startoftext|>c", "x" * 500 + " y"], ["one two three four five"], ["six one " + "z" * 100], [""]):
        assert [i.tolist() for i in coder.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(c) <= tokenfile.LONGEST for c in coder.known)


def test_id_files_of_documents(spark, library, tmp_path):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in tokenfile.round_trip(docs).collect()}
    at, rows = 0, sorted(docs.select("doc_id", "text").collect())
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        found = got[r["doc_id"]]
        assert (found["start"], found["n_tokens"], found["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)
    # many tasks, sections and files, with the ids themselves
    path = f"file://{tmp_path}/ids"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    tokenfile.write(docs, path, task_bytes=60_000, section_ids=3000)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = tokenfile.starts(tokenfile.read(spark, path)).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [r["doc_id"] for r in rows]
    assert [r["start"] for r in back] == [got[r["doc_id"]]["start"] for r in rows]
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in back)
    assert len({r["part"] for r in back}) > 3 and max(r["section"] for r in back) > 0


def test_id_files_of_odd_rows(spark):
    long_text = "Word " * 30_000
    rows = [(None, "null id"), (3, None), (3, ""), (1, "same"), (1, "same"), (2, long_text), (9, "  \n ")]
    got = tokenfile.round_trip(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 3, 9]
    assert [r["n_tokens"] for r in got] == [3, 2, 2, 30_001, 1, 1, 1]
    assert [r["start"] for r in got] == [0, 3, 5, 7, 30_008, 30_009, 30_010]
    assert tokenfile.round_trip(spark.createDataFrame([], DOCS)).count() == 0
    names = tokenfile.round_trip(spark.createDataFrame([("b\nc", "x"), ("a", "y")], "doc_id string, text string")).orderBy("start").collect()
    assert [r["doc_id"] for r in names] == ["a", "b\nc"]


# --- hard negatives -------------------------------------------------------------------------------------------------------
def plain_negatives(rows, anchors, k=5, m=3):
    out = set()
    for a, y, x in rows:
        if not anchors(a):
            continue
        scored = sorted((-int(np.dot(x, z)), b, c) for b, c, z in rows if b != a)
        for s, p, _ in [r for r in scored if r[2] == y][:k]:
            fit = [r for r in scored if r[2] != y and -50 * s <= -100 * r[0] <= -95 * s][:m]
            out |= {(a, p, i + 1, b, -s, -t) for i, (t, b, _) in enumerate(fit)}
    return out


@pytest.mark.parametrize("n,dim,labels,shard,block", [(900, 8, 3, 200, 7), (700, 2, 2, 64, 1000), (400, 16, 1, 8192, 1000)])
def test_negatives_by_brute_force(spark, n, dim, labels, shard, block, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives.build_trees, "__defaults__", (shard,))
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)).round(1)
    x[: n // 3] = x[0]  # one vector on a third of the rows
    y = rng.integers(0, labels, n)
    y[: n // 2] = 0
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "vec_id long, embedding array<double>, label int")
    from pyspark.sql import functions as F

    got = negatives.mine(rows, F.col("vec_id") % 20 == 0, block=block).collect()
    want = plain_negatives([(i, int(y[i]), np.floor(256 * x[i]).astype(int)) for i in range(n)], lambda i: i % 20 == 0)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert (labels == 1) == (not want)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 6)) * 2000
    x = (centers[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 6)) * 30).astype(int)
    t = negatives.BallTree(np.arange(6000), x)
    for level in range(t.depth + 1):
        for i, (a, b) in enumerate(t.spans(level)):
            node = (1 << level) - 1 + i
            assert np.sqrt(((t.x[a:b] - t.centers[node]) ** 2).sum(axis=1)).max() <= t.radii[node] + 1e-6
    q = x[:40].astype(float)
    exact = q @ t.x.T
    low = np.sort(exact, axis=1)[:, 3000]
    best = negatives.Best(np.arange(40), low, low + 5000, np.full(40, -1), 3, 40)
    seen = []
    offer = best.offer
    best.offer = lambda whom, s, ids: (seen.append(len(whom) * len(ids)), offer(whom, s, ids))
    t.search(q, best, np.arange(40))
    assert sum(seen) < 0.4 * 40 * 6000  # of all pairs
    for i in range(40):
        fit = sorted((-s, d) for s, d in zip(exact[i], t.ids, strict=True) if low[i] <= s <= low[i] + 5000)[:3]
        assert [(-s, d) for s, d in zip(best.score[i], best.id[i], strict=True) if np.isfinite(s)] == fit


def test_negatives_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9], 2), (4, None, 2), (5, [0.9, None], 2), (6, [nan, 1.0], 2), (8, [inf, 0.0], 2), (9, [0.9, 0.0], None), (None, [0.9, 0.0], 2), (10, [], 2), (11, [1e300, -1e300], 3)]
    made = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, label int, score string, id string")
    got = sorted(tuple(r) for r in negatives.contract(made).collect())
    assert got == [(0, 1, 1, 2, 65536, 256 * 230), (0, 1, 2, 3, 65536, 256 * 230)]
    assert negatives.contract(made.limit(0)).count() == 0


# --- fill in the middle ---------------------------------------------------------------------------------------------------
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text):
    text, key = text or "", "" if doc_id is None else str(doc_id)
    units = UNIT.findall(text)
    h = [int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_by_plain_version(spark):
    rng = random.Random(4)
    pieces = [" ", "\n", "\t\v", "a", "wort", "é", "漢字", "😀", "<", "<P", "S>", "\x85", "\xa0", "\x1c", "<P>"]
    rows = [(i, "".join(rng.choices(pieces[:-1] if i % 9 else pieces, k=rng.randint(0, 30)))) for i in range(900)]
    rows += [(None, "no id at all"), (5000, None), (5001, ""), (7, rows[7][1]), (5002, "lang und weit " * 20_000)]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, n string, form string, output string").repartition(3)
    got = fim.transform(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(d, *plain_fim(d, t)) for d, t in rows], key=key)
    texts = {d: t or "" for d, t in rows}
    assert all(r["back"] == texts[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.digests(docs.limit(0)).count() == 0


def test_fim_digests(spark):
    for r in fim.digests(table(spark, SF, "documents")).join(table(spark, SF, "documents"), "doc_id").collect():
        n, form, p, m, out = plain_fim(r["doc_id"], r["text"])
        hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (out, r["text"] or "")]
        assert [r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]] == [n, form, p, m, *hashed]


def test_long_vectors_in_groups_of_shards(spark):
    """1,024 dimensions, shards in groups of two: links, components and copies as brute force finds them."""
    from fogmeans.llm import hnsw

    rng = np.random.default_rng(9)
    x = rng.normal(size=(260, 1024))
    for i in range(0, 60, 3):
        x[i + 1], x[i + 2] = x[i] + 0.01 * rng.normal(size=1024), x[i]
    x[200:230] = x[200]
    x[231] = -0.0 * x[231]
    rows = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(rows, shards=48).collect()}
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), where=np.abs(x).sum(axis=1, keepdims=True) > 0, out=np.zeros_like(x))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for i in range(260):
        group, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in group:
                    group.add(int(j))
                    todo.append(int(j))
        assert got[i] == (near[i].sum(), min(group), min(group) == i)
