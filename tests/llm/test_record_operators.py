"""Vectors, chats, archives and the pipeline against plain versions."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogmeans.llm import chat, hnsw, warc
from fogmeans.llm.common import components


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (500, 300), (300, 400)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + [(None, 1)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 300: 300, 400: 300, 500: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    r = np.random.default_rng(1)
    base = r.normal(size=(500, 16))
    near = base[:40].repeat(3, axis=0) + 0.05 * r.normal(size=(120, 16))
    group = base[0] + 0.1 * r.normal(size=(150, 16))
    v = np.concatenate([base, near, group, base[:5].repeat(30, axis=0)]).astype(np.float32)
    return v


def test_embedding_links(spark):
    v = vectors()
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [float("inf")] + [1.0] * 15, 1), (n + 4, [], 1), (n + 5, [None] + [1.0] * 15, 1), (n + 6, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(df).collect()}
    assert len(got) == n + 7
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    want = link.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = sorted((root(int(i)), root(int(j))))
        up[b] = a
    # found links are true ones, so components are parts of the true ones; with all links found they are the same
    assert all(root(got[i]["component_id"]) == root(i) for i in range(n))
    if have.sum() == want.sum():
        assert all(got[i]["component_id"] == root(i) for i in range(n))
    assert np.mean([got[i]["component_id"] == root(i) for i in range(n)]) > 0.95
    measured = hnsw.recall(df.where(f"vec_id < {n}"), hnsw.near_duplicates(df), every=7).first()
    assert measured["queries"] == len(range(0, n, 7)) and measured["true_links"] == want[::7].sum() and measured["recall"] >= 0.9
    for i in range(n):
        assert got[i]["kept"] == (got[i]["component_id"] == i)
        assert (have[i] > 0) or got[i]["component_id"] == i
    for i in range(n, n + 7):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_null_ids_and_large_components(spark):
    rows = [(7, [1.0, 0.0]), (None, [1.0, 0.01]), (9, [1.0, 0.02]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1e200, 1e200]), (5, [1e-200, 1e-200]), (6, [-1e308, 1e308]), (8, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("least", F.lit(0))
    got = sorted(map(tuple, hnsw.near_duplicates(df).collect()), key=str)
    want = [(7, 2, 7, True), (None, 2, 7, False), (9, 2, 7, False), (None, 1, None, True), (None, 1, None, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (8, 1, 6, False)]
    assert got == sorted(want, key=str)
    texts = hnsw.near_duplicates(df.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))).collect()
    assert {r["vec_id"]: r["component_id"] for r in texts}["v9"] == "v7"
    # cosine of exactly the limit links, the next number below doesn't
    edge = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in hnsw.near_duplicates(edge, 0.6).collect()] == [1, 1]
    assert [r["n_links"] for r in hnsw.near_duplicates(edge, float(np.nextafter(0.6, 1))).collect()] == [0, 0]


def test_hot_keys_are_dealt_without_loss(spark, monkeypatch):
    from fogmeans.llm import common

    rows = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("key"), F.col("id").alias("by"))
    names = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("name of "), "key"))
    want = sorted(map(tuple, rows.join(names, "key").select("key", "by", "name").collect()))
    monkeypatch.setattr(common, "HOT", 60)
    assert sorted(map(tuple, common.spread_join(rows, names, "key", "n", "by").select("key", "by", "name").collect())) == want
    star = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{1000 + i: 1000 for i in range(101)}}


def test_graph_recall():
    v = np.random.default_rng(2).normal(size=(3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(v)
    ids, _ = g.search(v[:300], 64)
    true = np.argsort(-(v[:300] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9


class Lossy(hnsw.Graph):
    """A graph that loses the rows ``lost`` below a beam of 192."""

    def __init__(self, x, lost):
        super().__init__(x, [])
        self.lost = lost

    def search(self, q, beam):
        s = q @ self.x.T
        if beam < 192:
            s[:, self.lost] = -1
        ids = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        return ids, np.take_along_axis(s, ids, 1)


@pytest.mark.parametrize("own", [False, True])
def test_audit_sees_rare_links(own):
    r = np.random.default_rng(3)
    unit = lambda v: (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    # 3 % of the queries have one link, every second of them is lost; one group has very many links that are all found
    x = unit(r.normal(size=(600, 64)))
    near = unit(x[:120] + 0.01 * r.normal(size=(120, 64)))
    group = unit(x[200] + 0.01 * r.normal(size=(20, 64)))
    q = np.concatenate([x, near, group]) if own else np.concatenate([near, group, unit(r.normal(size=(3860, 64)))])
    rows = q if own else np.concatenate([x, group])
    g = Lossy(rows, np.arange(0, 120, 2))
    qi, ri = hnsw.links_of(g, q, 0.9, own=own)
    truth = q @ rows.T >= 0.9
    assert len(qi) >= 0.95 * truth.sum()
    single = np.flatnonzero(truth.sum(axis=1) == (2 if own else 1))
    assert np.isin(single, qi[qi != ri] if own else qi).mean() >= 0.95


def test_recall_on_a_whole_shard():
    r = np.random.default_rng(4)
    x = r.normal(size=(hnsw.SHARD, 32))
    x[:300] = x[300:600] + 0.03 * r.normal(size=(300, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    qi, ri = hnsw.links_of(hnsw.Graph(x), x[:4096], 0.9)
    want = [(a + i, b) for a in range(0, 4096, 512) for i, b in zip(*np.nonzero(x[a : a + 512] @ x.T >= 0.9), strict=True) if a + i != b]
    have = set(zip(qi.tolist(), ri.tolist(), strict=True))
    assert len(want) >= 600 and sum(p in have for p in want) >= 0.9 * len(want)


def test_chat(spark):
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "tool", result("a", {"z": 1, "b": 2})),
        (1, 2, "assistant", call(("b", "fetch", {"url": {"$ref": "a"}, "method": "PUT"}), ("a", "search", {"query": "q", "limit": 2}))),
        (1, 3, "tool", result("b", "ok")),
        (1, 4, "tool", result("zz", "lost")),
        (2, 0, "assistant", call(("a", "search", {"limit": "x"}))),
        (3, 0, "assistant", call(("p", "nosuch", {"r": {"$ref": "q"}}), ("q", "calculate", {"expression": {"$ref": "p"}}))),
        (4, 0, None, None),
        (4, 1, "user", "{broken"),
        (4, 1, "user", "{broken"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert json.loads(got[1, 0]["json"]) == {"content": 'say "hi"\n', "role": "user"}
    assert got[1, 1]["place"] == 2 and got[1, 1]["rank"] == 1 and got[1, 1]["linked"]
    assert got[1, 1]["json"] == '{"content":{"b":2,"z":1},"role":"tool","tool_call_id":"a"}'
    assert [c["id"] for c in json.loads(got[1, 2]["json"])["tool_calls"]] == ["a", "b"] and got[1, 2]["linked"]
    assert not got[1, 2]["valid"] and got[1, 2]["errors"] == "b $.method: not in enum"
    assert got[1, 3]["rank"] == 2 and not got[1, 4]["linked"]
    assert not got[2, 0]["linked"] and got[2, 0]["errors"] == "a $.query: missing; a $.limit: not of type integer"
    assert json.loads(got[3, 0]["json"])["role"] == "assistant" and "p $: unknown tool" in got[3, 0]["errors"]
    assert json.loads(got[4, 0]["json"]) == {"content": "", "role": None}
    for r in out:
        assert r["json"] == chat.canonical(json.loads(r["json"]))
    assert chat.format_chat(df.where("false")).count() == 0


def test_warc_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
    rows = [(1, "http://a/", long), (5, None, long), (3, "http://c/\r\nx", long), (7, "http://d/", "short"), (8, "http://e/", "short"), (9, "http://f/", None), (10, "u", ""), (11, "u", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for page, url, html in rows:
        raw = (html or "").encode()
        r = got[page]
        revisit = page in (1, 3)
        assert r["response"]["type"] == ("revisit" if revisit else "response") and r["refers_to_page"] == (5 if revisit else None)
        assert r["response"]["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["metadata"]["payload_bytes"] == len(raw)
        assert revisit or bytes(r["response"]["payload"]) == raw
        assert r["url"] == (url or "").replace("\r\n", "") and r["request"]["uri"] == r["url"]
    # rows equal in everything are captures of their own
    twice = warc.round_trip(df.union(df).union(df.where("false"))).collect()
    assert sorted(r["page_id"] for r in twice) == sorted([r[0] for r in rows] * 2) and len({r["record_id"] for r in twice}) == 2 * len(rows)
    assert all((r["refers_to_page"] == 5) == (r["page_id"] in (1, 3)) for r in twice)
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_keeps_rows_of_other_urls(spark):
    long = "<p>x</p>" * 200
    rows = [(1, "http://a/", "short"), (1, "http://b/", "short"), (None, "http://c/", None), (None, "http://d/", None), (None, None, None), (None, "", None)]
    rows += [(3, "http://e/", long), (3, "http://f/", long), (2, "http://g/", long), (2, "http://h/", long)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(p, u or "", len(h or ""), "revisit" if p == 2 else "response", 3 if p == 2 else None) for p, u, h in rows]
    have = [(r["page_id"], r["url"], r["metadata"]["payload_bytes"], r["response"]["type"], r["refers_to_page"]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str) and len({r["record_id"] for r in got}) == len(rows)


def test_warc_sizes_repeats_and_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 4)
    big = "x" * (warc.LARGE + 1)
    rows = [("a", "u", "same")] * 11 + [("b", "u", big), ("c", "u", big), (None, "u", big)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    have = sorted(((r["page_id"], r["metadata"]["payload_bytes"], r["response"]["type"], r["refers_to_page"]) for r in got), key=str)
    want = [("a", 4, "response", None)] * 11 + [("b", len(big), "revisit", "c"), ("c", len(big), "response", None), (None, len(big), "revisit", "c")]
    assert have == sorted(want, key=str) and len({r["record_id"] for r in got}) == len(rows)


def test_warc_members_can_be_sought(spark, tmp_path):
    import glob
    import zlib

    rows = [(i, f"http://a/{i}", "<p>é</p>" * i) for i in range(40)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    records = 0
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        with open(name, "rb") as f:
            raw = f.read()
        while raw:
            d = zlib.decompressobj(31)
            text, raw = d.decompress(raw), d.unused_data
            if text:
                assert text.startswith(b"WARC/1.1\r\n") and len(list(warc.parse_file(text))) == 1
                records += 1
    assert records == 3 * len(rows)
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/plain", compression="none")
    assert warc.captures(warc.read(spark, f"{tmp_path}/plain")).count() == len(rows)
    # archives of others: members without separators, one stream, damage after a good record
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for raw in (one * 3, gzip.compress(one * 3), gzip.compress(one) * 3, gzip.compress(one) + warc.EMPTY + gzip.compress(one) * 2, gzip.compress(one[:20]) + gzip.compress(one[20:] + one * 2)):
        assert [r["type"] for r in warc.parse_file(raw)] == ["request"] * 3
    with pytest.raises(Exception):  # noqa: B017
        list(warc.parse_file(gzip.compress(one) + warc.EMPTY + gzip.compress(one)[:-9]))


def test_warc_reader_rejects_damage():
    with pytest.raises(ValueError):
        list(warc.parse_file(b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 99\r\n\r\nshort"))


def test_pipeline(spark, tmp_path):
    import re

    import corpus_pipeline
    from tests.llm.test_text_operators import closed, fingerprint, quality_row

    words = "stone river cloud grass window table garden bridge letter morning evening winter summer market harbor island valley forest desert canyon".split()
    r = np.random.default_rng(8)
    rows = []
    for i in range(120):
        t = " ".join(r.choice(words, 60))
        if i % 6 == 5:
            t = t + " scoundrel wretch scoundrel"
        rows.append((i, t if i % 10 else None, "en", f"s{i % 3}", 10))
    rows += [(200 + i, rows[i + 1][1], "en", "s0", 10) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 5)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = [x for x in rows if "scoundrel" not in (x[1] or "")]
    assert {x["doc_id"] for x in corpus_pipeline.not_toxic(spark, docs, str(tmp_path)).collect()} == {x[0] for x in clean} and len(clean) < len(rows) - 15
    good = [x for x in clean if quality_row(x[1])[0] >= 20 and 100 * quality_row(x[1])[4] <= 30 * quality_row(x[1])[0]]
    fps = [fingerprint(x[1]) for x in good]
    up = closed(len(good), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    kept = [x for i, x in enumerate(good) if up[i] == i]
    n = {s: sum(x[3] == s for x in kept) for s in {x[3] for x in kept}}
    from math import exp, factorial

    want = []
    for x in kept:
        u = int(hashlib.md5(f"mix-1|{x[0]}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, c = len(kept) / len(n) / n[x[3]], 0, 0.0
        while (c := c + exp(-rate) * rate**k / factorial(k)) <= u:
            k += 1
        want += [(x[0], hashlib.sha256(x[1].encode()).hexdigest())] * k
    assert sorted((g["doc_id"], g["decoded_sha256"]) for g in got) == sorted(want)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
    assert re.fullmatch("[0-9a-f]{64}", got[0]["ids_sha256"])


def test_vector_sql(spark, tmp_path):
    import duckdb

    v = vectors()
    spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(hnsw.SQL).fetchall()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect()}
    assert set(got) == set(want) and sum(w[0] for w in want.values()) > 20_000
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values()) and np.mean([got[i] == want[i] for i in want]) > 0.9


def test_warc_ids_of_any_text(spark):
    """Line breaks, colons, percent signs and blanks in page_ids come back as they were, from heads and from whole records."""
    ids = ["a\nb", "c\r\nd", "x: y", "100%0A", "%", "", " lead", "WARC/1.1\r\n\r\n", None]
    big = "<p>" + "same " * 400
    rows = [(p, f"http://h/{i}", big if i % 2 else f"<p>{i}") for i, p in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    for payloads in (False, True):
        got = warc.round_trip(pages, payloads).collect()
        assert sorted((r["page_id"] is None, r["page_id"] or "", r["url"]) for r in got) == sorted((p is None, p or "", u) for p, u, _ in rows)
        keeper = max(p for i, p in enumerate(ids) if i % 2 and p is not None)
        assert {r["refers_to_page"] for r in got if r["response"]["type"] == "revisit"} == {keeper}
    assert warc.round_trip(pages.limit(0), False).count() == 0
