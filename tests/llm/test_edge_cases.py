"""Every operator on empty tables, nulls in any column, repeated rows, ties and extra columns with clashing names."""

import pytest
import tiktoken
from pyspark.sql import functions as F

from fogmeans.llm import bpe, chat, counting, hnsw, license, mixing, quality, simhash, toxicity, warc

from tests.llm.test_text_operators import fingerprint, quality_row

LONG = "a long line of words that goes on and on under the mit license today\n" * 3000
TEXT = "stone river cloud grass window table garden bridge letter morning evening winter summer market harbor island valley forest desert canyon meadow"
#: Names that operators use themselves.
CLASH = ("score", "fp", "hash", "m", "n", "group", "component_id", "failure_bits", "kept", "mix_copy", "ids", "__c0", "__k0", "__id", "first", "cdf", "tile")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en", "a", 5), (1, TEXT, "en", "a", 5), (1, LONG, "en", "a", 5), (2, TEXT, None, "b", None), (None, TEXT + " end", "en", None, 1)]
    rows += [(None, None, None, None, None)] * 2 + [(3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, "alpha beta gamma delta " * 30, "en", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (3, None, 0), (4, 0, None), (None, None, None)], "doc_id long, quality int, toxic int")


def whole(before, after):
    """``after`` has the columns of ``before``, with their own values."""
    assert after.columns == before.columns
    for r in after.collect():
        assert all(r[c] == f"own {c}" for c in CLASH)


def test_row_operators(docs, labels):
    n = docs.count()
    makers = {
        "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(d, labels)),
        "quality": quality.quality,
        "license": license.scan_documents,
        "bpe": bpe.digests,
        "counts": lambda d: counting.count_edited(d, counting.revision_edits()),
        "simhash": simhash.near_duplicates,
    }
    out = {}
    for name, make in makers.items():
        out[name] = make(docs).collect()
        assert len(out[name]) == n, name
        assert make(docs.where("false")).count() == 0, name
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]

    def same(name, cols, want):
        assert sorted((tuple(r[c] for c in cols) for r in out[name]), key=str) == sorted(((i, *want(t)) for i, t in rows), key=str), name

    same("quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], quality_row)
    same("simhash", ["doc_id", "fingerprint"], lambda t: (f"{fingerprint(t):016x}",))
    scan = license.Scanner().scan
    licences = lambda t: (lambda g: (g["n_words"], len(g["starts"]), ",".join(sorted(g["labels"])), g["score"]))(scan((t or "").encode()))
    same("license", ["doc_id", "n_words", "n_base", "labels", "score"], licences)
    assert {(r["n_base"], r["base_labels"], r["score"]) for r in out["license"] if r["n_words"] > 1000} == {(3000, "mit", 1.0)}
    path, pattern = bpe.default_ranks()
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.coder(path, pattern).ranks, special_tokens={})
    tokens = {t: len(plain.encode_ordinary(t or "")) for _, t in rows}
    same("bpe", ["doc_id", "n_tokens"], lambda t: (tokens[t],))
    same("counts", ["doc_id", "n_tokens"], lambda t: (tokens[t],))
    # equal texts score alike whatever their other columns; texts without words alike too; nothing is outside 0 and 1
    by_id = {}
    for r in out["toxicity"]:
        by_id.setdefault(r["doc_id"], set()).add(round(r["score"], 12))
        assert 0 <= r["score"] <= 1
    assert by_id[3] == by_id[4] and by_id[2] <= by_id[1]


def test_filters_keep_columns(docs, labels):
    whole(docs, toxicity.reject_toxic(docs, labels))
    assert toxicity.reject_toxic(docs, labels.where("false")).count() == docs.count()
    good = quality.keep_good(docs)
    whole(docs, good)
    assert {(r["doc_id"], len(r["text"])) for r in good.collect()} == {(1, len(TEXT)), (2, len(TEXT)), (None, len(TEXT) + 4)}
    mix = mixing.mixed(docs)
    whole(docs, mix)
    assert mixing.replicate(docs).columns == [c for c in docs.columns if c != "mix_copy"] + ["mix_copy", "mix_rate", "mix_key"]


def test_one_row_of_each_component(docs, spark):
    kept = simhash.keep_first(docs)
    whole(docs, kept)
    # TEXT and its near copy are one group, its repeated row stays once; LONG has the same id in a group of its own
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(r["text"] or "")) for r in kept.collect())
    assert have == [(1, len(TEXT)), (1, len(LONG)), (3, 0), (5, len("alpha beta gamma delta " * 30))]
    alone = spark.createDataFrame([(None, "x"), (None, "x"), (None, None)], "doc_id long, text string")
    assert sorted(r["text"] or "" for r in simhash.keep_first(alone).collect()) == ["", "x"]
    assert simhash.keep_first(docs.where("false")).count() == 0


def test_repeated_training_rows_stay_bounded(docs, labels):
    rows = toxicity.training_rows(docs.union(docs), labels).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) and all(r["doc_id"] in (1, 2, 3) for r in rows)


def test_chat_nulls(spark):
    call = '{"tool_calls":[{"id":"c","name":"search","arguments":{"query":"q"}}]}'
    rows = [(None, 1, "assistant", call), (None, 2, "tool", '{"tool_call_id":"c"}'), (1, None, "assistant", call), (1, 2, None, None), (2, 1, "user", ""), (2, 1, "user", ""), (3, 1, "assistant", call), (3, 2, "tool", '{"tool_call_id":"c"}')]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("calls", F.lit(1)).withColumn("level", F.lit(2))
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    assert {(r["turn"], r["linked"]) for r in got if r["conv_id"] == 3} == {(1, True), (2, True)}
    assert all(r["linked"] in (None, False) for r in got if r["conv_id"] is None)
    assert chat.format_chat(df.where("false")).count() == 0


def test_vectors_and_pages(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.01], 2), (4, [0.0, 1.0], None), (5, None, None)], "vec_id long, embedding array<float>, label int")
    v = v.withColumns({c: F.lit(1) for c in ("rep", "copies", "shard", "dim", "peer", "links")})
    got = sorted(map(tuple, hnsw.near_duplicates(v).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)], key=str)
    p = spark.createDataFrame([(1, None, None), (2, "u\r\nx", "é" * 600), (3, "u", "é" * 600), (4, "u", "")], "page_id long, url string, html string").withColumn("body", F.lit(1)).withColumn("dig", F.lit(2))
    got = {r["page_id"]: (r["response"]["type"], r["refers_to_page"], r["metadata"]["payload_bytes"]) for r in warc.round_trip(p).collect()}
    assert got == {1: ("response", None, 0), 2: ("revisit", 3, 1200), 3: ("response", None, 1200), 4: ("response", None, 0)}
    assert warc.round_trip(p.where("false")).count() == 0
