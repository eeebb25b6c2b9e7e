"""Text operators of fogmeans.llm against plain versions on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from fogmeans.llm import bpe, counting, license, mixing, quality, simhash, toxicity

WORDS = "the of and ring stone river mit license apache version 2 under cc by nc über straße idiot".split()


def texts(n=60, seed=3):
    r = random.Random(seed)
    out = [None, "", "   \n\t", "a", "I'll  go!!  'tis x", "\x1c\x1d ab\x1ccd", "日本語のテキスト" * 40, "x" * 9000, " " * 5000, "ab \n" * 3000]
    for _ in range(n):
        out.append("\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8))))
    return out + out[12:20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", ["hot", "b", None][0 if i % 3 else (i % 2) + 1], len(t or ""), 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, m int")


def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def plain():
    path, pattern = bpe.default_ranks()
    c = bpe.TreeBpe(path, pattern)
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe_equals_the_library(plain):
    path, pattern = bpe.default_ranks()
    r = random.Random(1)
    for leaf, piece in ((8, 4), (64, 16), (4096, 2048)):
        c = bpe.TreeBpe(path, pattern, leaf, piece)
        for t in texts(20):
            t = t or ""
            ids = c.encode(t)
            assert ids == plain.encode_ordinary(t)
            assert c.decode(ids) == t.encode()
        for _ in range(60):
            t = "".join(r.choice(["a", "é", " ", "\n", "'s", "'ll", "12", "!", "漢", "the ", " ", " ", "\x1c", "ing "]) for _ in range(r.randint(0, 300)))
            assert c.encode(t) == plain.encode_ordinary(t)


def test_bpe_long_pieces(plain):
    path, pattern = bpe.default_ranks()
    c = bpe.TreeBpe(path, pattern, 64, 8)
    r = random.Random(2)
    for n in (9, 100, 3000):
        raw = bytes(r.choice(b"abcdefgthein") for _ in range(n))
        assert c.encode_piece(raw) == plain._encode_single_piece(raw)


def test_bpe_digests(docs, plain):
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert len(got) == docs.count()
    for i, t in enumerate(texts()):
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty(docs)).count() == 0
    one = bpe.encode_documents(docs.where("doc_id = 1")).collect()[0]
    assert one["ids"] == [] and bytes(one["decoded"]) == b""


def test_token_tree_equals_recount(plain):
    count = lambda t: len(plain.encode_ordinary(t))
    r = random.Random(4)
    for t in texts(15):
        t = (t or "")[:4000]
        tree = counting.TokenTree(t, count, block=16)
        for _ in range(25):
            pos, dele = r.randint(0, len(t) + 3), r.choice([0, 1, 5, 200])
            ins = r.choice(["", "x", " new words here", "a b c d e f " * 10, "\n"])
            p = min(pos, len(t))
            t = t[:p] + ins + t[p + dele :]
            tree.edit(pos, dele, ins)
            assert tree.text == t and tree.total == count(t)


def test_count_edited(docs, plain):
    rows = counting.count_edited(docs, counting.revision_edits()).collect()
    assert len(rows) == docs.count() and all(r["n_edits"] == 3 for r in rows)
    edits = {r["doc_id"]: r["e"] for r in docs.select("doc_id", counting.revision_edits().alias("e")).collect()}
    for r in rows:
        t = texts()[r["doc_id"]] or ""
        assert r["n_tokens"] == len(plain.encode_ordinary(t))
        for e in edits[r["doc_id"]]:
            at = min(e["pos"], len(t))
            t = t[:at] + e["ins"] + t[at + e["del"] :]
        assert r["n_tokens_edited"] == len(plain.encode_ordinary(t))
        # an edit re-encodes no more than the text, and far less of a long one that has places to cut at
        assert 0 < r["n_chars_reencoded"] <= 3 * (len(t) + 60)
    long = " ".join(f"word{i}" for i in range(20_000))
    one = counting.count_edited(docs.limit(1).select(F.lit(1).alias("doc_id"), F.lit(long).alias("text")), counting.revision_edits()).collect()[0]
    assert one["n_chars_reencoded"] < 12 * counting.BLOCK
    none = counting.count_edited(docs, F.lit(None).cast("array<struct<pos: long, del: long, ins: string>>")).collect()
    assert all(r["n_tokens"] == r["n_tokens_edited"] and r["n_edits"] == 0 for r in none)
    assert counting.count_edited(empty(docs), counting.revision_edits()).count() == 0


def test_count_table(spark, plain):
    r = random.Random(7)
    base = [(1, "the quick brown fox " * 50), (1, "another text of the same id"), (2, None), (3, "ab"), (None, "no id"), (4, "")]
    edits = [(r.choice([1, 1, 1, 2, 3, 4, 9, None]), r.randint(0, 30), r.choice([None, *range(0, 900, 7)]), r.choice([None, 0, 3, 50]), r.choice([None, "", "new words ", "x"])) for _ in range(300)]
    docs = spark.createDataFrame(base, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("seq", F.lit(2))
    table = spark.createDataFrame(edits, "doc_id long, seq int, pos int, del int, ins string").withColumn("text", F.lit("own"))
    got = counting.count_table(docs, table.repartition(3)).collect()
    want = []
    least = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  nulls come first
    for i, t in base:
        t, n = t or "", 0
        before = len(plain.encode_ordinary(t))
        for _, _, pos, delete, ins in sorted((e for e in edits if e[0] == i and i is not None and e[2] is not None), key=lambda e: (e[1], e[2], least(e[3]), (e[4] is not None, e[4] or ""))):
            at = min(pos, len(t))
            t, n = t[:at] + (ins or "") + t[at + (delete or 0) :], n + 1
        want.append((i, before, n, len(plain.encode_ordinary(t))))
    assert sorted((tuple(g)[:4] for g in got), key=str) == sorted(want, key=str)
    assert counting.count_table(docs.where("false"), table).count() == 0 and counting.count_table(docs, table.where("false")).count() == len(base)


def quality_row(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def test_quality(docs, spark):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t in enumerate(texts()):
        n, chars, symbols, dup, rep = quality_row(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert r["kept"] == (r["failure_bits"] == 0)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    book = quality.ledger(docs)
    for r in quality.ablations(book).collect():
        bit = 1 << quality.RULES.index(r["rule"])
        assert r["n_failed"] == sum(bool(g["failure_bits"] & bit) for g in got.values())
        assert r["n_kept_without"] == sum(g["failure_bits"] & ~bit == 0 for g in got.values())
    assert quality.quality(empty(docs)).count() == 0


def fingerprint(t):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(n, linked):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def test_simhash(docs, spark):
    base = texts()
    fps = [fingerprint(t) for t in base]
    up = closed(len(base), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    for i in range(len(base)):
        assert got[i]["fingerprint"] == f"{fps[i]:016x}" and got[i]["component_id"] == up[i]
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == set(up)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_tile_links_on_chains(spark):
    r = random.Random(9)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            fps.append(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
    fps = sorted(set(fps))
    up = closed(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from fogmeans.llm.common import components

    comp = {r["node"]: r["component"] for r in components(simhash.tile_links(df, tile=50, least=3)).collect()}
    mine = [comp.get(x, x) for x in signed]
    assert all((mine[i] == mine[j]) == (up[i] == up[j]) for i in range(len(fps)) for j in range(i))


def best_match(tpl, keys, words):
    """Largest share of ``tpl`` found in order in any stretch of ``words`` that holds the key phrases; 0 below the least share."""
    best = 0.0
    for s in range(-len(tpl) - license.BAND, len(words)):
        stretch = words[max(0, s) : max(0, s + len(tpl) + license.BAND)]
        if not all(f" {k} " in f" {' '.join(stretch)} " for k in keys):
            continue
        # longest common subsequence with word j at s + j to s + j + BAND, by the whole table
        row = [0] * (len(words) + 1)
        for j, t in enumerate(tpl):
            new = [0] * (len(words) + 1)
            for p in range(len(words)):
                hit = row[p] + 1 if words[p] == t and s + j <= p <= s + j + license.BAND else 0
                new[p + 1] = max(row[p + 1], new[p], hit)
            row = new
        if row[-1] >= license.COVER * len(tpl) - 1e-9:
            best = max(best, row[-1] / len(tpl))
    return best


def scanned(text):
    found = license.Scanner().scan(text.encode())
    return ",".join(sorted(found["labels"])), found["score"]


def test_license_edits():
    mit = next(t for label, t, _ in license.TEMPLATES if label == "mit" and len(t.split()) > 40).split()
    assert scanned(" ".join(mit)) == ("mit", 1.0)
    # words put in, left out or changed in the middle
    for changed in ([*mit[:30], "really", "truly", *mit[30:]], [*mit[:30], *mit[33:]], [*mit[:30], "x", "y", *mit[32:]]):
        labels, score = scanned("some words before " + " ".join(changed) + " and after")
        assert labels == "mit" and 0.9 < score
    assert scanned(" ".join(mit[::2]))[0] == ""
    # a key phrase elsewhere in the file does not make a match another licence
    gpl = "licensed under the gnu general public license version 3"
    assert scanned(f"{gpl} {'filler ' * 30} see the gnu general public license version 2 too")[0] == "gpl-3"
    assert scanned("the gnu general public license version 2")[0] in ("", "gpl-2")


def test_license_random_edits():
    r = random.Random(12)
    s = license.Scanner()
    for _ in range(60):
        label, tpl, keys = r.choice([t for t in license.TEMPLATES if len(t[1].split()) < 25])
        words = tpl.split()
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(words))
            words[k : k + r.choice([0, 1])] = r.choice([[], ["x"], ["the", "license"]])
        words = ["a"] * r.randint(0, 6) + words + ["the"] * r.randint(0, 6)
        want = max(best_match(t.split(), k, words) for _, t, k in license.TEMPLATES)
        got = s.scan(" ".join(words).encode())
        assert got["score"] == pytest.approx(1.0 if got["base"] else want)


def test_license(docs):
    got = {r["doc_id"]: r for r in license.scan_documents(docs).collect()}
    for i, t in enumerate(texts()):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        starts, base = [], set()
        for p, label in license.BASE:
            p = p.split()
            hit = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            starts += hit
            base |= {label} if hit else set()
        more, score = set(base), 1.0 if base else 0.0
        for label, tpl, keys in license.TEMPLATES:
            share = best_match(tpl.split(), keys, words)
            if share:
                more.add(label)
                score = max(score, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(more)) and r["score"] == pytest.approx(score)
    assert license.scan_documents(empty(docs)).count() == 0


def test_license_base_places_come_from_the_index():
    s = license.Scanner()
    assert sum(map(len, s.base_post.values())) == len(license.BASE)
    text = b"Under the MIT license, under the mit license cc by nc by nc; under the mitt license cc-by-nc mit license"
    words = license.WORD.findall(text.lower())
    want = sorted(k for p, _ in license.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split())
    got = s.scan(text)
    assert sorted(got["starts"]) == want and got["base"] == {"mit", "cc-by-nc"} and got["score"] == 1.0
    s.base_post.clear()
    assert s.scan(text)["starts"] == []


def test_mixing_rates(spark):
    docs = spark.range(9000).selectExpr("id doc_id", "cast(id as string) text", "if(id % 3 = 0, 'hot', concat('s', id % 20)) source", "1 mix_copy")
    w = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), ("s2", 1.0)], "source string, weight double")
    out = mixing.replicate(docs, w, budget=1.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s1", "s2"}
    for s, share in (("hot", 0.2), ("s1", 0.6), ("s2", 0.2)):
        assert abs(n[s] / 9000 - share) < 0.03
    a, b = (sorted(map(tuple, out.select("doc_id", "mix_key").collect())) for _ in range(2))
    assert a == b
    assert mixing.mixed(docs, w).columns == docs.columns
    assert mixing.replicate(docs.where("false")).count() == 0
    big = mixing.poisson_tables(spark.createDataFrame([("x", 2000.0)], "source string, rate double")).collect()[0]["cdf"]
    assert abs(big[-1] - 1) < 1e-9
    for rate in (0.3, 150.0, 2000.0, 3e6):
        t = mixing.poisson_tables(spark.createDataFrame([("x", rate)], "source string, rate double")).collect()[0]
        assert len(t["cdf"]) < 30 * rate**0.5 + 70 and abs(t["first"] + sum(1 - c for c in t["cdf"]) - rate) < 1e-3 * max(1, rate**0.5 / 40)
    old = mixing.SMALL, mixing.COPIES
    mixing.SMALL, mixing.COPIES = 1, 2
    try:
        assert sorted(map(tuple, mixing.replicate(docs, w).select("doc_id", "mix_key").collect())) == a
    finally:
        mixing.SMALL, mixing.COPIES = old


def test_block_max_search_is_exact():
    r = np.random.default_rng(0)
    vectors = []
    for _ in range(500):
        v = {int(t): 1.0 if r.random() < 0.3 else float(r.random()) for t in r.integers(0, 30, r.integers(1, 5))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 30, 16)
    for q in vectors[:200]:
        sims = [(-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors)]
        want = sorted(s for s in sims if s[0] < 0)[:15]
        ids, got = index.search(q, 15)
        assert np.allclose(got, [-s for s, _ in want]) and all(abs(-w[0] - g) < 2e-9 for w, g in zip(want, got))
        clear = [i for s, i in want if -s > got[-1] + 1e-8]
        assert set(clear) <= set(ids.tolist())


def test_toxicity_held_out(spark):
    r = random.Random(5)
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 900):
        bad = r.random() < 0.2
        words = [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("xyzw") for _ in range(40)]
        if bad:
            words[r.randrange(40)] = r.choice(["Scoundrel", "wretch", "blackguard"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels[:50] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_documents(docs, model).collect()}
    assert len(got) == 900 and 0 <= got[0] < 0.3 and 0 <= got[1] < 0.3
    test = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.3) == (y == 1) for i, y in test) / len(test) > 0.97
    changed = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x["doc_id"]: x["score"] for x in toxicity.score_documents(docs, toxicity.fit(docs, changed)).collect()}
    assert again == got
    none = toxicity.fit(docs, lab.where("false"))
    assert {x["score"] for x in toxicity.score_documents(docs, none).collect()} == {0.0}
    kept = toxicity.reject_toxic(docs.withColumn("score", F.lit("own")), lab)
    assert kept.columns == ["doc_id", "text", "score"] and {x["score"] for x in kept.collect()} == {"own"}
    assert toxicity.reject_toxic(docs.where("false"), lab).count() == 0


def test_toxicity_keeps_rare_terms(spark):
    r = random.Random(6)
    ids = [i for i in range(1, 900) if zlib.crc32(str(i).encode()) % 4 != 2]
    rare, rows, labels = ids[:3], [], []
    for i in ids:
        bad = i in rare or i % 5 == 0
        words = [r.choice("abcdefgh") + r.choice("aeiou") + r.choice("xyzw") for _ in range(20)]
        words[3] = "schurke" if i in rare else "scoundrel" if bad else words[3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(5000, "gaunerei schurke dort"), (5001, "gaunerei dort"), (5002, "bax cey diz")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    words = {w for i, t in rows for w in toxicity.terms_of(t.encode())}
    assert set(model.terms) == words and len(model.ids) == len(rows) and (model.idf > 0).all()
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, model).collect()}
    # a word of three toxic rows is found; a text of unknown words alone has no evidence
    assert got[5000]["score"] >= 0.3 and set(rare) <= set(got[5000]["evidence"])
    assert got[5001]["evidence"] == [] and got[5002]["score"] < 0.3 and got[5002]["evidence"]


def test_toxicity_equals_brute_force(spark):
    """Scores and evidence of every row of a small table, from whole vectors and all examples, written plainly."""
    r = random.Random(11)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows, labels = [(0, None), (1, "...")], []
    for i in range(2, 260):
        bad = r.random() < 0.25
        t = [r.choice(words) for _ in range(r.randint(3, 30))] + (["Wretch"] * r.randint(1, 2) if bad else [])
        r.shuffle(t)
        rows.append((i, " ".join(t)))
        if i % 5:
            labels.append((i, int(bad)))
    rows += [(300 + k, rows[k][1]) for k in (2, 3, 4)] + [(400, "unknownword"), (401, "wretch")]
    labels += [(300 + k, dict(labels).get(k, 0)) for k in (2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, model).collect()}
    text = dict(rows)
    counts = {i: Counter(re.findall("[a-z]+", (t or "").lower())) for i, t in rows}
    known = {t.decode() for t in model.terms}
    n = len(rows)
    weight = {}
    for t in known:
        df = sum(t in c for c in counts.values())
        weight[t] = model.idf[model.terms.index(t.encode())]
        assert weight[t] >= (np.log((1 + n) / (1 + df)) + 1) * toxicity.NEUTRAL - 1e-12
    assert known == {w for i in model.ids for w in counts[i]}

    def vector(i):
        v = {t: (1 + np.log(k)) * weight[t] for t, k in counts[i].items() if t in known}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in counts}
    label = dict(zip(model.ids, model.labels, strict=True))
    share = dict(zip(model.ids, model.weights, strict=True))

    def neighbours(i):
        sims = [(-round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 9), k, j) for k, j in enumerate(model.ids) if j != i]  # equal texts of other rows do vote
        return [(-s, j) for s, _, j in sorted(sims)[: model.k] if s < 0]

    for i in counts:
        near = neighbours(i)
        assert np.allclose([s for s, _ in near], got[i]["evidence_cosine"], atol=2e-9)
        if not near:
            assert got[i]["evidence"] == [] and got[i]["score"] == model.none
            continue
        assert i not in got[i]["evidence"]
        total = sum(s * share[j] for s, j in near)
        raw = (sum(s * share[j] * label[j] for s, j in near) + toxicity.PRIOR * model.base) / (total + toxicity.PRIOR)
        if len({s for s, _ in near}) == len(near):
            assert got[i]["score"] == pytest.approx(model.calibrated(raw), abs=1e-6)
    assert got[401]["score"] >= 0.3 > got[400]["score"] and got[0]["score"] == got[1]["score"] < 0.3
    with_words = [i for i in counts if vectors[i]]
    assert all(got[i]["evidence"] for i in with_words)
    # a sample of few bytes leaves large texts out, not the rest
    big = [{"toxic": y, "size": s, "order": str(k), "doc_id": k, "sketch": [k], "blank": False} for k, (y, s) in enumerate([(1, 900), (1, 10), (0, 10), (0, 10)])]
    assert sorted(toxicity.examples(big, 200)) == [1, 2, 3]


def test_toxicity_hears_every_labelled_neighbour(spark):
    """Copies of an example under other ids are found; a common run of words makes no copy; only near-equal texts are one example."""
    common = "thank you for reading this page "
    rows = [(i, common + " ".join(f"plain{i}word{k}" for k in range(30))) for i in range(1, 60)]
    bad = common + "you utter wretch go away and never come back here again"
    rows += [(1000, bad), (1001, bad), (1002, bad + " friend"), (1003, bad.replace("away", "off"))]
    docs = spark.createDataFrame([*rows, (2000, bad), (2001, bad + " now")], "doc_id long, text string")
    free = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i in free], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.ids) >= {i for i in free if i < 1000}  # the common run drops no row
    assert len([i for i in model.ids if i >= 1000]) < len([i for i in free if i >= 1000]) or len([i for i in free if i >= 1000]) < 2
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    for i in (2000, 2001):
        assert got[i]["score"] >= 0.3 and got[i]["evidence"][0] >= 1000
    assert got[2000]["evidence_cosine"][0] == pytest.approx(1.0)
    assert all(i not in r["evidence"] for i, r in got.items())


def test_copies_of_the_sample():
    a = " ".join(f"w{i}" for i in range(60)).encode()
    near, far = a + b" end", b" ".join(a.split()[:20]) + b" " + b" ".join(b"z%d" % i for i in range(40))
    assert toxicity.one_of_copies([("1", 1, a, 1), ("2", 1, near, 2), ("3", 1, far, 3), ("4", 0, a, 4), ("5", 1, a, 5)]) == [1, 3, 4]


def test_license_headings_and_repeated_words():
    s = license.Scanner()
    assert s.scan(b"GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007")["labels"] == {"gpl-3"}
    for line, label in ((b"// SPDX-License-Identifier: Apache-2.0", "apache-2"), (b"# SPDX-License-Identifier: MIT", "mit"), (b"SPDX-License-Identifier: BSD-3-Clause", "bsd-3")):
        assert s.scan(line)["labels"] == {label}
    # words that repeat hold no place of a passage together: nothing is compared word by word
    compared = []
    whole, license.common = license.common, lambda *a: compared.append(a) or whole(*a)
    try:
        for word in (b"software ", b"license ", b"permission notice ", b"warranties "):
            assert s.scan(word * 20_000)["labels"] == set()
    finally:
        license.common = whole
    assert not compared
    tpl = next(t for label, t, _ in license.TEMPLATES if label == "isc").encode()
    found = s.scan(b"software " * 5000 + tpl + b" software" * 5000)
    assert found["labels"] == {"isc"} and any(5000 - license.BAND <= first <= 5000 for _, first, _, _ in found["spans"])
