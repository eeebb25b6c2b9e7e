"""What a worker of the toxicity stage holds."""

import tracemalloc

import numpy as np

from fogmeans.llm import common, toxicity


def test_index_is_built_in_pieces():
    """Building takes little more than the index itself, which finds what a plain product finds."""
    r = np.random.default_rng(3)
    n, n_terms, each = 3000, 20_000, 150
    numbers = np.concatenate([np.sort(r.choice(n_terms, each, replace=False)) for _ in range(n)]).astype(np.int32)
    starts, counts = np.arange(n + 1) * each, r.integers(1, 4, n * each).astype(np.int32)
    model = toxicity.Model([b"%d" % i for i in range(n_terms)], r.random(n_terms) + 0.1, list(range(n)), np.zeros(n), np.ones(n), starts, numbers, counts, 0.1)
    tracemalloc.start()
    index = model.index()
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - held < 8 * len(numbers)
    assert np.array_equal(index.first, np.concatenate([[0], np.cumsum(np.where(index.dense < 0, np.bincount(numbers, minlength=n_terms), 0))]))
    full = np.zeros((n, n_terms))
    full[np.repeat(np.arange(n), each), numbers] = index.weights
    assert np.allclose((full * full).sum(axis=1), 1)
    for i in (0, 255, 256, n - 1):
        ids, sims = index.search_all([model.vector((numbers[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]))], 10)[0]
        want = np.round(full @ full[i], 9)
        assert ids.tolist() == np.lexsort((np.arange(n), -want))[:10].tolist() and np.allclose(sims, want[ids], atol=2e-9)


def test_text_goes_to_python_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "you utter fool" if i % 3 == 0 else f"a calm note {i}", "x") for i in range(60)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    sent = []

    def map_texts(df, keep, make, fields, column="text", also=()):
        sent.append([column, *keep])
        return common.map_texts(df, keep, make, fields, column, also)

    monkeypatch.setattr(toxicity, "map_texts", map_texts)
    kept = toxicity.reject_toxic(docs, labels)
    assert len(set(sent[-1])) == len(docs.columns) == 3
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(60) if i % 3}
