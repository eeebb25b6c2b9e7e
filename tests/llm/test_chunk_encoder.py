"""Ids of chunks that are encoded together."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fogmeans.llm import idcoder, tokenfile


class Counted:
    """A library that counts the texts it is given."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def __getattr__(self, name):
        def call(texts, **more):
            self.texts += len(texts)
            return getattr(self.library, name)(texts, **more)

        return call


def test_joined_chunks():
    """Fresh chunks go to the library as few texts, and have its ids whatever they hold."""
    odd = ["", " ", "\x01", "a \x01 b", "a!\x01 \x01!", "\x01\x01", "\x00 \x02", "é é ́x", "<|endoftext|> x<|startoftext|>y", "\x1c a b c ​", "don't 'S", "🙂‍🙂 ж", None]
    plain = [" ".join(f"w{i * j}-{j}" for j in range(300)) + "\n" for i in range(40)]
    coder = tokenfile.ChunkEncoder(tokenfile.default_vocabulary())
    library = coder.library
    want = [library.encode(t or "", add_special_tokens=False).ids for t in odd + plain]
    for t, w in zip(odd, want, strict=False):
        assert coder.encode([t and t.encode()])[0].tolist() == w, t
    coder.known.clear()
    assert [i.tolist() for i in coder.encode([t and t.encode() for t in odd + plain])] == want
    coder.known.clear()
    coder.library = Counted(library)
    assert [i.tolist() for i in coder.encode([t.encode() for t in plain])] == want[len(odd) :]
    assert coder.library.texts <= -(-len(coder.known) // tokenfile.JOINED) < 20


def test_words_are_kept_without_case_and_signs():
    """Plain texts: a word is remembered once, whatever stands beside it."""
    coder = tokenfile.ChunkEncoder(tokenfile.default_vocabulary())
    words = ["river", "Stone", "don't", "ÉTÉ", "straße", "x9y"]
    texts = [f"{a}{w}{b} {w.upper() if w != 'straße' else w}{c}" for w in words for a in ("", '"', "((") for b in (".", ",", "!?") for c in ("", ";", "...")]
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in coder.encode([t.encode() for t in texts])] == want
    assert len(coder.known) <= 20 < len({c for t in texts for c in t.split()})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbsStTrReEvVlLmMdD'''09!.<|> \n\t\x0béÉßÿÞþ"), max_size=40) | st.text(st.sampled_from("aé'sÀ ×÷\x7f\x1c\x85\xa0ºª²½ḉ̧ΣĀ<|endoftext|>"), max_size=20), max_size=5))
def test_plain_texts_are_the_library(texts):
    coder = tokenfile.encoder(tokenfile.default_vocabulary())
    assert [i.tolist() for i in coder.encode([t.encode() for t in texts])] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_phrases_are_coded_as_one(monkeypatch):
    """Words of several ids that a section repeats are one number for the coder, and come back as their ids."""
    coder, coded = tokenfile.ChunkEncoder(tokenfile.default_vocabulary()), []
    encode = idcoder.encode
    monkeypatch.setattr(idcoder, "encode", lambda ids, *more: coded.append(len(ids)) or encode(ids, *more))
    texts = [f"thatanorheble osieado{i % 3} " * 50 + f"once{i}zqx" for i in range(40)] + ["", None, "  "]
    numbers = coder.numbers([t and t.encode() for t in texts])
    for end in (2, None, 60_000):
        raw = tokenfile.pack_pieces(1, 2, [str(i) for i in range(len(texts))], numbers, coder, end) + b"\n"
        want = [coder.library.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in texts]
        (place, back), (_, again) = tokenfile.unpack(raw + raw)
        assert (place["part"], place["section"], place["n"]) == (1, 2, [len(w) for w in want])
        assert [b.tolist() for b in back] == [a.tolist() for a in again] == want
        assert coded[-1] < 0.6 * sum(map(len, want))
    none = tokenfile.pack_pieces(0, 0, ["a"], [np.zeros(0, np.int64)], tokenfile.ChunkEncoder(tokenfile.default_vocabulary()), None)
    assert [b.tolist() for _, docs in tokenfile.unpack(none + b"\n") for b in docs] == [[]]


def test_carries_and_rare_ids():
    """Many blocks of ids of very unequal shares, most of them coded without a guess, and ids without a share."""
    rng = np.random.default_rng(8)
    ids = np.where(rng.random(60_000) < 0.9, rng.geometric(0.001, 60_000), rng.integers(0, 1 << 28, 60_000))
    ids[::977] = (1 << 28) - 1
    shares = idcoder.Shares.of(np.append(ids[:30_000], np.zeros(3_000_000, np.int64)))
    for block in (7, 256, 4096):
        sizes, sums, words = idcoder.encode(ids, shares, block)
        assert np.array_equal(np.concatenate(idcoder.decode(sizes, sums, words, shares)), ids)


def test_sections_while_memory_fills(monkeypatch):
    """A full memory ends a section, and no document is lost or altered."""
    monkeypatch.setattr(tokenfile, "REMEMBERED", 40)
    coder = tokenfile.ChunkEncoder(tokenfile.default_vocabulary())
    texts = [f"alpha beta{i} {chr(97 + i % 26) * 3}bor" + (" \u0436ук" if i % 5 == 0 else "") for i in range(120)]
    batches = [pa.record_batch({"doc_id": [str(i) for i in range(a, a + 6)], "text": texts[a : a + 6]}) for a in range(0, 120, 6)]
    made = list(tokenfile.sections(iter(batches), 4, coder, 2, 1 << 20))
    found = [(place["section"], name, ids.tolist()) for raw in made for place, docs in tokenfile.unpack(raw + b"\n") for name, ids in zip(place["docs"], docs, strict=True)]
    assert [f[1:] for f in found] == [(str(i), [*coder.library.encode(t, add_special_tokens=False).ids, 2]) for i, t in enumerate(texts)]
    assert sorted({f[0] for f in found}) == list(range(len(made))) and len(made) > 2
