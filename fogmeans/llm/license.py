"""Licence scan by a positional index of rare licence words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame

from .common import corpus_counts, map_texts

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Phrases whose labels always hold where the phrase stands.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, passage of the public licence or its usual notice, key phrases that must stand in the match.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("without warranties or conditions of any kind",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007", ("gnu general public license version 3",)),
    ("gpl-2", "gnu general public license version 2 june 1991", ("gnu general public license version 2",)),
    ("lgpl", "gnu lesser general public license version 3 29 june 2007", ("gnu lesser general public license version 3",)),
    ("agpl", "gnu affero general public license version 3 19 november 2007", ("gnu affero general public license version 3",)),
    ("apache-2", "apache license version 2 0 january 2004", ("apache license version 2 0",)),
    ("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    ("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    ("bsd", "spdx license identifier bsd 2 clause", ("spdx license identifier bsd 2 clause",)),
    ("bsd-3", "spdx license identifier bsd 3 clause", ("spdx license identifier bsd 3 clause",)),
    ("isc", "spdx license identifier isc", ("spdx license identifier isc",)),
    ("gpl-2", "spdx license identifier gpl 2 0", ("spdx license identifier gpl 2 0",)),
    ("gpl-3", "spdx license identifier gpl 3 0", ("spdx license identifier gpl 3 0",)),
    ("mpl-2", "spdx license identifier mpl 2 0", ("spdx license identifier mpl 2 0",)),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
)
TEMPLATES = PASSAGES
#: Share of a template's words that must stand in their order, and by how many words their places may drift in a match.
COVER = 0.8
BAND = 4
#: Indexed words that every match holds, where the template has as many.
HOLD = 4


def common(tpl: list, words: list, start: int, band: int = BAND) -> int:
    """Longest common subsequence of ``tpl`` and ``words`` in which word j of ``tpl`` stands at start + j to start + j + band."""
    n, best = len(words), [0] * (band + 2)
    for j, t in enumerate(tpl):
        left, p = 0, start + j
        for d in range(band + 1):
            here = best[d] + 1 if 0 <= p + d < n and words[p + d] == t else best[d + 1]
            if here < left:
                here = left
            best[d] = left = here
        best[band + 1] = 0
    return max(best)


class Scanner:
    """Index of templates: of each, its rarest words with their places.

    A match is a place ``start`` where at least ``cover`` of the template's words stand in order, word j at start + j to
    start + j + band, so words may be inserted, left out or changed; the key phrases must stand in the same stretch. A
    template is indexed by HOLD words more than a match may miss. Their postings in a text are intersected by relative
    position: only a start with at least HOLD indexed words in its band is compared word by word, so the lookup loses nothing
    and a text that repeats some licence words costs no comparison. A base phrase is a template without misses or band, whose
    places are the intersection of all its words' postings. ``idf`` orders the words; it decides the cost, never the result.
    """

    def __init__(self, idf: dict[str, float] | None = None, templates=TEMPLATES, base=BASE, cover: float = COVER, band: int = BAND):
        idf = idf or {}
        self.cover, self.band = cover, band
        self.templates, self.anchors = [], set()

        def rarest(words):
            return sorted(range(len(words)), key=lambda i: (-idf.get(words[i].decode(), math.inf), -len(words[i]), i))

        self.base = [(label, [(words[i], i) for i in rarest(words)]) for p, label in base for words in [p.encode().split()]]
        #: the rarest word of each base phrase, where the intersection of its postings begins
        self.base_post = defaultdict(list)
        for n, (_, index) in enumerate(self.base):
            self.base_post[index[0][0]].append(n)
        for label, text, keys in templates:
            words = text.encode().split()
            need = math.ceil(cover * len(words) - 1e-9)
            hold = min(HOLD, need)
            index = [(words[i], i) for i in rarest(words)[: len(words) - need + hold]]
            self.templates.append((label, words, [b" " + k.encode() + b" " for k in keys], need, Counter(words), index, hold))
            self.anchors |= {w for w, _ in index}
        self.anchors |= {w for _, index in self.base for w, _ in index}

    def starts_of(self, index: list, hold: int, places: dict[bytes, np.ndarray], n: int) -> list[int]:
        """Starts (from -length) at which at least ``hold`` words of ``index`` stand within the band, from their postings."""
        index = [(w, i) for w, i in index if w in places]
        if len(index) < hold:
            return []
        low = max(i for _, i in index) + self.band
        counts = np.zeros(n + low + 1, dtype=np.int16)
        for w, i in index:
            here = np.zeros(len(counts), bool)
            for d in range(self.band + 1):
                here[places[w] - i - d + low] = True
            counts += here
        return (np.flatnonzero(counts >= hold) - low).tolist()

    def scan(self, text: bytes | None) -> dict:
        words = WORD.findall((text or b"").lower())
        starts, base_labels, labels, score, spans = [], set(), set(), 0.0, []
        hits = self.anchors & set(words)
        if hits:
            lists = defaultdict(list)
            for p, w in enumerate(words):
                if w in hits:
                    lists[w].append(p)
            places = {w: np.array(p) for w, p in lists.items()}
            for n in [n for w in self.base_post.keys() & hits for n in self.base_post[w]]:
                label, index = self.base[n]
                at = places[index[0][0]] - index[0][1]
                for w, i in index[1:]:
                    at = np.intersect1d(at, places.get(w, np.zeros(0, int)) - i, assume_unique=True)
                if len(at):
                    starts += at.tolist()
                    base_labels.add(label)
                    score = 1.0
            matches = {n: self._matches(words, n, places) for n in range(len(self.templates))}
            for n, found in matches.items():
                if found:
                    label, tpl = self.templates[n][:2]
                    labels.add(label)
                    score = max(score, max(found.values()) / len(tpl))
                    run: list[int] = []
                    for start in [*sorted(found), math.inf]:
                        if run and start - run[0] >= len(tpl):
                            best = max(run, key=lambda x: (found[x], -x))  # noqa: B023  starts of one copy overlap: the best stands for them
                            spans.append((label, max(0, best), min(len(words), best + len(tpl) + self.band), found[best] / len(tpl)))
                            run = []
                        run.append(start)
        return {"n_words": len(words), "starts": starts, "base": base_labels, "labels": base_labels | labels, "score": score, "spans": sorted(set(spans))}

    def _matches(self, words: list, n: int, places: dict[bytes, np.ndarray]) -> dict[int, int]:
        """start: words in order, of each match of template n."""
        _, tpl, keys, need, counts, index, hold = self.templates[n]
        found = {}
        for s in self.starts_of(index, hold, places, len(words)):
            stretch = words[max(0, s) : max(0, s + len(tpl) + self.band)]
            near = Counter(stretch)
            if sum(min(k, near[w]) for w, k in counts.items()) < need:
                continue
            line = b" " + b" ".join(stretch) + b" "
            if not all(k in line for k in keys):
                continue
            exact = any(words[s + d : s + d + len(tpl)] == tpl for d in range(max(0, -s), self.band + 1))
            same = len(tpl) if exact else common(tpl, words, s, self.band)
            if same >= need:
                found[s] = same
        return found


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def corpus_idf(docs: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all of ``docs``."""
    vocab = vocabulary()

    def make():
        place = {w.encode(): i for i, w in enumerate(vocab)}
        return lambda text: [place[w] for w in place.keys() & set(WORD.findall((text or b"").lower()))]

    n, df = corpus_counts(docs, make, len(vocab))
    return {w: math.log((1 + n) / (1 + d)) for w, d in zip(vocab, df, strict=True)}


def scan_documents(docs: DataFrame, keep: list[str] | None = None, idf: dict[str, float] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id), n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Null and empty texts have no words, labels or places and score 0. score is 1 where a base phrase stands, else the largest
    share of a matched template's words. Repeated rows are scanned one by one, very long texts whole in one task, an empty
    table gives no rows, other columns are ignored. One pass for the word statistics over all rows, one for the scan; no shuffle.
    """
    idf = corpus_idf(docs.select("doc_id", "text")) if idf is None else idf

    def make():
        s = Scanner(idf)

        def work(texts):
            got = [s.scan(t) for t in texts]
            return [
                [g["n_words"] for g in got],
                [len(g["starts"]) for g in got],
                [min(g["starts"], default=None) for g in got],
                [max(g["starts"], default=None) for g in got],
                [",".join(sorted(g["base"])) for g in got],
                [",".join(sorted(g["labels"])) for g in got],
                [float(g["score"]) for g in got],
                [[{"label": a, "first": b, "end": c, "share": d} for a, b, c, d in g["spans"]] for g in got],
            ]

        return work

    return map_texts(docs, keep or ["doc_id"], make, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, `end`: long, share: double>>")
