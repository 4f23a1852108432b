"""License scans with a positional rare-token index.

The index holds, for each word of the licence wordings, its postings (wording, position) and its inverse document
frequency over the wordings. Each phrase is looked up by its word of the highest IDF: where that word stands in the
file it opens alignments (place in the file less place in the wording), and the postings of the phrase's other words,
in descending IDF, are intersected with them by relative position. What is left are the places of the whole phrase. A
wording gives its label if and only if all its mandatory key phrases are found near one alignment; the IDF share of its
words that stand at their places is the score. Base phrases are wordings of the same index, each its own key phrase.

A file without any phrase's rarest word is done with one look-up of its words.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lifeloom.llm.common import words_of

#: Phrases whose every place is counted, and the label of each.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: (label, wording, mandatory key phrases): short notices, and the texts of the short licences. A label may have several
#: wordings.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific "
        "language governing permissions and limitations under the license",
        ("www apache org licenses license 2 0",),
    ),
    (
        "gpl-2.0",
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license version 2",),
    ),
    (
        "gpl-2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 2 of the license or at your option any later version",
        ("gnu general public license", "version 2 of the license"),
    ),
    (
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license version 3",),
    ),
    (
        "gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        ("gnu general public license", "version 3 of the license"),
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    (
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge",),
    ),
    ("mit-license", "released under the mit license", ("under the mit license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at https mozilla org mpl 2 0",
        ("mozilla public license v 2 0",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    (
        "bsl-1.0",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization "
        "obtaining a copy of the software and accompanying documentation covered by this license",
        ("boost software license version 1 0",),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


@dataclass(frozen=True)
class Phrase:
    """Words with their places in the phrase, in descending IDF."""

    steps: tuple[tuple[bytes, int], ...]
    #: Place of the phrase in its wording.
    at: int = 0


@dataclass(frozen=True)
class Wording:
    label: str
    postings: dict[bytes, tuple[int, ...]]
    keys: tuple[Phrase, ...]
    length: int
    weight: float
    base: bool = False


def _at(words: tuple[bytes, ...], phrase: tuple[bytes, ...]) -> int:
    """Place of a phrase in a wording."""
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"key phrase {b' '.join(phrase)!r} is not in its wording")


class Index:
    """Positional index over the licence wordings and the base phrases."""

    def __init__(self, templates=TEMPLATES, base: dict = BASE_PHRASES):
        texts = [(label, tuple(words_of(text)), tuple(tuple(words_of(k)) for k in keys), False) for label, text, keys in templates]
        texts += [(label, tuple(words_of(p)), (tuple(words_of(p)),), True) for p, label in base.items()]
        df: dict[bytes, int] = defaultdict(int)
        for _, words, _, _ in texts:
            for w in set(words):
                df[w] += 1
        self.idf = {w: math.log((1 + len(texts)) / n) for w, n in df.items()}
        self.wordings: list[Wording] = []
        self.opened: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # rarest word -> (wording, key)
        for t, (label, words, keys, is_base) in enumerate(texts):
            postings: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                postings[w].append(i)
            phrases = []
            for j, key in enumerate(keys):
                steps = sorted(((w, i) for i, w in enumerate(key)), key=lambda x: (-self.idf[x[0]], x[1]))
                phrases.append(Phrase(tuple(steps), _at(words, key)))
                self.opened[steps[0][0]].append((t, j))
            weight = sum(self.idf[w] for w in words)
            self.wordings.append(Wording(label, {w: tuple(p) for w, p in postings.items()}, tuple(phrases), len(words), weight, is_base))
        self.openers = frozenset(self.opened)

    def places(self, phrase: Phrase, held: dict[bytes, set[int]]) -> set[int]:
        """Where the phrase stands in a file with these positions of words: alignments shared by all its words."""
        (rarest, at), *others = phrase.steps
        found = {i - at for i in held.get(rarest, ())}
        for w, p in others:
            if not found:
                break
            own = held.get(w, ())
            found = {s for s in found if s + p in own}
        return found

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """(places of base phrases, first place, last place, base labels, all labels, score) of a file's words."""
        if self.openers.isdisjoint(words):
            return 0, None, None, set(), set(), 0.0
        held: dict[bytes, set[int]] = {}
        for i, w in enumerate(words):
            if w in self.idf:
                held.setdefault(w, set()).add(i)
        places, base, labels, score = [], set(), set(), 0.0
        found: dict[int, dict[int, set[int]]] = defaultdict(dict)
        for w in sorted(self.openers & held.keys(), key=lambda w: (-self.idf[w], w)):
            for t, j in self.opened[w]:
                found[t][j] = self.places(self.wordings[t].keys[j], held)
        for t, by_key in sorted(found.items()):
            x = self.wordings[t]
            if x.base:
                places += by_key[0]
                base |= {x.label} if by_key[0] else set()
                continue
            aligned = self.aligned(x, by_key)
            if aligned:
                labels.add(x.label)
                score = max(score, *(self.cover(x, d, held) for d in aligned))
        score = 1.0 if base else min(1.0, score)
        return len(places), min(places, default=None), max(places, default=None), base, labels | base, score

    def aligned(self, x: Wording, by_key: dict[int, set[int]]) -> set[int]:
        """Alignments of the wording at which its first key phrase stands and near which, within its length, all others do."""
        if len(by_key) < len(x.keys):
            return set()
        shifts = [{s - k.at for s in by_key[j]} for j, k in enumerate(x.keys)]
        found = shifts[0]
        for other in map(sorted, shifts[1:]):
            found = {d for d in found if (i := bisect_left(other, d - x.length)) < len(other) and other[i] <= d + x.length}
        return found

    def cover(self, x: Wording, shift: int, held: dict[bytes, set[int]]) -> float:
        """IDF share of the wording's words that stand at their positions moved by shift."""
        return sum(self.idf[w] for w, at in x.postings.items() if w in held for p in at if p + shift in held[w]) / x.weight


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each row of docs (doc_id, text): base phrase places, labels, score.

    One pass without a shuffle; a task holds one Arrow batch. The score is 1 with a base phrase, else the best cover of a
    wording (equal ones are one score). Null and empty texts have no words: counts 0, places
    null, labels empty, score 0. Repeated rows each give a row. An empty table gives no row. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            texts = b.column(1)
            for k in range(0, len(texts), 512):
                rows = []
                for text in texts[k : k + 512].to_pylist():
                    words = words_of(text)
                    n, first, last, base, labels, score = index.scan(words)
                    rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[k : k + 512], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
