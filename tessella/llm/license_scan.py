"""Licence notices found by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

# Labels and phrases whose every place counts.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Label, notice as licensors print it, and phrases that must stand in it.
NOTICES = [
    ("mit", "Released under the MIT License.", ["the mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "version 3 of the license"]),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "version 2 of the license"]),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "with or without modification are permitted"]),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("boost", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1"]),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ["copyright and related and neighboring rights"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4"]),
]

#: words are runs of 0-9, a-z (after lower-casing A-Z) and anything beyond ASCII
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase's words stand in ``joined`` (words with a space around each)."""
    out, needle, seen, at = [], b" " + phrase + b" ", 0, 0
    i = joined.find(needle)
    while i >= 0:
        seen += joined.count(b" ", at, i)
        at = i
        out.append(seen)
        i = joined.find(needle, i + 1)
    return out


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many of them each vocabulary word stands (all documents, whole texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in slices(batches, 2000):
            for text in utf8(batch.column(0)):
                n[b""] += 1
                n.update(vocabulary.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Posting lists of the ``anchors`` words of highest IDF in each notice's key phrases: word to (notice, position).

    Only these words are sure to stand in a text that holds the notice, whole or in part: a
    file's own licence words of highest IDF are looked up, as it has them all or can't match.
    """

    def __init__(self, notices: list[tuple[str, str, list[str]]], n: int, df: dict[bytes, int], anchors: int = 4, slack: int = 2):
        self.slack = slack
        self.notices = [(label, words(text.encode()), [words(p.encode()) for p in keys]) for label, text, keys in notices]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for k, (_, ws, keys) in enumerate(self.notices):
            rare = sorted({w for key in keys for w in key}.intersection(ws), key=lambda w: (-math.log((n + 1) / (df.get(w, 0) + 1)), w))[:anchors]
            self.needed.append((len(rare) + 1) // 2)
            for q, w in enumerate(ws):
                if w in rare:
                    self.postings[w].append((k, q))

    def labels(self, ws: list[bytes]) -> tuple[set[str], float]:
        """Labels of the notices that stand in a text's words, and the best share of a notice's words that are in place."""
        hits: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        postings = self.postings
        for p, w in enumerate(ws):
            if w in postings:
                for k, q in postings[w]:
                    hits[k].append((p - q, w))
        labels, best = set(), 0.0
        for k, offsets in hits.items():
            label, notice, keys = self.notices[k]
            offsets.sort()
            j, tried, count = 0, -1, Counter()
            for i, (offset, w) in enumerate(offsets):  # a window opens at every offset, so none can hide the next
                while j < len(offsets) and offsets[j][0] - offset <= self.slack:
                    count[offsets[j][1]] += 1
                    j += 1
                if len(count) >= self.needed[k] and (j > tried or offset > offsets[i - 1][0]):
                    tried = j
                    lo = max(0, offset - self.slack)
                    window = ws[lo : offsets[j - 1][0] + len(notice) + self.slack]
                    line = b" " + b" ".join(window) + b" "
                    if all(b" " + b" ".join(key) + b" " in line for key in keys):
                        labels.add(label)
                        base = offset - lo
                        near = sum(v in window[max(0, base + q - self.slack) : max(0, base + q + 2 * self.slack + 1)] for q, v in enumerate(notice))
                        best = max(best, near / len(notice))
                count[w] -= 1
                if not count[w]:
                    del count[w]
        return labels, best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Base phrases and licence notices of every document.

    Columns: doc_id, n_words, n_base (places of the base phrases), first_word, last_word
    (smallest and largest such place, else null), base_labels, labels (those and the
    notices'; distinct, sorted, joined by commas), score (best share of a notice's words
    in place, 1 for a base phrase, else 0). A notice counts if at least half of its rarest
    key words (by document frequency in all of ``docs``) stand at the right distances and its
    key phrases stand there. Null texts count as empty; repeated rows each get a row; no
    rows give no rows; other columns aren't read.
    """
    notices = NOTICES if notices is None else notices
    n, df = document_frequencies(docs, {w for _, text, _ in notices for w in words(text.encode())}, text_col)
    base = {label: phrase.encode() for label, phrase in BASE.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(notices, n, df)
        anchors = frozenset(index.postings)
        for batch in slices(batches, 1000):
            rows = []
            for text in utf8(batch.column(1)):
                ws = words(text)
                labels: set[str] = set()
                score, at, own = 0.0, [], []
                if not anchors.isdisjoint(ws):
                    labels, score = index.labels(ws)
                flat = text.translate(_TABLE)
                if any(p.rpartition(b" ")[2] in flat for p in base.values()):
                    joined = b" " + b" ".join(ws) + b" "
                    for label, phrase in base.items():
                        if got := places(joined, phrase):
                            at += got
                            own.append(label)
                            score = 1.0
                rows.append((len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(labels.union(own))), score))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
