"""Licence notices by a positional index of rare words.

Templates are sequences of words with the phrases that a notice must hold.  An index keeps the rarest places of
each template, by inverse document frequency counted over all documents: one more than a notice may have
wrong, so every notice has one of them right.  Each (template, place in the file - place in the template) that
a file's words point at is a candidate and is read in full: every mandatory phrase must
stand there word for word, and the share of the template's words in place is its score.  That misses no notice, whatever
else a file holds.

Besides, the base phrases are looked for at every word.  Words are runs of 0-9, a-z (A-Z are lower-cased) and
non-ASCII characters.  Null and empty texts have no words, no places and score 0.  Repeated rows have each their
result, an empty table gives none; a long text is read in parts that end with words and verified as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetrail.llm.textblocks import _LOWER, LONG, blocks, cut_words, hashes, lean, words
from gazetrail.llm.toxicity import Lookup

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, template, mandatory phrases)
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


class Index:
    """Postings of the templates' words; idf: word -> weight (missing: the highest)."""

    def __init__(self, idf: dict[str, float] | None = None, templates=None, base=None, share: float = 0.7):
        self.templates = [(a, b.split(), [p.split() for p in c]) for a, b, c in (TEMPLATES if templates is None else templates)]
        self.base = {tuple(k.split()): v for k, v in (BASE if base is None else base).items()}
        self.share = share
        every = {w for _, t, m in self.templates for x in (t, *m) for w in x} | {w for k in self.base for w in k}
        self.words = sorted(every, key=_hash)
        self.at = {w: k for k, w in enumerate(self.words)}
        self.lookup = Lookup(np.array([_hash(w) for w in self.words], np.uint64))
        top = max((idf or {}).values(), default=1.0)
        self.idf = np.array([(idf or {}).get(w, top) for w in self.words])
        self.texts = [np.array([self.at[w] for w in text]) for _, text, _ in self.templates]
        self.must = [[[self.at[w] for w in m] for m in must] for *_, must in self.templates]
        self.needs = [{w for m in must for w in m} for must in self.must]
        self.postings = []  # for each template, its rarest places
        for text in self.texts:
            wrong = sum(k / len(text) >= share for k in range(1, len(text) + 1)) - 1
            self.postings.append(sorted(range(len(text)), key=lambda p: (-self.idf[text[p]], text[p], p))[: wrong + 1])

    def known(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in each row, licence word at each word or -1, first word of each row) of a block; a long text
        is read in parts."""
        low = _LOWER[data]
        if len(low) <= LONG:
            return self._known(low, off)
        n, ids = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            own = [self._known(part, np.array([0, len(part)]))[1][:-1] for part in cut_words(low[a:b])]
            n.append(sum(map(len, own)))
            ids += own
        n = np.array(n)
        return n, np.concatenate([*ids, np.full(1, -1, np.int32)]), np.cumsum(n) - n

    def _known(self, low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end, row = words(low, off)
        n = np.bincount(row, minlength=len(off) - 1)
        ids = np.full(len(start) + 1, -1, np.int32)
        which, at = self.lookup.find(hashes(low, start, end))
        ids[which] = at
        return n, ids, np.cumsum(n) - n

    def base_places(self, ids: np.ndarray) -> list[tuple[int, str]]:
        """(word, label) for each place of a base phrase in a text's licence words."""
        out = []
        for phrase, label in self.base.items():
            key = [self.at[w] for w in phrase]
            if len(ids) >= len(key):
                ok = ids[: len(ids) - len(key) + 1] == key[0]
                for k in range(1, len(key)):
                    if not ok.any():
                        break
                    ok = ok & (ids[k : len(ids) - len(key) + 1 + k] == key[k])
                out += [(int(i), label) for i in np.flatnonzero(ok)]
        return out

    def notices(self, ids: np.ndarray) -> list[tuple[int, str, float]]:
        """(first word, label, share of the template in place) of each notice in a text."""
        where = np.flatnonzero(ids >= 0)
        if not len(where):
            return []
        present = set(np.unique(ids[where]).tolist())
        out = []
        for (label, *_), text, must, needs, posting in zip(self.templates, self.texts, self.must, self.needs, self.postings):
            if not needs <= present:
                continue
            at = np.unique(np.concatenate([where[ids[where] == text[p]] - p for p in posting]))
            right = np.zeros(len(at), np.int64)
            for p, w in enumerate(text):
                i = at + p
                right += (i >= 0) & (i < len(ids)) & (ids[np.clip(i, 0, len(ids) - 1)] == w)
            for k in np.flatnonzero(right / len(text) >= self.share).tolist():
                a, b = max(0, int(at[k])), min(len(ids), int(at[k]) + len(text))
                here = ids[a:b].tolist()
                if all(_holds(here, m) for m in must):
                    out.append((a, label, int(right[k]) / len(text)))
        return sorted(out)


def _holds(text: list[int], phrase: list[int]) -> bool:
    return any(text[i : i + len(phrase)] == phrase for i in range(len(text) - len(phrase) + 1))


def idf(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each word of the templates over all of `docs` (text)."""
    index = Index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_n, size = np.zeros(len(index.words), np.int64), 0, len(index.words)
        for b in batches:
            docs_n += b.num_rows
            for x, y, data, off in blocks(b.column("text")):
                n, ids, _ = index.known(data, off)
                row = np.repeat(np.arange(y - x), n)
                hit = ids[:-1] >= 0
                df += np.bincount(np.unique(row[hit] * size + ids[:-1][hit]) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(docs_n, df))], ["k", "n"])

    got = {r.k: r.n for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    total = got.get(-1, 0)
    return {w: float(np.log((total + 1) / (got.get(k, 0) + 1))) for k, w in enumerate(index.words)}


PLACES = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("share", T.DoubleType())]))
FIELDS = [T.StructField(k, T.LongType()) for k in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField(k, T.StringType()) for k in ("base_labels", "labels")] + [T.StructField("score", T.DoubleType()), T.StructField("places", PLACES)]


def scan(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and places (each notice
    found, with its word and share) after its own columns; columns of these names are replaced."""
    docs = docs.drop(*(f.name for f in FIELDS))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for b in batches:
            rows = []
            for x, y, data, off in blocks(b.column("text")):
                n, ids, first = index.known(data, off)
                for k, a in zip(n.tolist(), first.tolist()):
                    own = ids[a : a + k]
                    base, found = index.base_places(own), index.notices(own)
                    at = [i for i, _ in base]
                    labels = {v for _, v in base}
                    rows.append((k, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {v for _, v, _ in found})), max([1.0 if base else 0.0, *(s for *_, s in found)]), [dict(word=i, label=v, share=s) for i, v, s in found]))
            cols = list(zip(*rows)) or [[] for _ in FIELDS]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds))], [*b.schema.names, *(f.name for f in FIELDS)])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *FIELDS]))
