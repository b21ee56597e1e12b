"""Language of texts by error-correcting output codes over byte n-grams.

Each language has a codeword; each bit of the codewords is a binary classifier, a naive Bayes
ratio of byte trigrams between the languages with that bit and those without, every language with
the same say.  A text's margins for all bits are compared with each codeword by a logistic loss,
each bit weighted by how well it is told apart, and the codeword with the least loss wins.  Up to seven
languages get the exhaustive code (every split of the languages is a bit), more get a fixed code with
distinct rows.

Trigrams are counted over the whole texts of all rows that may be learned from: within a task by numpy, between tasks by
an aggregate of (language, trigram).  Every value of lang is learned.  What is sent to the driver and back is a row for each
language and weights for each of 2^18 trigrams and each bit, of which there are 10 log2(languages).

A null text, an empty one and one without a letter are `und` with score 0; so is every text where
nothing could be learned.  Rows with a null lang or a null doc_id are not learned from.
`ambiguous` flags texts whose second codeword is nearly as near.  Repeated rows have each their result, an empty table gives
none; a long text is read in parts that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetrail.llm import storage
from gazetrail.llm.textblocks import LONG, blocks, lean, lower

BITS = 18
#: Space and signs 0, a-z 1 to 26, other bytes of UTF-8 27 to 63.
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 37
TEMPERATURE, SHRINK, UNSURE = 6.0, 12.0, 0.1
HELD = 16  # languages whose counts a task holds at once, 2 MB each
MANY = 512  # languages whose codewords are compared with each other


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of each trigram of a block of texts that has a letter in its middle."""
    c = _CODE[lower(data)]
    if len(c) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = (c[1:-1] > 0) & (row[:-2] == row[2:])
    return ((c[:-2] << 12) | (c[1:-1] << 6) | c[2:])[ok], row[1:-1][ok]


def text_trigrams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code, row from the first) of a column's trigrams, a block at a time; a long text in parts that
    overlap by two bytes, and one more for a letter's case."""
    for x, _, data, off in blocks(texts):
        if len(data) <= LONG:
            yield x, *trigrams(data, off)
            continue
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            for p in range(a, b, LONG):
                q, before = min(p + LONG + 2, b), int(p > a)
                c = _CODE[lower(data[p - before : q])][before:]
                code = ((c[:-2] << 12) | (c[1:-1] << 6) | c[2:])[c[1:-1] > 0] if len(c) > 2 else np.zeros(0, np.int32)
                yield x + k, code, np.zeros(len(code), np.int64)


def codewords(n: int, seed: int = 10) -> np.ndarray:
    """Rows of +1 and -1, one for each of n languages."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        bits = [b for b in product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, np.int8).T
    width, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if n > MANY:  # so long and random, words are far from each other; only equal ones would be a fault
            far = len(np.unique(m, axis=0)) - n
        else:
            apart = (width - m.astype(np.int64) @ m.T) / 2
            np.fill_diagonal(apart, width)
            far = apart.min()
        if (np.abs(m.sum(axis=0, dtype=np.int64)) < n).all() and (best is None or far > best[0]):
            best = far, m
        if n > MANY and best and best[0] == 0:
            break
    return best[1]


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # trigrams x bits
    trust: np.ndarray  # bits
    common: np.ndarray  # log share of each language, which settles ties


def _counter(where: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for k, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at), pa.array(n[at])], ["k", "code", "n"])
            total.clear()

        for b in batches:
            lang = np.array([where[x] for x in b.column("lang").to_pylist()], np.int64)
            texts = b.column("text")
            for k in np.unique(lang).tolist():
                if len(total) >= HELD and k not in total:
                    yield from out()
                own = total.setdefault(k, np.zeros(1 << BITS, np.int64))
                for _, code, _ in text_trigrams(texts.filter(pa.array(lang == k))):
                    own += np.bincount(code, minlength=1 << BITS)
        yield from out()

    return run


def fit(rows: DataFrame, smooth: float = 0.5) -> Model | None:
    """Learn every value of lang from every row of (text, lang); None without any.

    The driver gets a row for each language and one for each trigram; counts of (language, trigram) stay a table."""
    spark = rows.sparkSession
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    codes = codewords(len(langs))
    width = codes.shape[1]
    counts = rows.mapInArrow(lean(_counter({x: k for k, x in enumerate(langs)})), "k long, code long, n long")
    counts = storage.written(counts.groupBy("k", "code").agg(F.sum("n").alias("n")), "trigrams")
    below = np.full(len(langs), smooth * (1 << BITS))
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        below[r.k] += r.n
    # sums over languages of each trigram's share, with the sign of each bit, of which there are few
    sides = np.stack([(codes > 0).sum(axis=0), (codes < 0).sum(axis=0)])
    base = np.stack([(smooth / below) @ (codes > 0), (smooth / below) @ (codes < 0)])
    sent = spark.sparkContext.broadcast((codes, below))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, below = sent.value
        for b in batches:
            k, code, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "code", "n"))
            for a in range(0, len(k), 1 << 16):
                own = slice(a, a + (1 << 16))
                key, at = np.unique(code[own], return_inverse=True)
                x = np.zeros((len(key), width + 1))
                share = n[own] / below[k[own]]
                np.add.at(x, at, np.column_stack([codes[k[own]] * share[:, None], share]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(list(x), pa.list_(pa.float64()))], ["code", "x"])

    w = np.zeros((1 << BITS, width), np.float32)
    w[:] = np.log(base[0] / sides[0]) - np.log(base[1] / sides[1]) if width else 0
    if width:
        parts = counts.mapInArrow(shares, "code long, x array<double>")
        got = parts.groupBy("code").agg(*(F.sum(F.get("x", F.lit(j))).alias(f"x{j}") for j in range(width + 1))).toArrow()
        code, every = got.column("code").to_numpy(), got.column(f"x{width}").to_numpy()
        for j in range(width):
            lean_ = got.column(f"x{j}").to_numpy()
            w[code, j] = np.log((base[0, j] + (every + lean_) / 2) / sides[0, j]) - np.log((base[1, j] + (every - lean_) / 2) / sides[1, j])
    trust = _trust(counts, w, below, smooth, len(langs))
    storage.discard(spark, counts)
    return Model(langs, codes, w, trust, np.log([sizes[x] / sum(sizes.values()) for x in langs]))


def _trust(counts: DataFrame, w: np.ndarray, below: np.ndarray, smooth: float, n: int) -> np.ndarray:
    """How well each bit is told apart: the least mean margin that a language has in it."""
    width = w.shape[1]
    if not width:
        return np.zeros(0)
    sent = counts.sparkSession.sparkContext.broadcast((w, below))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, below = sent.value
        for b in batches:
            k, code, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "code", "n"))
            for a in range(0, len(k), 1 << 16):
                own = slice(a, a + (1 << 16))
                key, at = np.unique(k[own], return_inverse=True)
                x = np.zeros((len(key), width))
                np.add.at(x, at, w[code[own]] * (n[own] / below[k[own]])[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(list(x), pa.list_(pa.float64()))], ["k", "x"])

    mean = (smooth / below)[:, None] * w.sum(axis=0, dtype=np.float64)
    parts = counts.mapInArrow(margins, "k long, x array<double>")
    for r in parts.groupBy("k").agg(*(F.sum(F.get("x", F.lit(j))).alias(f"x{j}") for j in range(width))).collect():
        mean[r.k] += [r[f"x{j}"] for j in range(width)]
    trust = np.abs(mean).min(axis=0)
    return trust / trust.sum() if trust.sum() else np.full(width, 1 / width)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language, score, whether it is ambiguous) for rows of margins.

    The weighted logistic losses of a margin m for a bit and for its opposite differ by m, so what tells
    codewords apart is a product of margins and codewords."""
    n = len(margins)
    best, score, unsure = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    weight = model.trust * len(model.trust)
    step = max(1, (1 << 22) // max(1, len(model.langs)))
    for a in range(0, n, step):
        gain = (np.clip(margins[a : a + step], -30, 30) * weight) @ model.codes.T.astype(np.float64) / 2 + 1e-3 * model.common
        odds = np.exp(gain - gain.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        best[a : a + step] = odds.argmax(axis=1)
        two = np.partition(odds, -2, axis=1)[:, -2:] if odds.shape[1] > 1 else np.column_stack([np.zeros(len(odds)), odds[:, 0]])
        score[a : a + step] = two.max(axis=1)
        unsure[a : a + step] = two.max(axis=1) - two.min(axis=1) < UNSURE
    return best, score, unsure


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with lang_pred, score and ambiguous after its own columns; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            margins, n = np.zeros((b.num_rows, m.codes.shape[1])), np.zeros(b.num_rows, np.int64)
            for x, code, row in text_trigrams(b.column("text")):
                own = np.bincount(row)
                full = np.flatnonzero(own)
                if len(full) and margins.shape[1]:
                    starts = (np.cumsum(own) - own)[full]
                    margins[x + full] += np.add.reduceat(m.weights[code], starts, axis=0, dtype=np.float64)
                    n[x + full] += own[full]
            best, score, unsure = decode(m, TEMPERATURE * margins / (n + SHRINK)[:, None])
            names = pa.array(m.langs).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(score), pa.array(unsure)], [*b.schema.names, "lang_pred", "score", "ambiguous"])

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    out = docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *fields]))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return out.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise("und"), "score": F.when(letters, F.col("score")).otherwise(0.0), "ambiguous": F.col("ambiguous") | ~letters})
