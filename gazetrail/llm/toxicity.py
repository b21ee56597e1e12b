"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled set is a sample of all documents,
toxic ones among them.  A linear model over the presence of words and of their first 4, 5 and 6 bytes
is fitted by the risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)),

whose second part would be negative only by overfitting; where it is, the step goes the other way.
The class prior is the share of toxic rows among the labels that may be learned from.

The fit uses a bounded sample of rows (`most_positive`, `most_unlabelled`: expected numbers, chosen
by a hash of doc_id); scores cover every whole text.  Features are all whose share of positives exceeds that
of the other documents by four standard deviations; they come from the sample, whose size bounds them.  A null or empty text has no features and the score of the intercept.
Labels that are null, of unknown documents, or held out are not used; without any positive every score
is 0.  A row whose doc_id is null is scored and not learned from.  Repeated rows have each their score, an empty table
gives none; a long text is read in parts that end with words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazetrail.llm.textblocks import LONG, blocks, cut_words, hashes, lean, lower, words

PREFIXES = (4, 5, 6)
SLOTS = 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word and prefix in a block of texts, repeats included."""
    data = lower(data)
    start, end, row = words(data, off)
    ends, starts, rows = [end], [start], [row]
    for k in PREFIXES:
        long = end - start > k
        starts.append(start[long])
        ends.append(start[long] + k)
        rows.append(row[long])
    return hashes(data, np.concatenate(starts), np.concatenate(ends)), np.concatenate(rows)


def _once(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a row, by row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], row[new]


def text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hash, row from the first) of a column's features, a block of texts at a time; repeats
    may be left.  A long text is read in parts, each a block of the same row."""
    for x, y, data, off in blocks(texts):
        if len(data) <= LONG:
            yield x, y, *features(data, off)
        else:  # one text that is long, maybe with empty ones behind it
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                for part in cut_words(lower(data[a:b])):
                    yield x + k, x + k + 1, *features(part, np.array([0, len(part)]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the sample that hold each feature: (h, p, u), summed over each block."""
    for b in batches:
        kind = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "u")])

        def sums(x: int, y: int, h: np.ndarray, row: np.ndarray, kind=kind) -> pa.RecordBatch:
            h, row = _once(h, row)
            key, at = np.unique(h, return_inverse=True)
            found = [np.bincount(at, k[x:y][row], len(key)).astype(np.int64) for k in kind]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, found)], ["h", "p", "u"])

        last, parts = None, []
        for x, y, h, row in text_features(b.column("text")):
            if last and last != (x, y):
                yield sums(*last, np.concatenate(parts), np.zeros(sum(map(len, parts)), np.int64))
                last, parts = None, []
            if y - x == 1:  # maybe a part of a long text: each feature counts once for all of them
                last = x, y
                parts.append(np.unique(h))
            else:
                yield sums(x, y, h, row)
        if last:
            yield sums(*last, np.concatenate(parts), np.zeros(sum(map(len, parts)), np.int64))


class Lookup:
    """Positions of known hashes among many: a table of slots first, then a search."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.slot = np.zeros(SLOTS, bool)
        self.slot[(self.known & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h, position in `known`)."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.slot[(h & np.uint64(SLOTS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, h[near]), len(self.known) - 1)
        same = self.known[at] == h[near]
        return near[same], at[same]


def known_features(texts: pa.Array, table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the table) of the known features of a column, each once a row, by row."""
    rows, size = [np.zeros(0, np.int64)], len(table.known) + 1
    for x, _, h, row in text_features(texts):
        which, at = table.find(h)
        rows.append(np.unique((row[which] + x) * size + at))
    both = np.unique(np.concatenate(rows))
    return both // size, both % size


def _pick(known: np.ndarray):
    """The chosen features of each document of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(known)
        for b in batches:
            out: list[list[int]] = [[] for _ in range(b.num_rows)]
            for r, k in zip(*(v.tolist() for v in known_features(b.column("text"), table))):
                out[r].append(k)
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(out, pa.list_(pa.int64()))], ["p", "u", "at"])

    return run


def risk(w: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, ridge: float = 0.0) -> tuple[float, float, np.ndarray]:
    """(prior * R(positives as 1), R(unlabelled as 0) - prior * R(positives as 0), the gradient to follow) of a linear model
    with weights and intercept `w` on presence features; p and u are the shares of its rows in both sets.

    Where the second part is negative, the gradient is that of its opposite alone.  `ridge` shrinks the weights."""
    n, docs = len(w) - 1, len(p)
    f = np.bincount(rows, w[cols], docs) + w[n]
    s = 1 / (1 + np.exp(-np.clip(f, -50, 50)))
    slope = s * (1 - s)
    above, rest = prior * (p @ (1 - s)), float((u - prior * p) @ s)
    g_rest = (u - prior * p) * slope
    g = g_rest - prior * p * slope if rest >= 0 else -g_rest
    grad = np.append(np.bincount(cols, g[rows], n), g.sum())
    grad[:n] += ridge * w[:n]
    return float(above), rest, grad


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, n: int, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a linear model on presence features: (rows, cols) are the ones of the matrix,
    `positive` and `unlabelled` flag its rows.  Sigmoid loss, which is bounded, so that no positive that is
    far on its side outweighs the unlabelled; Adam."""
    w = np.zeros(n + 1)
    m1, m2 = np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))
    p, u = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum())
    for t in range(1, steps + 1):
        grad = risk(w, rows, cols, p, u, prior, ridge)[2]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 8000) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(feature hashes, weights, intercept), or None without a positive to learn from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n_pos:
        return None
    prior = min(max(n_pos / n, 1e-4), 1 - 1e-4)
    share = lambda salt, most, all_: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, all_)))
    chosen = known.filter((F.col("toxic") == 1) & share("p", most_positive, n_pos)).select("doc_id", F.lit(True).alias("p"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    n_docs = rows.select("doc_id").count()
    # `chosen` has about most_positive rows, whatever the table's size, so it may be broadcast
    sample = rows.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("p", F.lit(False)).alias("p"), share("u", most_unlabelled, n_docs).alias("u")).filter("p or u")
    counts = sample.mapInArrow(lean(_count), "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    got = sample.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    n_p, n_u = (max(1, int(x or 0)) for x in got)
    a, b = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    rest = F.greatest((b - prior * a) / (1 - prior), F.lit(0.5) / (n_u + 1))
    lift = (a - rest) / F.sqrt(rest / n_p)
    best = counts.filter((F.col("p") >= 3) & (a >= 3 * rest)).select("h", lift.alias("z")).filter("z > 4")
    hashes_ = np.sort(np.array([r.h for r in best.collect()], np.int64).view(np.uint64))
    seen = sample.mapInArrow(lean(_pick(hashes_)), "p boolean, u boolean, at array<long>").collect()
    at = [np.array(r["at"], np.int64) for r in seen]
    rows_ = np.repeat(np.arange(len(seen)), [len(x) for x in at])
    cols = np.concatenate(at) if at else np.zeros(0, np.int64)
    flags = np.array([(r.p, r.u) for r in seen], float).reshape(-1, 2)
    w, intercept = fit_nnpu(rows_, cols, flags[:, 0], flags[:, 1], len(hashes_), prior)
    return hashes_, w, intercept


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on) after its own columns; columns of these
    names are replaced."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, intercept = sent.value
        table = Lookup(known)
        for b in batches:
            row, at = known_features(b.column("text"), table)
            f = intercept + np.bincount(row, w[at], b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(f, -50, 50))))], [*b.schema.names, "score"])

    out = docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
