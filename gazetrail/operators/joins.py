"""Joins of features to words; a null key meets a null key, as in the tables this replaces."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazetrail.schema import KEYS
from gazetrail.sources import interim

FEW = 500_000  # words that are broadcast, some 100 bytes each


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on keys of which nulls are alike; the keys of `left` stay."""
    types = dict(left.dtypes), dict(right.dtypes)
    for k in keys:
        if types[0][k] != types[1][k]:
            raise TypeError(f"key {k} is {types[0][k]} on one side and {types[1][k]} on the other")
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[names[k]]) for k in keys))
    return left.join(right, cond, how).drop(*names.values())


def merge_features(base: DataFrame, *features: DataFrame, keys: list[str] | None = None, unique: bool = False) -> DataFrame:
    """`base` with the score columns of each feature table; repeated keys of a feature table repeat rows
    unless `unique` makes them an error."""
    keys = KEYS if keys is None else keys
    for f in features:
        lacking = [k for k in keys if k not in f.columns]
        if lacking:
            raise KeyError(f"a feature table lacks the keys {lacking}")
        scores = [c for c in f.columns if c not in keys]
        if not scores:
            raise ValueError("a feature table has no column but its keys")
        taken = [c for c in scores if c in base.columns]
        if taken:
            raise ValueError(f"columns {taken} are in both tables")
        if unique and f.groupBy(*keys).count().filter("count > 1").first() is not None:
            raise ValueError("a feature table repeats a key")
        base = null_safe(base, f, keys)
    return base


def expand_items(df: DataFrame, scores: DataFrame, keys: tuple[str, str] = ("sentence_id", "word_id")) -> DataFrame:
    """Key columns of every reader's row with the item's score; a repeated item repeats rows.

    Rows and scores lie beside each other in windows of the keys, not in a join, so that what lies by sentence on both sides
    is not shuffled."""
    rows, names = df.select(*dict.fromkeys([*KEYS, *keys])), [c for c in scores.columns if c not in keys]
    types = dict(rows.dtypes), dict(scores.dtypes)
    if any(types[0][k] != types[1][k] for k in keys):
        raise TypeError(f"keys {keys} are of other types in the scores")
    score = F.struct(*names)
    left = rows.withColumn("_score", F.lit(None).cast(scores.select(score).schema[0].dataType))
    right = scores.select(*(F.col(c) if c in keys else F.lit(None).cast(types[0][c]).alias(c) for c in rows.columns), score.alias("_score"))
    met = left.withColumn("_is_row", F.lit(True)).unionByName(right.withColumn("_is_row", F.lit(False)))
    met = met.withColumn("_found", F.collect_list("_score").over(Window.partitionBy(*keys))).filter("_is_row")
    return met.select(*rows.columns, F.explode_outer("_found").alias("_s")).select(*rows.columns, *(F.col(f"_s.{c}").alias(c) for c in names))


def lookup(df: DataFrame, table: DataFrame, column: str, value: str, missing=None) -> DataFrame:
    """`df` with `value` of `table` (column, value) for each `column`; `missing` where there is none."""
    out = df.join(table.select(column, value), column, "left").select(*df.columns, value)
    return out if missing is None else out.withColumn(value, F.coalesce(value, F.lit(missing)))


def common(table: DataFrame, weight: str) -> tuple[DataFrame, DataFrame | None]:
    """A table of words as its FEW most frequent, for a broadcast, and all others; None for those where there are none.

    The words that make up most of a text are few whatever its length, so only the rare ones of its rows need a shuffle."""
    table = interim.written(table, "common")
    if table.count() <= FEW:
        return F.broadcast(table), None
    least, n = float("inf"), 0
    for r in table.groupBy(weight).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(weight)).collect():  # a row for each weight
        n += r["n"]
        if n > FEW:
            break
        least = r[weight]
    often = F.coalesce(F.col(weight) >= F.lit(least), F.lit(False))
    return F.broadcast(table.filter(often)), table.filter(~often)


def with_words(df: DataFrame, column: str, table: DataFrame, key: str, weight: str, deal=lambda d: d) -> DataFrame:
    """The rows of `df` whose `column` is a `key` of `table`; `deal` puts those of rare words where the others lie."""
    often, seldom = common(table.select(key, weight), weight)
    here = F.col(column) == F.col(key)
    found = df.join(often, here, "left_semi")
    return found if seldom is None else found.unionByName(deal(df.join(often, here, "left_anti").join(seldom, here, "left_semi")))


def _flat(spans: pa.Array, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an array of lists, and where each list ends."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy().astype(np.int64))
    return pc.fill_null(spans.flatten(), fill).to_numpy(zero_copy_only=False).astype(np.int64), ends


def _pairs(t_start: pa.Array, t_end: pa.Array, w_start: pa.Array, w_end: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens and words that overlap, as places in the numbers of all rows; each one's row; where each row's tokens and words end.

    All rows lie one after the other on one line, words by where they start, so a token's words are those between two places that
    are searched for: the work grows with tokens and pairs, not with tokens times words."""
    low, high = -(1 << 31), (1 << 31) - 1  # a bound that is null bounds nothing
    (a, t_ends), (b, _), (s, w_ends), (e, _) = _flat(t_start, low), _flat(t_end, high), _flat(w_start, low), _flat(w_end, high)
    t_row, w_row = (np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) for ends in (t_ends, w_ends))
    t_at, w_at = t_row * (1 << 33), w_row * (1 << 33)
    by = np.argsort(s + w_at, kind="stable")
    first = np.searchsorted(np.maximum.accumulate((e + w_at)[by]), a + t_at, side="right")
    n = np.maximum(np.searchsorted((s + w_at)[by], b + t_at, side="left") - first, 0)
    t = np.repeat(np.arange(len(a)), n)
    w = by[np.arange(len(t)) + np.repeat(first - (np.cumsum(n) - n), n)]
    true = np.maximum(a[t], s[w]) < np.minimum(b[t], e[w])
    return t[true], w[true], t_row, t_ends, w_ends


def _meet(*spans: pa.Array) -> pa.Array:
    t, w, t_row, t_ends, w_ends = _pairs(*spans)
    row = t_row[t]
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(t_ends)))])
    places = [pa.array((x - np.concatenate([[0], ends])[row]).astype(np.int32)) for x, ends in ((t, t_ends), (w, w_ends))]
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(places, ["t", "w"]))


def overlaps(t_start: Column, t_end: Column, w_start: Column, w_end: Column) -> Column:
    """Pairs (t, w) of places, from 0, in a row's arrays of tokens and words whose spans overlap."""
    return F.arrow_udf(_meet, "array<struct<t: int, w: int>>")(t_start, t_end, w_start, w_end)


def _sums(values: pa.Array, *spans: pa.Array) -> pa.Array:
    t, w, _, _, w_ends = _pairs(*spans)
    n = int(w_ends[-1]) if len(w_ends) else 0
    none = np.bincount(w, minlength=n) == 0
    total = np.bincount(w, values.flatten().to_numpy(zero_copy_only=False)[t], n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], w_ends]).astype(np.int32)), pa.array(total, mask=none))


def overlap_sums(values: Column, t_start: Column, t_end: Column, w_start: Column, w_end: Column) -> Column:
    """For each word of a row's array, the sum of the values of the tokens that it overlaps, in doubles; null without any."""
    return F.arrow_udf(_sums, "array<double>")(values.cast("array<double>"), t_start, t_end, w_start, w_end)


def span_overlaps(tokens: DataFrame, words: DataFrame, key: str = "sentence_id") -> DataFrame:
    """Tokens (key, token_index, start, end, ...) with each word (key, word_index, start, end) they overlap.
    Empty tokens at 0 are special ones and meet nothing; a token may meet two words.

    Tokens and words of a sentence meet as two arrays in one row."""
    t = tokens.filter(~((F.col("start") == 0) & (F.col("end") == 0)) & F.col(key).isNotNull())
    t = t.groupBy(key).agg(F.collect_list(F.struct(*(c for c in t.columns if c != key))).alias("_t"))
    w = words.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("word_index", "start", "end")).alias("_w"))
    places = overlaps(*(F.col(c).cast("array<int>") for c in ("_t.start", "_t.end", "_w.start", "_w.end")))
    met = t.join(w, F.col(key) == F.col("_key")).select(key, "_t", "_w", places.alias("_p"))
    # the pairs are filled in where they are an array, so that no row of one carries its sentence's arrays
    met = met.select(key, F.explode(F.transform("_p", lambda p: F.struct(F.get("_t", p.t).alias("t"), F.get("_w", p.w)["word_index"].alias("i")))).alias("_p"))
    return met.select(*(key if c == key else F.col(f"_p.t.{c}") for c in tokens.columns), F.col("_p.i").alias("word_index"))
