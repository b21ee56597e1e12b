"""Positions, sentences and the features that follow from order within a sentence.

`order` names the columns that give input order; pandas-like "first" and stable sorts are
row numbers over them, never an accident of partitioning.  Null keys stay null: their rows
keep their place but get no position, length or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gazetrail.functions.numeric import flag, to_num


def _last(*columns) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c.asc_nulls_last() for c in columns]


def within(keys: list[str], *order) -> WindowSpec:
    """Rows of equal keys in an order that puts nulls last."""
    return Window.partitionBy(*keys).orderBy(*_last(*order))


def _known(keys: list[str], value: Column) -> Column:
    """`value` where no key is null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return F.when(cond, value)


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in input order of each combination of keys; nulls are alike."""
    w = within(keys, *order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def sort_position(word_id: Column, ordinal: Column) -> Column:
    """The number a word sorts by: its id where that is one, else the row's ordinal."""
    return F.coalesce(to_num(word_id), ordinal.cast("double"))


def positions(df: DataFrame, key: str = "sentence_id", order: list | None = None, name: str = "position_in_sentence") -> DataFrame:
    """1-based position of each row in its sentence."""
    return df.withColumn(name, _known([key], F.row_number().over(within([key], *order))))


def lengths(df: DataFrame, key: str = "sentence_id", name: str = "sentence_length") -> DataFrame:
    """Rows of each sentence, on each of its rows."""
    return df.withColumn(name, _known([key], F.count(F.lit(1)).over(Window.partitionBy(key))))


def distinct_lengths(df: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """Different positions of each sentence, on each of its rows; several readers' rows of a word count once."""
    df = df.withColumn("_nth", F.dense_rank().over(within([key], position)))
    return df.withColumn(name, _known([key], F.max("_nth").over(Window.partitionBy(key)))).drop("_nth")


def numbered(df: DataFrame, keys: list[str], order: list, position: str, length: str) -> DataFrame:
    """1-based position of each row within `keys`, and how many rows there are; one shuffle for both."""
    known = lambda c: _known(keys, c)
    return df.withColumns({position: known(F.row_number().over(within(keys, *order))), length: known(F.count(F.lit(1)).over(Window.partitionBy(*keys)))})


def joined(df: DataFrame, key: str, order: list[str], word: str = "word") -> DataFrame:
    """(key, sentence_text): the words of each sentence in order, joined by spaces."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(word), F.lit("None")).alias("_w"))))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["_w"]), " ").alias("sentence_text"))


def sentences(items: DataFrame, key: str = "sent_id", position: str = "word_pos", word: str = "word") -> DataFrame:
    """(key, sentence_text, word_spans, sent_len) from one row for each word: 0-based half-open spans in characters.

    Where a word begins is a running sum over the words before it, in the one shuffle that gathers the sentence."""
    known = items.filter(F.col(key).isNotNull()).select(key, F.col(position).cast("int").alias("p"), F.col(word).alias("w"))
    before = within([key], "p", "w").rowsBetween(Window.unboundedPreceding, -1)
    rows = known.withColumn("s", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0)).cast("int"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "w", "s"))).alias("_r"))
    spans = F.transform("_r", lambda r: F.struct(r.p.alias("word_pos"), r.w.alias("word"), r.s.alias("start"), (r.s + F.length(r.w)).alias("end")))
    return grouped.select(key, F.array_join("_r.w", " ").alias("sentence_text"), spans.alias("word_spans"), F.size("_r").alias("sent_len"))


def spans_json(spans: Column) -> Column:
    return F.to_json(spans)


def edge_flags(df: DataFrame, position: str = "position_in_sentence", length: str = "sentence_length", names: tuple[str, str] = ("is_sentence_initial", "is_sentence_final")) -> DataFrame:
    """1 on the first and on the last word; 0 where that is unknown."""
    return df.withColumns({names[0]: flag(F.col(position) == 1), names[1]: flag(F.col(position) == F.col(length))})


def previous(df: DataFrame, columns: dict[str, str], keys: list[str], order: list[str]) -> DataFrame:
    """Values of the word before, within reader and sentence: {new name: column}."""
    w = within(keys, *order)
    return df.withColumns({new: _known(keys, F.lag(c, 1).over(w)) for new, c in columns.items()})


def preceding(df: DataFrame, key: str, order: list[str], word: str, size: int | None, name: str = "context") -> DataFrame:
    """The `size` words before each word in its sentence, or all of them; nulls are left out."""
    w = within([key], *order)
    if size is None:
        return df.withColumn(name, F.collect_list(word).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    if size > LAGS:
        return df.withColumn(name, F.collect_list(word).over(w.rowsBetween(-size, -1)))
    before = [F.lag(word, k).over(w) for k in range(size, 0, -1)]
    return df.withColumn(name, F.array_compact(F.array(*before)) if before else F.expr("cast(array() as array<string>)"))


LAGS = 8  # so many words before are columns, which cost less than a list for each row


def first_sentences(df: DataFrame, n: int, key: str = "sentence_id", order: str = "_row_ord") -> DataFrame:
    """The n sentences that appear first: (key)."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_o")).orderBy("_o", key).limit(n).select(key)


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first_at): distinct values with where each comes first."""
    return df.groupBy(column).agg(F.min(order).alias("first_at"))


def rebuild(df: DataFrame, grain: str = "item", order: str = "_row_ord", key: str = "sentence_id") -> DataFrame:
    """Position, length and text of each sentence where the table lacks them or has only nulls.

    With grain "item" a word counts once however many readers saw it (rows with equal sentence and
    word_id); "row" numbers every row, as a table of one reader would be."""
    if grain not in ("item", "row"):
        raise ValueError("grain is item or row")
    at = sort_position(F.col("word_id"), F.col(order))
    have = {c for c in ("position_in_sentence", "sentence_length", "sentence_text") if c in df.columns}
    if have:  # one pass for all three
        seen = df.agg(*(F.count(c).alias(c) for c in sorted(have))).first()
        have = {c for c in have if seen[c]}
    df = df.drop(*({"position_in_sentence", "sentence_length", "sentence_text"} - have)).withColumn("_at", at)
    # all windows are of one sentence, so a table that lies by sentence is not shuffled again
    place = [F.col("_at").asc_nulls_last(), F.col(order).asc_nulls_last()]
    if grain == "item":
        same = within([key, "word_id"], "_at", order)
        df = df.withColumns({"_first": F.row_number().over(same) == 1, "_at0": F.first("_at").over(same), "_ord0": F.first(order).over(same)})
        place = [F.col("_at0").asc_nulls_last(), F.col("_ord0").asc_nulls_last(), F.col("word_id").asc_nulls_last()]
    rank = F.dense_rank() if grain == "item" else F.row_number()
    out = df.withColumn("_position", _known([key], rank.over(Window.partitionBy(key).orderBy(*place))))
    out = out.withColumn("_length", F.max("_position").over(Window.partitionBy(key)).cast("long"))
    new = (out.filter("_first") if grain == "item" else out).filter(F.col(key).isNotNull())
    if "position_in_sentence" not in have:
        out = out.withColumn("position_in_sentence", F.col("_position"))
    if "sentence_length" not in have:
        out = out.withColumn("sentence_length", F.col("_length"))
    if "sentence_text" not in have:
        out = out.join(joined(new, key, ["_at", order]), key, "left")
    return out.drop("_at", "_position", "_length", "_first", "_at0", "_ord0")
