"""N-gram language models as tables: add-alpha smoothing, and interpolated Kneser-Ney.

A sentence is an array of words; a model is two tables, n-grams with their counts and
histories with theirs.  Words have no white space, so an n-gram's key is its words joined by spaces.
Scores use no begin marks: the first word of a sentence is scored alone, the next after one word, and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gazetrail.functions.numeric import surprisal_bits
from gazetrail.functions.text import BOS, EOS, UNK, padded
from gazetrail.operators import counting, joins
from gazetrail.operators.sentence import preceding, within
from gazetrail.sources import interim


@dataclass
class Model:
    order: int
    alpha: float
    unigrams: DataFrame  # word, c, h; the marks included, some with 0
    size: int  # of the vocabulary, marks included
    total: int  # unigrams, begin and end marks included
    count: Callable[[list[int]], DataFrame]  # of orders: n, ngram, c, h: how often it comes, and how often a word follows
    single: DataFrame  # the same of order 1, written
    starts: Callable[[], DataFrame]  # _a, _b3, ..., one for each order from 3: what stands at each place of the sentences

    @cached_property
    def counts(self) -> DataFrame:
        """(n, ngram, c, h) of all orders; those above 1 are counted and written when first asked for."""
        if self.order == 1:
            return self.single
        return interim.written(self.count(list(range(2, self.order + 1))), "ngrams").unionAll(self.single)

    @property
    def histories(self) -> DataFrame:
        """(n, history, c): what n-grams are preceded by is the shorter n-grams that a word follows."""
        below = list(range(2, self.order))
        some = self.counts if "counts" in self.__dict__ else self.count(below).unionAll(self.single) if below else self.single
        return some.filter((F.col("n") < self.order) & (F.col("h") > 0)).select((F.col("n") + 1).alias("n"), F.col("ngram").alias("history"), F.col("h").alias("c"))

    @property
    def vocab(self) -> DataFrame:
        return self.unigrams.select("word")


def vocabulary(sentences: DataFrame, min_count: int = 1, words: str = "words") -> DataFrame:
    """(word, n): lower-cased words that come `min_count` times at least."""
    return sentences.select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def ngrams(sentences: DataFrame, order: int, words: str = "words", only: list[int] | None = None) -> DataFrame:
    """(n, ngram, c, h) for n = 1 to order, or `only` some of them, over sentences padded for the order, of lower-cased words; h
    counts those that a word follows."""
    return counting.counted(sentences, order, words, only or list(range(1, order + 1)))


def starts(sentences: DataFrame, order: int, words: str = "words") -> DataFrame:
    """(_a, _b3, ..., _b<order>): two words and each of those after them, null beyond the end, for each place of the padded
    sentences that has a next.  All n-grams above 1 are beginnings of these rows, so none needs rows of its own."""
    row = padded(F.transform(words, lambda w: F.lower(w)), order)
    after = [F.get("p", F.col("i") + (n - 1)).alias(f"_b{n}") for n in range(3, order + 1)]
    # a padded sentence has two words at least, as its order is above 1
    places = sentences.select(row.alias("p")).select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 2)).alias("i"))
    return places.select(F.concat_ws(" ", F.get("p", F.col("i")), F.get("p", F.col("i") + 1)).alias("_a"), *after)


def known_words(sentences: DataFrame, vocab: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Sentences whose words outside the vocabulary (word, n) are the unknown mark.  Sentences that lie by `key` are not
    shuffled, nor are frequent words."""
    often, seldom = joins.common(vocab.select(F.col("word").alias("_k"), "n"), "n")
    rows = sentences.select(key, F.posexplode(words).alias("i", "w")).withColumn("w", F.lower("w"))
    here = F.col("w") == F.col("_k")
    flagged = rows.join(often.drop("n"), here, "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w", F.col("_k").isNotNull().alias("in")))).alias("_r"))
    if seldom is None:
        return flagged.select(key, F.transform("_r", lambda x: F.when(x["in"], x.w).otherwise(UNK)).alias(words))
    # rare words of the vocabulary, a set for each sentence that has some
    rare = rows.join(often, here, "left_anti").select(key, "w").join(seldom, here, "left_semi")
    rare = rare.groupBy(F.col(key).alias("_key")).agg(F.collect_set("w").alias("_rare"))
    met = flagged.join(rare, F.col(key) == F.col("_key"), "left").withColumn("_rare", F.coalesce("_rare", F.expr("cast(array() as array<string>)")))
    return met.select(key, F.transform("_r", lambda x: F.when(x["in"] | F.array_contains("_rare", x.w), x.w).otherwise(UNK)).alias(words))


def fit(sentences: DataFrame, order: int = 5, alpha: float = 0.1, min_count: int = 1, key: str = "sentence_id", words: str = "words") -> Model:
    """The vocabulary is the single words of the counts; longer n-grams are counted once, if they are asked for."""
    if min_count > 1:
        sentences = known_words(sentences, vocabulary(sentences, min_count, words), key, words)
    count = lambda only: ngrams(sentences, order, words, only)
    single = interim.written(count([1]).drop("n"), "words").select(F.lit(1).alias("n"), "ngram", "c", "h")
    marks = sentences.sparkSession.createDataFrame([(m, 0, 0) for m in (BOS, EOS, UNK)], "word string, c long, h long")
    unigrams = single.select(F.col("ngram").alias("word"), "c", "h").unionAll(marks).groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    size, total = unigrams.agg(F.count(F.lit(1)), F.sum("c")).first()
    return Model(order, alpha, unigrams, size, total, count, single, lambda: starts(sentences, order, words))


def _aside(wanted: Column, key: Column) -> Column:
    """A join's key; rows that want no partner get one that nothing has, of many kinds, so that they don't meet in one task."""
    return F.when(wanted, key).otherwise(F.concat(F.lit(" "), F.pmod(F.monotonically_increasing_id(), F.lit(9973)).cast("string")))


def _contexts(model: Model, words: DataFrame, key: str, position: str, word: str) -> DataFrame:
    """Words with `_w`, in the vocabulary, its counts `_uc` and `_uh`, `_c`, the words before, order - 1 at most, and `_ph`, the
    count `_uh` of the last of them."""
    table = model.unigrams.select(F.col("word").alias("_k"), F.col("c").alias("_uc"), F.col("h").alias("_uh"))
    unknown = table.filter(F.col("_k") == UNK).first()
    often, seldom = joins.common(table, "_uc")
    low, here = words.withColumn("_low", F.lower(word)), F.col("_low") == F.col("_k")
    rows = low.join(often, here, "left")
    if seldom is not None:  # rare words come back as a map for each sentence that has some, so that sentences stay where they lie
        rare = low.join(often, here, "left_anti").select(F.col(key).alias("_key"), "_low").join(seldom, here)
        rare = rare.groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("_k", F.struct("_uc", "_uh")))).alias("_rare"))
        same = F.col(key).eqNullSafe(F.col("_key")) if words.schema[key].nullable else F.col(key) == F.col("_key")
        found = F.try_element_at("_rare", F.col("_low"))
        rows = rows.join(rare, same, "left").withColumns({"_k": F.coalesce("_k", F.when(found.isNotNull(), F.col("_low"))), "_uc": F.coalesce("_uc", found["_uc"]), "_uh": F.coalesce("_uh", found["_uh"])}).drop("_key", "_rare")
    known = {"_w": F.coalesce("_k", F.lit(UNK)), "_uc": F.coalesce("_uc", F.lit(unknown["_uc"])), "_uh": F.coalesce("_uh", F.lit(unknown["_uh"]))}
    rows = rows.withColumns(known).drop("_k", "_low")
    if model.order == 1:
        return rows
    rows = preceding(rows, key, [position], "_w", model.order - 1, "_c")
    return rows.withColumn("_ph", F.lag("_uh", 1).over(within([key], position)))


def _count(rows: DataFrame, model: Model, what: str, n: Column, key: Column, wanted: Column, name: str) -> DataFrame:
    """`rows` with a count of the n-grams that `key` names, where it is `wanted`."""
    table = model.counts.filter("n > 1").select(F.col("ngram").alias("_g"), F.col("n").alias("_gn"), F.col(what).alias(name))
    rows = rows.withColumns({"_key": _aside(wanted, key), "_kn": n})
    return rows.join(table, (F.col("_key") == F.col("_g")) & (F.col("_kn") == F.col("_gn")), "left").drop("_g", "_gn", "_key", "_kn")


PART_ROWS = 2_000_000  # rows of words and of the model's places for each task that counts them


def _counted(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` with `_n`, the words of the history `_c`, `_gc`, how often `_c` and `_w` stand together in the model's sentences, and from order 3 `_hc`, how often a word
    follows `_c`; both null for a word without a history, and `_hc` for a history of one word.

    Words and the model's places meet in one shuffle by their first two words.  There, the n-grams of all orders are
    running groups of one sort, and no table of n-grams is made."""
    after = [f"_b{n}" for n in range(3, model.order + 1)]
    all_ = F.concat("_c", F.array("_w"))
    first = _aside(F.size("_c") > 0, F.concat_ws(" ", F.get(all_, F.lit(0)), F.get(all_, F.lit(1))))
    asked = rows.select(*rows.columns, F.size("_c").alias("_n"), first.alias("_a"), *(F.get(all_, F.lit(n - 1)).alias(f"_b{n}") for n in range(3, model.order + 1))).drop("_c", "_w")
    empty = [F.lit(None).cast(t).alias(c) for c, t in asked.dtypes if c not in {"_a", *after}]
    both = asked.unionByName(model.starts().select(*empty, "_a", *after))
    place = F.col("_n").isNull()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(max(parts, -(-2 * model.total // PART_ROWS)), "_a")
    for n in range(model.order, 1, -1):  # the longest first: its order serves all others
        group = Window.partitionBy("_a", *after[: n - 2])
        both = both.withColumn(f"_t{n}", F.count_if(place).over(group))
        if n < model.order:
            both = both.withColumn(f"_h{n}", F.count_if(place & F.col(after[n - 2]).isNotNull()).over(group))
    of = lambda kind, low, high, less: F.coalesce(*(F.when(F.col("_n") == n - less, F.col(f"_{kind}{n}")) for n in range(low, high + 1)))
    out = both.filter(~place).withColumn("_gc", of("t", 2, model.order, 1))
    out = out.withColumn("_hc", of("h", 2, model.order - 1, 0)) if model.order > 2 else out
    return out


def score(model: Model, words: DataFrame, key: str = "sentence_id", position: str = "position_in_sentence", word: str = "word_clean", name: str | None = None) -> DataFrame:
    """`words` with the surprisal of each in bits.

    With alpha above 0 the longest history always answers; with alpha 0 the longest history that was seen does, else
    all words alone.  Counts of single words, alone or as a history, come with the vocabulary, so a word
    without a history, and a history of one word, need no join of their own."""
    name = name or f"ngram{model.order}_surprisal"
    rows = _contexts(model, words, key, position, word)
    alpha, size = F.lit(float(model.alpha)), F.lit(float(model.size))
    alone = (F.col("_uc") + alpha) / (F.lit(float(model.total)) + alpha * size)
    p = alone if model.total + model.alpha * model.size > 0 else 1 / size
    if model.order > 1 and model.alpha > 0:
        # what is known before the shuffle, in one column: a first word's probability, or how often a history of one word is followed
        rows = rows.withColumn("_v", F.when(F.size("_c") == 0, p).when(F.size("_c") == 1, F.col("_ph").cast("double"))).drop("_uc", "_uh", "_ph")
        rows = _counted(rows, model)
        among = F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.col("_hc")) if model.order > 2 else F.col("_v")
        p = F.when(F.col("_n") == 0, F.col("_v")).otherwise((F.col("_gc") + alpha) / (among + alpha * size))
    elif model.order > 1:
        for n in range(2, model.order + 1):
            past, long = F.array_join(F.slice("_c", -(n - 1), n - 1), " "), F.size("_c") >= n - 1
            rows = rows.withColumn(f"_h{n}", F.when(long, F.col("_ph"))) if n == 2 else _count(rows, model, "h", F.lit(n - 1), past, long, f"_h{n}")
            seen = F.coalesce(f"_h{n}", F.lit(0)) > 0
            rows = _count(rows, model, "c", F.lit(n), F.concat_ws(" ", past, "_w"), seen, f"_g{n}")
            p = F.when(seen, F.coalesce(f"_g{n}", F.lit(0)) / F.col(f"_h{n}")).otherwise(p)
    return rows.select(*words.columns, surprisal_bits(p).alias(name))


def kneser_ney(sentences: DataFrame, order: int = 2, discount: float = 0.1, words: str = "words") -> DataFrame:
    """(ngram, history, word, p): interpolated Kneser-Ney probabilities of the n-grams seen, of the given
    order; the lowest order is the share of distinct words each word follows."""
    # each order by itself: a filter on counts of all orders would make the n-grams of every order for each that it keeps
    counts = lambda n: ngrams(sentences, order, words, [n])
    word = lambda c: F.element_at(F.split(c, " "), -1)
    less = lambda c: F.array_join(F.slice(F.split(c, " "), 2, order), " ")
    top = counts(order).select("ngram", F.expr("substring_index(ngram, ' ', n - 1)").alias("history"), F.col("c").cast("double").alias("c"))
    tables = {order: top}
    for n in range(order - 1, 0, -1):  # how many different words an n-gram follows
        above = counts(n + 1).select(less(F.col("ngram")).alias("ngram"))
        t = above.groupBy("ngram").agg(F.count(F.lit(1)).cast("double").alias("c"))
        tables[n] = t.withColumn("history", F.array_join(F.slice(F.split("ngram", " "), 1, n - 1), " ") if n > 1 else F.lit(""))
    total = tables[1].agg(F.sum("c").alias("_t"))
    p = tables[1].join(F.broadcast(total)).select(F.col("ngram").alias("_low"), (F.col("c") / F.col("_t")).alias("_p"))
    for n in range(2, order + 1):
        t = tables[n]
        own = t.groupBy("history").agg(F.sum("c").alias("_sum"), F.count(F.lit(1)).alias("_kinds"))
        t = t.join(own, "history").withColumn("_low", less(F.col("ngram"))).join(p, "_low", "left")
        value = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("_sum") + F.lit(discount) * F.col("_kinds") / F.col("_sum") * F.coalesce("_p", F.lit(0.0))
        t = t.select("ngram", "history", value.alias("p"))
        p = t.select(F.col("ngram").alias("_low"), F.col("p").alias("_p"))
    return t.select("ngram", "history", word(F.col("ngram")).alias("word"), "p")
