"""What the findings of larger tables asked for: work and shuffles that grow no faster than the input."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetrail.functions import numeric
from gazetrail.operators import counting, joins, ngram, regression, scoring, sentence
from gazetrail.plans import corpus, queries
from gazetrail.sources import interim

SF = "/root/testdata/sf0.001"


class Counting(scoring.StandIn):
    """Counts the characters it encodes and how often it is asked for scores."""

    def __init__(self, masked=False):
        super().__init__(masked)
        self.read = self.asked = 0

    def encode(self, text):
        self.read += len(text)
        return super().encode(text)

    def scores(self, ids, places):
        self.asked += 1
        return super().scores(ids, places)


WORDS = [["ab", "c", "", "dearest", "e"], ["", "x", "yy"], ["", "", "longer", "word"], ["one"], [""], []]


def test_causal_scores_are_linear_in_the_sentence():
    """F1"""
    class Slow(Counting):
        additive = False

    for words in [*WORDS, *([random.Random(k).choice(["a", "bcd", "efghij", ""]) for _ in range(40)] for k in range(5))]:
        for begin in (0, None):
            quick, slow = Counting(), Slow()
            quick.begin = slow.begin = begin
            got, want = scoring.Causal(quick).tokens(words), scoring.Causal(slow).tokens(words)
            assert [t[:3] for t in got] == [t[:3] for t in want]
            assert [t[3] for t in got] == pytest.approx([t[3] for t in want])
    model = Counting()
    scoring.Causal(model).tokens(["word"] * 300)
    assert model.read <= 300 * 5 and model.asked == 1


def test_masked_scores_come_at_once():
    """F24"""
    class Slow:
        def __init__(self):
            self.of, self.mask = Counting(True), 3

        encode_with_spans = lambda self, *a: self.of.encode_with_spans(*a)
        scores = lambda self, *a: self.of.scores(*a)

    for words in WORDS:
        for length in (2, 4, 20):
            assert scoring.Masked(Counting(True), length).tokens(words) == scoring.Masked(Slow(), length).tokens(words)
    model = Counting(True)
    scoring.Masked(model).tokens(["word"] * 300)
    assert model.asked == 0
    assert np.asarray(model.scores([1, 5, 2], [1])).shape == (1, 64)


def shuffled(df):
    """Rows of shuffles in the plan as it was run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.split("\n") if " Exchange " in line]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["standard_table", "row_grain", "word_spans", "sentence_text", "spans_json"])
def test_sentences_are_shuffled_as_lines(spark, name):
    """lines are dealt out once, words never."""
    found = shuffled(queries.queries()[name](spark, SF))
    assert all("RoundRobin" in x or "sent_id" in x and "REPARTITION_BY_NUM" in x for x in found) and found


def test_runs_find_what_is_out_of_order():
    """the order of a file is checked where it lies."""
    import pyarrow as pa

    of = lambda rows: pa.RecordBatch.from_pylist([{"i": i, "sentence_id": s, "position_in_sentence": p, "participant_id": r} for i, s, p, r in rows])
    far = 1 << 33
    got = [b.to_pylist()[0] for b in queries._runs([of([(0, "a", 1, "x"), (1, "a", 2, "x"), (2, "a", 2, "w")]), of([(3, "A", 1, "x"), (far, "b", 1, "x")]), of([(far + 1, "b", 1, "x")])])]
    assert [(r["i"], r["n"], r["bad"], r["a"], r["y"], r["z"]) for r in got] == [(0, 4, 2, "a", "A", 1), (far, 2, 0, "b", "b", 1)]


def test_logarithms_of_doubles(spark):
    """logarithms of doubles are what they are by way of text."""
    cells = ["5", "007", "-3", "+4", " 8 ", "-0", "1d", "1.5", "9223372036854775808", "1e999", "\x015", "", None, "NaN", "Infinity", "٣"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    d = rows.select(F.col("c").try_cast("double").alias("x")).withColumn("y", F.col("x").cast("string"))
    assert d.filter(~numeric.log_of_double(F.col("x")).eqNullSafe(numeric.safe_log(F.col("y")))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_a_reading_is_worked_out_once(spark):
    """the remainder that makes a time is in no projection or filter, only where rows are made."""
    plan = queries.queries()["variant_table"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert all("Generate" in line for line in plan.split("\n") if "% 900" in line)


def test_longer_ngrams_are_counted_when_asked_for(spark):
    """totals and the vocabulary need single words only, histories nothing of the top order."""
    rows = spark.createDataFrame([("s", ["a", "b", "a", "c"])], "sentence_id string, words array<string>")
    since = interim.mark()
    model = ngram.fit(rows, 3)
    assert (model.total, model.size) == (7, 6)
    assert not [path for _, path in interim._made[since:] if "/ngrams-" in path]
    want = {(2, "<s>", 2), (2, "a", 2), (2, "b", 1), (2, "c", 1), (3, "<s> <s>", 1), (3, "<s> a", 1), (3, "a b", 1), (3, "b a", 1), (3, "a c", 1)}
    assert {tuple(r) for r in model.histories.collect()} == want
    assert model.counts.count() == 5 + 6 + 5 and {tuple(r) for r in model.histories.collect()} == want


def test_kneser_ney_makes_each_order_once(spark):
    """no explode makes n-grams of orders that a filter then drops."""
    rows = spark.createDataFrame([(["a", "b", "a", "c"],)], "words array<string>")
    plan = ngram.kneser_ney(rows, 3)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.split("\n") if "Generate explode(" in line]
    assert made and all("concat(transform" not in line or line.count("transform(sequence") <= 1 for line in made)
    assert not [line for line in plan.split("\n") if "Filter" in line and "g#" in line and ".n = " in line]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["items_table", "sentences_table", "wordlevel_table"])
def test_trials_are_shuffled_as_lines(spark, name):
    """Lines are dealt out by the key that the trial layout forms, words and readings never."""
    found = shuffled(queries.queries()[name](spark, SF))
    words = [x for x in found if "RoundRobin" not in x and "REPARTITION_BY_NUM" not in x]
    assert len(found) > len(words) and all("participant_id" in x and "sent_id" not in x for x in words)


def test_distinct_lengths(spark):
    """what several readers saw counts once, a null sentence has no length."""
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 1, "b"), ("s", 4, "a"), ("t", 2, "b"), (None, 1, "a")], "s string, p int, r string")
    got = {tuple(x) for x in sentence.distinct_lengths(rows, "s", "p", "n").collect()}
    assert got == {("s", 1, "a", 2), ("s", 1, "b", 2), ("s", 4, "a", 2), ("t", 2, "b", 1), (None, 1, "a", None)}


def test_a_group_is_shuffled_as_its_size(spark):
    """of a group its size and folds are written, sums are of folds only, and whole numbers are keys as they are."""
    rows = spark.createDataFrame([(k // 3, float(k % 7), float(k % 5) + k % 7) for k in range(300)], "g bigint, x double, y double")
    since = interim.mark()
    cv = regression.cross_validate(rows, "y", ["x"], "g")
    made = {path.rsplit("/", 1)[1].split("-")[1]: spark.read.parquet(path) for _, path in interim._made[since:]}
    assert set(made) == {"sizes", "ranks", "rows"}
    assert sorted(made["sizes"].columns) == ["b0_n", "g"] and dict(made["sizes"].dtypes)["g"] == "bigint"
    assert dict(cv.predictions.dtypes)["g"] == "string" and cv.predictions.count() == 300
    text = regression.cross_validate(rows.withColumn("g", F.col("g").cast("string")), "y", ["x"], "g")
    key = lambda c: sorted((r["g"], r["fold"], r["y"], round(r["prediction"], 9)) for r in c.predictions.collect())
    assert key(cv) == key(text)


@pytest.mark.parametrize("few", [0, 2, 100])
def test_rare_words_are_looked_up_too(spark, monkeypatch, few):
    """Frequent words by a broadcast, all others by a shuffle, whatever may be broadcast."""
    monkeypatch.setattr(joins, "FEW", few)
    lines = {"s": ["A", "b", "x", "a", None], "t": ["c", "b", "a", "z"], "u": ["q"]}
    rows = spark.createDataFrame(list(lines.items()), "k string, words array<string>")
    vocab = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1), ("d", 1)], "word string, n long")
    assert (joins.common(vocab, "n")[1] is None) == (few == 100)
    got = {r["k"]: r["words"] for r in ngram.known_words(rows, vocab, "k").collect()}
    assert got == {"s": ["a", "b", "<unk>", "a", "<unk>"], "t": ["c", "b", "a", "<unk>"], "u": ["<unk>"]}
    words = spark.createDataFrame([(w,) for w in ["a", "a", "c", "z", "", None]], "w string")
    assert sorted(r["w"] for r in joins.with_words(words, "w", vocab, "word", "n").collect()) == ["a", "a", "c"]
    zipf = vocab.select("word", F.col("n").cast("double").alias("zipf"))
    got = corpus.frequencies(words, "w", zipf, "f").collect()
    assert sorted((r["w"] or "-", r["f"] if r["f"] is not None else -1) for r in got) == [("-", -1), ("-", -1), ("a", 4), ("a", 4), ("c", 1), ("z", 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_known_words_are_not_shuffled(spark):
    """lines and the vocabulary's counts are shuffled, words are not."""
    found = shuffled(queries.queries()["oov_map"](spark, SF))
    assert found and all("REPARTITION_BY_NUM" in x for x in found)


@pytest.mark.parametrize("order,few", [(2, 100), (3, 100), (4, 100), (3, 0), (3, 3)])
def test_places_give_all_counts(spark, monkeypatch, order, few):
    """a word is scored in one shuffle with the model's places, and no table of n-grams is written."""
    monkeypatch.setattr(joins, "FEW", few)
    lines = [["a", "b", "a", "c"], ["a"], ["b", "a", "c", "a", "b"], ["<s>", "a", "<s>", "<s>", "b"]]
    train = spark.createDataFrame([(str(k), x) for k, x in enumerate(lines)], "sentence_id string, words array<string>")
    since = interim.mark()
    model = ngram.fit(train, order, 0.5)
    asked = ["b", "a", "c", "zz", "a", "b", "<s>", "<s>", "a"]
    words = spark.createDataFrame([("q", i, w) for i, w in enumerate(asked)], "sentence_id string, position_in_sentence int, word_clean string")
    scored = ngram.score(model, words, name="s")
    assert sum(" hashpartitioning(_a" in x for x in shuffled(scored)) == 1
    got = [r["s"] for r in scored.orderBy("position_in_sentence").collect()]
    assert not [path for _, path in interim._made[since:] if "/ngrams-" in path]
    padded = [["<s>"] * (order - 1) + x + ["</s>"] for x in lines]
    grams = [tuple(p[i : i + n]) for p in padded for n in range(1, order + 1) for i in range(len(p) - n + 1)]
    known = {g[0] for g in grams if len(g) == 1} | {"<s>", "</s>", "<unk>"}
    asked = [w if w in known else "<unk>" for w in asked]
    for i, w in enumerate(asked):
        past = tuple(asked[max(0, i - order + 1) : i])
        below = sum(len(g) == len(past) + 1 and g[:-1] == past for g in grams)
        assert got[i] == pytest.approx(-np.log2((grams.count((*past, w)) + 0.5) / (below + 0.5 * len(known))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("few", [100, 1_000_000])
def test_items_are_expanded_where_they_lie(spark, monkeypatch, few):
    """readers' rows and frequent words' scores are not shuffled, rare words' come back to their sentence."""
    want = queries.queries()["expand_item_feature"](spark, SF).collect()
    monkeypatch.setattr(joins, "FEW", few)
    df = queries.queries()["expand_item_feature"](spark, SF)
    assert sorted(df.collect()) == sorted(want)
    dealt = [x for x in shuffled(df) if "REPARTITION_BY_NUM" not in x]
    assert not [x for x in dealt if "sent_id" in x or "sentence_id" in x]


def test_expanded_items_as_in_a_join(spark):
    """nulls are alike, repeated items repeat rows, rows without one stay."""
    rows = spark.createDataFrame([("p", "s", 1), ("q", "s", 1), ("p", None, 1), ("p", "t", 2)], "participant_id string, sentence_id string, word_id int")
    scores = spark.createDataFrame([("s", 1, 5), ("s", 1, None), (None, 1, 7), ("z", 1, 8)], "sentence_id string, word_id int, score int")
    got = {tuple(r) for r in joins.expand_items(rows, scores).collect()}
    assert got == {("p", "s", 1, 5), ("p", "s", 1, None), ("q", "s", 1, 5), ("q", "s", 1, None), ("p", None, 1, 7), ("p", "t", 2, None)}


def counted(lines, order, orders):
    """{(n, ngram): [c, h]} as a loop counts them."""
    out = {}
    for words in lines:
        p = ["<s>"] * (order - 1) + [w.lower() for w in words] + ["</s>"]
        for n in orders:
            for i in range(len(p) - n + 1):
                found = out.setdefault((n, " ".join(p[i : i + n])), [0, 0])
                found[0] += 1
                found[1] += i + n < len(p)
    return out


LINES = [[random.Random(k * 99 + i).choice(["a", "B", "c", "<s>", "</s>", "\u03a3\u0391\u03a3", "\u0130x", "dd"]) for i in range(k % 12)] for k in range(150)]


@pytest.mark.parametrize("block,held", [(8_000_000, 64_000_000), (50, 30)])
def test_ngrams_of_blocks_add_up(spark, monkeypatch, block, held):
    """whatever is counted at once, all n-grams of all orders come with both counts."""
    monkeypatch.setattr(counting, "BLOCK", block)
    monkeypatch.setattr(counting, "HELD", held)
    monkeypatch.setattr(counting, "ROWS", 7)
    rows = spark.createDataFrame([(x,) for x in [*LINES, None]], "words array<string>").repartition(3)
    for order, only in [(1, None), (2, None), (3, None), (4, [4]), (5, [2, 3, 4, 5])]:
        got = {(r["n"], r["ngram"]): [r["c"], r["h"]] for r in ngram.ngrams(rows, order, only=only).collect()}
        assert got == counted(LINES, order, only or range(1, order + 1))


@pytest.mark.parametrize("widest", [1 << 61, 2000, 200])
def test_ngrams_too_many_for_a_number(monkeypatch, widest):
    """where words are too many kinds for an n-gram to be one number, its beginnings get numbers of their own."""
    import pyarrow as pa

    monkeypatch.setattr(counting, "WIDEST", widest)
    texts = pa.array(["".join(w.lower() + "\n" for w in words) for words in LINES])
    of = counting.families([1, 2, 3, 4, 5])
    packs = counting.pack(5, of, 3, 100)(iter([pa.RecordBatch.from_arrays([texts[k : k + 9]], ["text"]) for k in range(0, 150, 9)]))
    by, got = {}, Counter()
    for r in (r for b in packs for some in b.column(0).to_pylist() for r in some):
        by.setdefault(r["part"], []).append(r)
    for part in by.values():
        for b in counting.unpack(of, 100)(iter([pa.RecordBatch.from_pylist(part)])):
            for r in b.to_pylist():
                assert (r["n"], r["ngram"]) not in got
                got[r["n"], r["ngram"]] = [r["c"], r["h"]]
    assert got == counted(LINES, 5, range(1, 6)) and len(by) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_ngrams_are_shuffled_as_packs(spark):
    """no n-gram is a row of a shuffle, nor of a hash table that spills."""
    df = queries.queries()["ngram_counts"](spark, SF)
    assert not [x for x in shuffled(df) if "ngram" in x]
    assert "HashAggregate(keys=[ngram" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "g#" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_words_of_lines(spark):
    """lines without the blanks around them have the words that they have with them."""
    assert spark.range(1).select(F.split(F.btrim(F.lit(" \t\r a  b\r\tc\u00a0 \r"), F.lit(" \r\t")), "[ \\r\\t]+").alias("w")).first()["w"] == ["a", "b", "c\u00a0"]
    got = queries._sentences(spark, SF)
    want = queries.words(spark, SF).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("word_pos", "word"))).alias("r")).select("sent_id", F.col("r.word").alias("w"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_overlaps_are_searched_for(spark):
    """spans in any order, empty and nested ones too, meet as in a comparison of all pairs."""
    rng = random.Random(3)
    spans = lambda: [(x, x + rng.randrange(-1, 6)) for x in (rng.randrange(25) for _ in range(rng.randrange(7)))]
    rows = [(f"s{k}", spans(), spans()) for k in range(60)]
    meet = lambda a, b: max(a[0], b[0]) < min(a[1], b[1])
    want = sorted((s, i, a, j) for s, ts, ws in rows for i, a in enumerate(ts) if a != (0, 0) for j, b in enumerate(ws) if meet(a, b))
    tokens = spark.createDataFrame([(s, i, *a) for s, ts, _ in rows for i, a in enumerate(ts)], "sentence_id string, token_index int, start int, end int")
    words = spark.createDataFrame([(s, j, *b) for s, _, ws in rows for j, b in enumerate(ws)], "sentence_id string, word_index int, start int, end int")
    met = joins.span_overlaps(tokens, words)
    assert met.columns == ["sentence_id", "token_index", "start", "end", "word_index"]
    assert sorted((r[0], r[1], (r[2], r[3]), r[4]) for r in met.collect()) == want
    df = spark.createDataFrame(rows, "s string, t array<struct<start: int, end: int>>, w array<struct<start: int, end: int>>")
    got = df.select("s", joins.overlap_sums(F.transform("t", lambda x, i: i + 1), F.col("t.start"), F.col("t.end"), F.col("w.start"), F.col("w.end")).alias("x")).collect()
    hits = {s: [[i + 1 for i, a in enumerate(ts) if meet(a, b)] for b in ws] for s, ts, ws in rows}
    assert {r["s"]: r["x"] for r in got} == {s: [sum(x) if x else None for x in h] for s, h in hits.items()}


def test_overlaps_are_not_all_pairs():
    """a sentence of very many words is no square; 200,000 of them would be 4 * 10^10 pairs."""
    import pyarrow as pa

    at = np.arange(200_000)
    lists = lambda x: pa.array([x.astype(np.int32)])
    assert len(joins._meet(*map(lists, (at * 3, at * 3 + 3, at * 6, at * 6 + 5)))[0]) == 200_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_overlaps_are_not_shuffled(spark, tmp_path):
    """a line stays one row, and lines without a word have no tokens."""
    df = queries.queries()["span_overlap_sum"](spark, SF)
    assert all("RoundRobin" in x for x in shuffled(df))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    texts = ["-- ..\n\n a\u00e9,  -- bcdefg \t", "...", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.queries()["span_overlap_sum"](spark, str(tmp_path)).collect())) == [("0-3", 1, 1), ("0-3", 3, 9)]
