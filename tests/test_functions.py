import math

import pytest
from pyspark.sql import functions as F

from gazetrail.functions import numeric, text


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_words(spark):
    words = ["Hello,", "don't", "—dash—", "...", "'tis'", "naïve!", "_x_", "½!", "", None, "a\tb\n", "  x "]
    assert column(spark, words, text.clean_word) == ["Hello", "don't", "dash", "", "tis", "naïve", "_x_", "½", "", "", "a\tb", "x"]
    assert column(spark, words, text.punctuation_only) == [False, False, False, True, False, False, False, False, False, False, False, False]
    assert column(spark, words, text.has_alnum) == [True, True, True, False, True, True, True, False, False, False, True, True]
    assert column(spark, ["Café-au", "IT'S", None], text.ascii_clean) == ["cafau", "it's", None]


def test_numbers(spark):
    cells = [" 12 ", "1e3", "1d", "0x10", "1,000", ".", "nan", "inf", "+5", ".5", "5.", "", None]
    assert column(spark, cells, numeric.to_num) == [12, 1000, None, None, None, None, None, None, 5, 0.5, 5, None, None]
    assert column(spark, ["0", "-1", "x", "1", None], numeric.safe_log) == [None, None, None, 0.0, None]
    assert column(spark, ["3", "4.0", ".", None], numeric.to_int) == [3, 4, None, None]
    with pytest.raises(Exception, match="not integral"):
        column(spark, ["1.5"], numeric.to_int)


def test_cells_and_keys(spark):
    assert column(spark, [".", " .", "a", None], text.clean_cell) == [None, " .", "a", None]
    rows = spark.createDataFrame([("1", "2"), (None, "2")], "a string, b string")
    assert [r.k for r in rows.select(text.composite_key(F.col("a"), F.col("b")).alias("k")).collect()] == ["1-2", None]


def test_tokens_and_spans(spark):
    assert column(spark, [" a  b c\x1fd ", "", None], text.tokens) == [["a", "b", "c", "d"], [], None]
    spans = column(spark, [["the", "é", "cat"], []], text.word_spans, "array<string>")
    assert [[tuple(x) for x in s] for s in spans] == [[(0, 3), (4, 5), (6, 9)], []]
    assert column(spark, [["a"]], lambda c: text.padded(c, 3), "array<string>") == [["<s>", "<s>", "a", "</s>"]]


def test_surprisal_and_softmax(spark):
    assert column(spark, [0.5, 0.0], numeric.surprisal_bits, "double") == pytest.approx([1.0, -math.log2(1e-12)])
    assert column(spark, [math.log(2)], numeric.nats_to_bits, "double") == pytest.approx([1.0])
    got = column(spark, [[1.0, 2.0, 3.0]], numeric.log_softmax, "array<double>")[0]
    assert sum(math.exp(x) for x in got) == pytest.approx(1) and got[2] - got[1] == pytest.approx(1)
