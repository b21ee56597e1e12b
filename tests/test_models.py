import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetrail.operators import joins, ngram, regression, scoring
from gazetrail.plans import analysis

SENTENCES = ["the cat sat", "the dog", "the cat ran home"]


def expected(train, test, order, alpha):
    vocab = {w for s in train for w in s} | {"<s>", "</s>", "<unk>"}
    counts, past = Counter(), Counter()
    for s in train:
        p = ["<s>"] * (order - 1) + s + ["</s>"]
        for n in range(1, order + 1):
            for i in range(len(p) - n + 1):
                counts[tuple(p[i : i + n])] += 1
                past[n, tuple(p[i : i + n - 1])] += 1
    out, before = [], []
    for w in test:
        w = w if w in vocab else "<unk>"
        value = 1 / len(vocab)
        for n in range(min(order, len(before) + 1), 0, -1):
            h = tuple(before[len(before) - n + 1 :])
            below = past[n, h] + alpha * len(vocab)
            if below > 0:
                value = (counts[(*h, w)] + alpha) / below
                break
        out.append(-math.log2(max(value, 1e-12)))
        before.append(w)
    return out


@pytest.mark.parametrize("order,alpha", [(1, 0.1), (2, 0.1), (3, 0.1), (5, 0.1), (1, 0.0), (3, 0.0)])
def test_ngram_scores(spark, order, alpha):
    train = [s.split() for s in SENTENCES]
    test = ["the", "cat", "ran", "away", "the", "dog"]
    model = ngram.fit(spark.createDataFrame([(str(i), s) for i, s in enumerate(train)], "sentence_id string, words array<string>"), order, alpha)
    rows = spark.createDataFrame([("s", i, w) for i, w in enumerate(test)], "sentence_id string, position_in_sentence int, word_clean string")
    got = [r.s for r in ngram.score(model, rows, name="s").orderBy("position_in_sentence").collect()]
    assert got == pytest.approx(expected(train, test, order, alpha), abs=1e-9)


def test_min_count_makes_unknowns(spark):
    df = spark.createDataFrame([(str(i), s.split()) for i, s in enumerate(SENTENCES)], "sentence_id string, words array<string>")
    model = ngram.fit(df, 2, 0.1, min_count=2)
    assert model.size == 5  # the, cat and three marks
    assert model.counts.filter("ngram = '<unk>'").first().c == 4


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([(s.split(),) for s in SENTENCES], "words array<string>")
    kn = ngram.kneser_ney(df, 2)
    assert kn.filter("history = 'the' and word = 'cat'").first().p > kn.filter("history = 'the' and word = 'dog'").first().p
    assert all(r.s < 1 + 1e-9 for r in kn.groupBy("history").agg(F.sum("p").alias("s")).collect())


def test_merge_nulls_duplicates_and_errors(spark):
    k = "participant_id string, sentence_id string, word_id string"
    base = spark.createDataFrame([("p", "s", "1"), ("p", None, "1")], k)
    feature = spark.createDataFrame([("p", "s", "1", 0.5), ("p", None, "1", 0.7), ("p", None, "1", 0.8)], f"{k}, f double")
    assert sorted(r.f for r in joins.merge_features(base, feature).collect()) == [0.5, 0.7, 0.8]
    with pytest.raises(ValueError, match="repeats"):
        joins.merge_features(base, feature, unique=True)
    with pytest.raises(ValueError, match="no column"):
        joins.merge_features(base, base)
    with pytest.raises(KeyError):
        joins.merge_features(base, feature.drop("word_id"))
    with pytest.raises(ValueError, match="both"):
        joins.merge_features(feature, feature)
    with pytest.raises(TypeError):
        joins.merge_features(base, feature.withColumn("word_id", F.col("word_id").cast("int")))


def test_token_sums(spark):
    words = spark.createDataFrame([("s", 0, 0, 3), ("s", 1, 4, 7), ("s", 2, 8, 9)], "sentence_id string, word_index int, start int, end int")
    tokens = spark.createDataFrame([("s", 0, None, 0, 0, -9.0), ("s", 1, None, 0, 2, -1.0), ("s", 2, None, 2, 5, -2.0), ("s", 3, None, 5, 7, None), ("s", 4, 0, None, None, -4.0)], scoring.TOKENS)
    got = {r.word_index: r.score for r in scoring.word_sums(tokens, words, "nats").collect()}
    assert got == {0: 7.0, 1: 2.0, 2: None}
    bits = {r.word_index: r.score for r in scoring.word_sums(tokens, words).collect()}
    assert bits[0] == pytest.approx(7 / math.log(2))


class Fake:
    """Ids of letters, a space with the letter behind it; what follows is likelier the nearer it is in the alphabet."""

    def __init__(self, begin=0, mask=90):
        self.begin, self.mask, self.calls = begin, mask, []

    def encode(self, text):
        return [ord(c) - 96 + 30 * (i > 0 and text[i - 1] == " ") for i, c in enumerate(text) if c != " "]

    def encode_with_spans(self, text, max_length):
        at = [i for i, c in enumerate(text) if c != " "][: max_length - 2]
        return [98, *(ord(text[i]) - 96 for i in at), 99], [(0, 0), *((i, i + 1) for i in at), (0, 0)]

    def scores(self, ids, places):
        self.calls.append((list(ids), list(places)))
        return np.array([[-abs(v - ids[k]) / 10 for v in range(100)] for k in places])


def log_p(v, last):
    s = np.array([-abs(x - last) / 10 for x in range(100)])
    return s[v] - math.log(np.exp(s).sum())


def test_causal_scores_by_hand():
    model = Fake()
    got = scoring.Causal(model).tokens(["ab", "c", "", "d"])
    # a word is encoded with the space before it, apart from its prefix; an empty one has no ids here
    assert [t[0] for t in got] == [0, 0, 1, 3]
    assert [t[3] for t in got] == pytest.approx([log_p(1, 0), log_p(2, 1), log_p(33, 2), log_p(34, 33)])
    assert model.calls[1] == ([0, 1, 2, 33], [2]) and model.calls[2] == ([0, 1, 2, 33, 34], [3])
    # without an id to begin with, the first word has no context
    assert [t[0] for t in scoring.Causal(Fake(begin=None)).tokens(["ab", "c"])] == [1]


def test_masked_scores_by_hand():
    model = Fake()
    got = scoring.Masked(model, 4).tokens(["ab", "c"])
    assert [t[:3] for t in got] == [(None, 0, 0), (None, 0, 1), (None, 1, 2), (None, 0, 0)] and got[0][3] is got[3][3] is None
    assert [t[3] for t in got[1:3]] == pytest.approx([log_p(1, 90), log_p(2, 90)])
    assert model.calls == [([98, 90, 2, 99], [1]), ([98, 1, 90, 99], [2])]
    with pytest.raises(ValueError, match="mask"):
        scoring.Masked(Fake(mask=None))


@pytest.mark.parametrize("kind", [lambda: scoring.Causal(scoring.StandIn()), lambda: scoring.Masked(scoring.StandIn(True))])
def test_model_surprisal(spark, kind):
    rows = [("p1", "a", "1", "hello!", "hello", 1), ("p1", "a", "2", "world", "world", 2), ("p2", "a", "1", "hello", "hello", 1), ("p2", "b", "1", "x", "x", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "participant_id string, sentence_id string, word_id string, word string, word_clean string, position_in_sentence int, _row_ord long")
    out = scoring.model_surprisal(df, kind, "test/m-1", max_sentences=1)
    got = {(r.participant_id, r.sentence_id, r.word_id): r.test_m_1_surprisal for r in out.collect()}
    assert len(got) == 4 and got["p1", "a", "1"] == got["p2", "a", "1"] and got["p2", "b", "1"] is None
    tokens = kind().tokens(["hello", "world"])
    mine = [p for i, a, b, p in tokens if p is not None and (i == 0 if i is not None else a < 5)]
    assert len(mine) == 2 and got["p1", "a", "1"] == pytest.approx(-sum(mine) / math.log(2))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 100, 5]
    y = x @ [0.5, -0.1, 2.0] + rng.normal(size=n)
    g = rng.integers(0, 40, n)
    df = spark.createDataFrame([(f"g{k}", *map(float, r), float(t)) for k, r, t in zip(g, x, y)], "sentence_id string, a double, b double, c double, y double")
    return df, x, y, np.array([f"g{k}" for k in g])


def test_ols_against_numpy(data):
    df, x, y, _ = data
    f = regression.fit_ols(df, "y", ["a", "b", "c"])
    X = np.column_stack([np.ones(len(y)), x])
    w, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    assert list(f["params"].values()) == pytest.approx(w, rel=1e-8)
    assert f["r2"] == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    llf = -len(y) / 2 * (math.log(2 * math.pi) + math.log(rss[0] / len(y)) + 1)
    assert f["aic"] == pytest.approx(-2 * llf + 8) and f["bic"] == pytest.approx(-2 * llf + 4 * math.log(len(y)))


def test_collinear_constant_and_few_rows(data):
    df = data[0].withColumn("d", F.col("a") * 2).withColumn("k", F.lit(1.0))
    assert regression.fit_ols(df, "y", ["a", "d", "k"])["r2"] == pytest.approx(regression.fit_ols(df, "y", ["a"])["r2"])
    with pytest.raises(ValueError):
        regression.fit_ols(df.limit(99), "y", ["a"])
    assert regression.fit_ols(df.limit(100), "y", ["a"])["n"] == 100


def test_t_pvalues():
    assert regression.t_pvalue(0, 10) == pytest.approx(1)
    assert regression.t_pvalue(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert regression.t_pvalue(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert regression.t_pvalue(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)


def greedy(sizes, k=5):
    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (x[1], x[0]), reverse=True):
        f = loads.index(min(loads))
        out[g] = f
        loads[f] += n
    return out


def test_turns_are_the_greedy_rule():
    rng = np.random.default_rng(7)
    for _ in range(1000):
        top = int(rng.choice([3, 10, 60, 1000]))
        many = Counter(rng.integers(1, top, rng.integers(1, 60)).tolist())
        if rng.random() < 0.2:
            many[int(rng.integers(500, 3000))] += 1  # a giant
        k, slow, fast = int(rng.integers(2, 7)), None, None
        slow = fast = [0] * k
        for n in sorted(many, reverse=True):
            want = []
            slow = list(slow)
            for _ in range(many[n]):
                f = slow.index(min(slow))
                want.append(f)
                slow[f] += n
            stretches, fast = regression.turns(fast, n, many[n])
            got = [c[(r - a) % len(c)] for (a, c), b in zip(stretches, [*(a for a, _ in stretches[1:]), many[n]]) for r in range(a, b)]
            assert got == want and fast == slow
    stretches, loads = regression.turns([10**12, 0, 0, 0, 0], 1, 10**13)  # no list as long as the groups
    assert len(stretches) == 2 and sum(loads) == 11 * 10**12


@pytest.mark.parametrize("seed", range(4))
def test_group_folds(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"k{i:03d}": int(n) for i, n in enumerate(rng.choice([1, 2, 3, 7, 50, 400], 180, p=[0.3, 0.3, 0.2, 0.1, 0.08, 0.02]))}
    got = regression.group_folds(spark.createDataFrame(list(sizes.items()), "g string, n long"))
    assert {r.g: r.fold for r in got.collect()} == greedy(sizes)


def test_cross_validation_against_numpy(data):
    df, x, y, g = data
    fold = greedy(dict(Counter(g.tolist())))
    folds, pred = np.array([fold[k] for k in g]), np.zeros(len(y))
    for f in range(5):
        tr = folds != f
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x - m) / s
        w = np.linalg.solve(z[tr].T @ z[tr] + np.eye(3), z[tr].T @ (y[tr] - y[tr].mean()))
        pred[~tr] = z[~tr] @ w + y[tr].mean()
    cv = regression.cross_validate(df, "y", ["a", "b", "c"])
    assert cv.pooled["cv_rmse"] == pytest.approx(np.sqrt(((y - pred) ** 2).mean()), rel=1e-9)
    assert cv.pooled["cv_mae"] == pytest.approx(np.abs(y - pred).mean(), rel=1e-9)
    by = {r.fold: r for r in cv.folds.collect()}
    for f in range(5):
        e = (y - pred)[folds == f]
        assert by[f].r2 == pytest.approx(1 - (e**2).sum() / ((y[folds == f] - y[folds == f].mean()) ** 2).sum(), rel=1e-8)


def test_a_giant_group_and_a_table_of_few_sizes(spark):
    for sizes in ({"g": 2000, **{f"k{i:03d}": 1 for i in range(300)}}, {f"a{i:02d}": n for i, n in enumerate([9] * 4 + [8] * 2 + [7] * 6)}):
        got = regression.group_folds(spark.createDataFrame(list(sizes.items()), "g string, n long"))
        assert {r.g: r.fold for r in got.collect()} == greedy(sizes)
    assert regression.group_folds(spark.createDataFrame([], "g string, n long")).count() == 0


def test_lists_on_rows_of_their_own(data):
    """Each list on its own complete rows, in one pass, as if each were alone."""
    gap = F.when(F.hash("a", "b") % 5 != 0, F.col("c"))
    df = data[0].withColumn("c", gap).withColumn("b", F.when(F.hash("y") % 7 == 0, float("nan")).otherwise(F.col("b")))
    df = df.withColumn("sentence_id", F.when(F.hash("a") % 11 != 0, F.col("sentence_id")))
    specs = {"one": ["a"], "two": ["a", "b"], "three": ["a", "b", "c"], "same": ["b", "a"]}
    fits = regression.Fits(df, "y", specs, "sentence_id")
    errors = fits.cross_validated()
    for name, columns in specs.items():
        alone = regression.fit_ols(df, "y", columns)
        assert fits.ols(name)["n"] == alone["n"] and list(fits.ols(name)["params"].values()) == pytest.approx(list(alone["params"].values()), rel=1e-9)
        cv = regression.cross_validate(df, "y", columns)
        assert errors[name] == pytest.approx(cv.pooled, rel=1e-9)
    full = regression.Fits(data[0], "y", specs, "sentence_id")
    assert len(full.bases) == 1 and full.cross_validated()["three"] == pytest.approx(regression.cross_validate(data[0], "y", ["a", "b", "c"]).pooled, rel=1e-9)


def test_few_groups_give_nan(data):
    cv = regression.cross_validate(data[0].filter("sentence_id in ('g1', 'g2', 'g3', 'g4')"), "y", ["a"])
    assert math.isnan(cv.pooled["cv_rmse"])


def test_analysis_and_reports(spark, data, tmp_path):
    df = data[0].withColumnsRenamed({"a": "word_length", "b": "ngram5_surprisal", "c": "gpt2_surprisal", "y": "log_gaze_duration"})
    tables, skipped = analysis.analyse(df, folder=str(tmp_path))
    assert skipped == ["log_total_reading_time"]
    rows = {r.model: r for r in tables["log_gaze_duration"].collect()}
    assert len(rows) == 6 and rows["lexical"].delta_r2_vs_lexical == 0 and rows["full_ngram_ar_mlm"].n_predictors == 3
    assert rows["lexical_plus_mlm"].r2 == rows["lexical"].r2
    from gazetrail.sources import tables as files

    fits = json.loads((tmp_path / "log_gaze_duration_ols_details.json").read_text())
    assert set(fits) == set(rows) and fits["lexical"]["r2"] == rows["lexical"].r2 and set(fits["lexical"]["params"]) == {"Intercept", "word_length"}
    assert (tmp_path / "log_gaze_duration_model_comparison.csv").is_file()
    assert files.result_files(spark, str(tmp_path)).count() == 6
    assert analysis.best_models(tables["log_gaze_duration"]).first().model == "full_ngram_ar_mlm"
    assert set(analysis.pivot(tables["log_gaze_duration"]).columns) == {"target", *rows}
    with pytest.raises(ValueError):
        analysis.pivot(tables["log_gaze_duration"].unionAll(tables["log_gaze_duration"]))
    stats = analysis.run_stats(df.withColumnRenamed("log_gaze_duration", "log_gd"), controls=["word_length"], group="sentence_id").first()
    assert stats.target == "log_gd" and stats.r2_mean < stats.r2
    with pytest.raises(KeyError, match="zipf_freq"):
        analysis.run_stats(df, controls=["word_length", "zipf_freq"], group="sentence_id")
    few = df.withColumnRenamed("log_gaze_duration", "log_gd").withColumn("sentence_id", F.lit("s"))
    assert analysis.run_stats(few, controls=["word_length"], group="sentence_id").first().r2_mean is None
