import os
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetrail.llm import language, textblocks, toxicity
from gazetrail.llm.textblocks import blocks, hashes, lower, words

from .conftest import held_out


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    vocab = {x: ["".join(rng.choice(list(chars), 2)) + "".join(rng.choice(list(chars), 3)) for _ in range(60)] for x, chars in (("en", "thewrdbla"), ("de", "schußäöngk"), ("fr", "éèquoivaj"))}
    out = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        ws = list(rng.choice(vocab[lang], rng.integers(5, 60)))
        toxic = i % 7 == 0
        if toxic:
            ws[int(rng.integers(len(ws)))] = ["moronic", "scummy", "trashy"][i % 3]
        out.append((i, " ".join(ws), lang, "s", toxic))
    return out


def test_blocks_and_words():
    import pyarrow as pa

    col = pa.array(["ÀB c", None, "", "1é-x"])
    got = list(blocks(col, 1))
    assert [(a, b) for a, b, *_ in got] == [(0, 1), (1, 3), (3, 4)] or sum(b - a for a, b, *_ in got) == 4
    (_, _, data, off), = list(blocks(col))
    low = lower(data)
    s, e, r = words(low, off)
    assert [(low[x:y].tobytes().decode(), int(k)) for x, y, k in zip(s, e, r)] == [("àb", 0), ("c", 0), ("1é", 3), ("x", 3)]
    h = hashes(low, s, e)
    other = np.frombuffer("zz àb".encode(), np.uint8)
    assert hashes(other, np.array([3]), np.array([6]))[0] == h[0] and len(set(h.tolist())) == 4
    sliced = col.slice(3, 1)
    assert next(blocks(sliced))[2].tobytes().decode() == "1é-x"


def test_toxicity_held_out(spark, docs):
    rows = corpus(900)
    df = docs([r[:4] for r in rows])
    labels = spark.createDataFrame([(r[0], int(r[4])) for r in rows if r[0] % 2 == 0], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scores(df, toxicity.fit(df, labels)).collect()}
    truth = {r[0]: int(r[4]) for r in rows if held_out(r[0])}
    assert np.mean([out[i].predicted == t for i, t in truth.items()]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (99, 1), (3, 0)], "doc_id long, toxic int")
    for df in (docs(), docs(extra=True), docs([])):
        for known in (labels, labels.limit(0)):
            out = toxicity.scores(df, toxicity.fit(df, known))
            assert out.count() == df.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
            assert dict(out.dtypes)["score"] == "double"


def test_nnpu_pushes_unlabelled_down():
    rng = np.random.default_rng(0)
    n, x = 600, (rng.random((600, 5)) < 0.2).astype(int)
    y = x[:, 0] | x[:, 1]
    p, u = ((y == 1) & (np.arange(n) < 200)).astype(float), (np.arange(n) >= 200).astype(float)
    rows, cols = np.nonzero(x)
    w, b = toxicity.fit_nnpu(rows, cols, p, u, 5, float(y.mean()))
    assert np.mean(((x @ w + b) > 0) == y) > 0.95


def test_risk_and_its_gradient_by_hand():
    rng = np.random.default_rng(1)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    rows, cols = np.nonzero(x)
    p, u = rng.random(40), rng.random(40)
    p, u = p / p.sum(), u / u.sum()
    kinds = set()
    for k in range(40):
        w, prior = rng.normal(size=7) * 2, [0.1, 0.9][k % 2]
        s = 1 / (1 + np.exp(-(x @ w[:6] + w[6])))
        above, rest, grad = toxicity.risk(w, rows, cols, p, u, prior, 0.01)
        assert above == pytest.approx(prior * sum(p * (1 - s))) and rest == pytest.approx(sum(u * s) - prior * sum(p * s))
        kinds.add(rest >= 0)

        def aim(w, rest=rest, prior=prior):
            a, r, _ = toxicity.risk(w, rows, cols, p, u, prior)
            return (a + r if rest >= 0 else -r) + 0.005 * sum(w[:6] ** 2)

        for i in range(7):
            d = np.eye(7)[i] * 1e-6
            assert grad[i] == pytest.approx((aim(w + d) - aim(w - d)) / 2e-6, abs=1e-6)
    assert kinds == {True, False}


def plain_features(text):
    out = set()
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", low.encode()):
        out |= {w} | {w[:k] for k in toxicity.PREFIXES if len(w) > k}
    return out


def plain_hash(w):
    data = np.frombuffer(w, np.uint8)
    return hashes(data, np.array([0]), np.array([len(data)]))[0]


@pytest.mark.parametrize("long", [1 << 20, 50])
def test_scores_by_hand(docs, monkeypatch, long):
    """Counts, chosen features and scores against sets of words, with texts whole and in parts."""
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "LONG", long)
    monkeypatch.setattr(textblocks, "LONG", long)
    textblocks._TABLES.clear()
    monkeypatch.setattr(textblocks.cut_words, "__defaults__", (long,))
    texts = [r[1] for r in corpus(60)] + [None, "", "À" * 70 + " Été x " * 40, "Moronic trashy moronic"]
    want = [plain_features(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 3 == 0 for k in range(64)]), pa.array([k % 2 == 0 for k in range(64)])], ["text", "p", "u"])
    got = {}
    for b in toxicity._count(iter([batch])):
        for h, p, u in zip(*(c.to_pylist() for c in b.columns)):
            got[h & (2**64 - 1)] = np.add(got.get(h & (2**64 - 1), 0), (p, u))
    every = set().union(*want)
    assert {int(plain_hash(w)): (sum(w in f for f in want[::3]), sum(w in f for f in want[::2])) for w in every} == {k: tuple(v) for k, v in got.items()}
    some = sorted(every, key=plain_hash)[::5]
    weights = np.random.default_rng(0).normal(size=len(some))
    row, at = toxicity.known_features(pa.array(texts), toxicity.Lookup(np.array([plain_hash(w) for w in some])))
    assert [sorted(at[row == k].tolist()) for k in range(64)] == [[i for i, w in enumerate(some) if w in f] for f in want]
    assert toxicity.known_features(pa.array([], pa.string()), toxicity.Lookup(np.array([plain_hash(b"a")])))[0].size == 0
    f = 0.3 + np.bincount(row, weights[at], 64)
    assert f == pytest.approx([0.3 + sum(x for x, w in zip(weights, some) if w in own) for own in want])


def plain_language(rows, texts):
    """Dense matrices of languages and trigrams, one text at a time."""
    langs = sorted({x for _, x in rows})
    codes = language.codewords(len(langs)).astype(float)

    def grams(text):
        c = language._CODE[lower(np.frombuffer((text or "").encode(), np.uint8))].tolist()
        return [(a << 12) | (b << 6) | d for a, b, d in zip(c, c[1:], c[2:]) if b]

    n = np.full((len(langs), 1 << language.BITS), 0.5)
    for text, x in rows:
        np.add.at(n[langs.index(x)], grams(text), 1)
    p = n / n.sum(axis=1, keepdims=True)
    w = np.stack([np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in codes.T], axis=1)
    trust = np.abs(p @ w).min(axis=0)
    trust /= trust.sum()
    common = np.log([sum(x == y for _, x in rows) / len(rows) for y in langs])
    out = []
    for t in texts:
        g = grams(t)
        m = np.clip(language.TEMPERATURE * w[g].sum(axis=0) / (len(g) + language.SHRINK), -30, 30)
        loss = np.log1p(np.exp(-m * codes)) @ (trust * len(trust)) - 1e-3 * common
        odds = np.exp(loss.min() - loss)
        out.append((langs[int(odds.argmax())], odds.max() / odds.sum()))
    return w, trust, out


@pytest.mark.parametrize("long", [1 << 20, 40])
def test_language_against_dense_matrices(docs, monkeypatch, long):
    monkeypatch.setattr(language, "LONG", long)
    rows = corpus(120, 3) + [(1000 + i, t, f"x{i % 5}", "s", False) for i, t in enumerate(["ÀÉ abc " * 9, "zz", "ß", "qq qq qq", "kk jj", "abc", "zzz z"] * 3)]
    w, trust, want = plain_language([(r[1], r[2]) for r in rows], [r[1] for r in rows])
    df = docs([r[:4] for r in rows])
    model = language.fit(df)
    assert np.allclose(model.weights, w, atol=1e-5) and model.trust == pytest.approx(trust, rel=1e-4)
    if long > 40:
        got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
        for r, (x, score) in zip(rows, want):
            assert got[r[0]][1] == pytest.approx(score, rel=1e-3) and (got[r[0]][0] == x or score < 0.51)


def test_every_language_is_learned(docs, monkeypatch):
    """More languages than a task holds at once, and than any cap there was."""
    monkeypatch.setattr(language, "HELD", 3)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        ws = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(12)]
        rows += [(k * 4 + j, " ".join(rng.choice(ws, 60)), f"l{k:03d}", "s") for j in range(4)]
    df = docs(rows)
    model = language.fit(df.filter("doc_id % 4 < 3"))
    assert len(model.langs) == 150
    out = language.predict(df.filter("doc_id % 4 = 3"), model).collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id // 4:03d}" for r in out]) > 0.95
    many = language.codewords(600)
    assert len(np.unique(many, axis=0)) == 600


LARGE = """
import resource, sys
import numpy as np, pyarrow as pa
from gazetrail.llm import language, licenses, toxicity
from gazetrail.llm.tokens import UnitEncoder
text = ("MIT license und Straße wörter " + " ".join(f"w{i % 5000}" for i in range(1000)) + " ") * 6000 + "x" * 3_000_000
kind, col = sys.argv[1], pa.array([text])
assert len(text) > 30_000_000
if kind == "toxicity":
    n = sum(len(h) for *_, h, _ in toxicity.text_features(col))
elif kind == "licenses":
    from gazetrail.llm.textblocks import blocks
    n = sum(licenses.Index().known(d, o)[0].sum() for *_, d, o in blocks(col))
else:
    n = sum(len(c) for _, c, _ in language.text_trigrams(col))
assert n > 5_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("kind", ["toxicity", "licenses", "language"])
def test_a_text_of_30_mb_needs_little_memory(kind):
    out = subprocess.run([sys.executable, "-c", LARGE, kind], capture_output=True, text=True, env={**os.environ})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1000


def test_language_held_out(docs):
    rows = corpus(600, 1)
    df = docs([r[:4] for r in rows])
    model = language.fit(df.filter(~toxicity.held_out(F.col("doc_id"))))
    out = {r.doc_id: r for r in language.predict(df.drop("lang"), model).collect()}
    assert np.mean([out[r[0]].lang_pred == r[2] for r in rows if held_out(r[0])]) > 0.98


def test_language_edges(docs):
    df = docs(extra=True)
    model = language.fit(df.drop("score"))
    out = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert [out[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and out[2].score == 0 and out[6].lang_pred == "de"
    assert language.fit(docs([])) is None
    assert {r.lang_pred for r in language.predict(docs(), None).collect()} == {"und"}
    one = language.fit(docs([(1, "abc def", "en", "a")]))
    assert [r.lang_pred for r in language.predict(docs([(2, "anything", None, None), (3, "a", None, None)]), one).collect()] == ["en", "en"]


@pytest.mark.parametrize("n", [2, 4, 7, 12, 30])
def test_codewords(n):
    m = language.codewords(n)
    assert len({tuple(r) for r in m}) == n and set(np.unique(m)) == {-1, 1} and (np.abs(m.sum(axis=0)) < n).all()
    if n == 4:
        assert m.shape == (4, 7) and ((7 - m @ m.T) / 2)[0, 1] == 4


def test_a_wrong_bit_is_corrected():
    codes = language.codewords(4)
    model = language.Model(list("abcd"), codes, np.zeros((1, 7)), np.full(7, 1 / 7), np.log(np.full(4, 0.25)))
    for k in range(4):
        margins = codes[k] * 3.0
        margins[2] *= -1
        best, score, unsure = language.decode(model, margins[None])
        assert best[0] == k and 0.25 < score[0] <= 1
