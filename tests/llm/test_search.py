import random
import re

import numpy as np
import pytest
import xxhash

from gazetrail.llm import components, decontaminate, licenses, simhash
from gazetrail.llm.trie import link


def groups_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near(values, k):
    d = np.bitwise_count(values[:, None] ^ values[None, :]) <= k
    return groups_of(len(values), zip(*np.nonzero(d)))


@pytest.mark.parametrize("seed", range(12))
def test_trie_links_what_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 500))
    v = rng.choice(rng.integers(0, 2**64, size=max(1, n // int(rng.integers(1, 8))), dtype=np.uint64), n)
    for _ in range(rng.integers(0, 5)):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, size=n).astype(np.uint64))
    v = np.unique(v)
    lo, hi = np.array([0]), np.array([len(v)])
    for k in (0, 1, 3, 9):
        assert link(v, lo, hi, lo, hi, 63, k).label.tolist() == near(v, k)


def test_fingerprint_by_hand():
    text = "The cat  sat\ton É the MAT the cat sat"
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    for n in (3, 5, 20):
        sh = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert simhash.fingerprint(text.encode(), n) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_links_in_whole_and_cut_buckets(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, size=40, dtype=np.uint64) & np.uint64(0xFFFF0000FFFFFFFF)
    v = rng.choice(base, 300)
    for _ in range(3):
        v = v ^ np.where(rng.random(300) < 0.6, np.uint64(1) << rng.integers(0, 64, size=300).astype(np.uint64), np.uint64(0))
    v = np.unique(v)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(v.view(np.int64))}
    pairs = [(at[r.u], at[r.v]) for r in simhash.links(df, 3, most).collect()]
    assert groups_of(len(v), pairs) == near(v, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {k: 100 for k in range(100, 140)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_edges(docs):
    out = simhash.groups(docs(extra=True)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert len(out) == 9 and by[5] == by[1] and {c for _, c in by[1]} == {1}
    assert {x for k in (2, 3, 4) for x in by[k]} == {(0, 2)}
    assert simhash.groups(docs([])).count() == 0


def test_deduplicated(docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for g in range(12):
        ws = [word() for _ in range(300)]
        rows.append((g * 10, " ".join(ws), "en", "a"))
        for k in range(1, 4):
            new = list(ws)
            new[rng.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(new), "en", "b"))
    rows += [(1000 + i, " ".join(word() for _ in range(100)), "en", "c") for i in range(30)]
    kept = simhash.deduplicated(docs(rows, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == [g * 10 for g in range(12)] + [1000 + i for i in range(30)]
    edges = simhash.deduplicated(docs(extra=True)).collect()
    assert sorted((r.doc_id or -1) for r in edges) == [-1, 1, 2, 6, 7]
    assert simhash.deduplicated(docs([])).count() == 0


def test_deduplicated_goes_by_row(docs):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(200))
    near = lambda t: t + " " + "".join(rng.choices("klmn", k=6))
    a, b, c, d, e, f, g = (prose() for _ in range(7))
    alone = [(None, prose()) for _ in range(5)]
    rows = [
        *((1, a), (None, near(a)), (None, near(a))),  # null ids near one that is not
        *alone,
        *((2, b), (3, near(b)), (3, c)),  # an id of a near copy and of a text of its own
        *((None, d), (None, near(d)), (None, near(d))),  # null ids only
        *((4, e), (4, near(e))),  # one id, near copies
        *((5, f), (5, f), (5, g), (5, g.upper())),  # repeated rows, and the same words
        *((None, alone[0][1]), (6, alone[1][1])),
    ]
    for order in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in simhash.deduplicated(docs([(i, t, "en", "a") for i, t in order], extra=True)).collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
        assert {(1, a), (2, b), (3, c), (5, f), (6, alone[1][1]), alone[0], *alone[2:]} <= set(kept)
        rest = set(kept) - {(1, a), (2, b), (3, c), (5, f), (6, alone[1][1]), alone[0], *alone[2:]}
        assert sorted((i or 0, t[:50].lower()) for i, t in rest) == sorted([(0, d[:50]), (4, e[:50]), (5, g[:50])])


def similar(texts, n=5, at_least=0.8):
    """Groups by the similarity of all pairs."""
    bags = []
    for t in texts:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        bags.append({" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({" ".join(ws)} if ws else set()))
    alike = lambda a, b: len(a & b) >= at_least * len(a | b)
    return groups_of(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if alike(bags[i], bags[j])])


def test_products_find_what_sets_do():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, 60, dtype=np.uint32)
    sets = [np.unique(np.where(rng.random(60) < rng.random() / 3, rng.integers(0, 2**32, 60, dtype=np.uint32), base)) for _ in range(70)]
    sets += [np.zeros(0, np.uint32), np.zeros(0, np.uint32), base[:3], sets[0]]
    bags = simhash._Bags(pa.array([x.astype("<u4").tobytes() for x in sets]))
    jaccard = lambda a, b: 1.0 if not len(a) + len(b) else len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    every = np.arange(len(sets))
    for left, right in ((every, every), (every[::3], every[5:]), (every[:4], every[60:])):
        for columns in (2048, 7):
            simhash.COLUMNS = columns
            want = {(x, y) for x in left.tolist() for y in right.tolist() if x != y and jaccard(sets[x], sets[y]) >= 0.6}
            assert set(zip(*(v.tolist() for v in bags.pairs(left, right, 0.6)))) == want and want
            assert all(bags.similar(x, y, 0.6) == ((x, y) in want) for x in left.tolist() for y in right.tolist() if x != y)
    simhash.COLUMNS = 2048


@pytest.mark.parametrize("limits", [{}, {"most": 2}, {"most": 3, "room": 5000}, {"rough": 3}, {"rough": 1, "most": 4}])
def test_similar_groups_against_all_pairs(docs, limits):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    shared = " ".join(rng.choices(words, k=60))  # a passage that many unrelated texts have
    texts = [None, "", " \n", "one", "One", "two words", "two words"]
    for k in range(24):
        base = rng.choices(words, k=rng.randint(80, 300))
        texts.append(" ".join(base) + " " + shared)
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() + " \n" + shared)
        if k % 3 == 0:  # a repeated line weighs no more than one
            texts.append(" ".join(base) + " " + shared + (" " + shared) * 20)
    got = simhash.similar_groups(docs([(i, t, "en", "a") for i, t in enumerate(texts)], extra=True), **limits)
    assert [r.component_id for r in got.orderBy("doc_id").collect()] == similar(texts)


def test_similar_groups_edges(docs):
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.similar_groups(docs()).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 6), (7, 7)]
    assert simhash.similar_groups(docs([])).count() == 0


def distance(pattern, text):
    """Fewest edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != d), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(0)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (80, 120))
        edits, end = decontaminate.Pattern(p).best(t)
        assert edits == distance(p, t) and distance(p, t[:end]) == edits


def test_no_occurrence_within_the_budget_is_missed():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(50)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(20)]
    find = decontaminate.Finder(items, rate=0.08)
    texts = []
    for _ in range(60):
        c = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, int(0.1 * len(c)))):
            p = rng.randrange(len(c))
            c[p : p + rng.randint(0, 1)] = rng.choice(["z", "", "y"])
        texts.append(" ".join(rng.choices(words, k=10)) + "\n" + "".join(c).upper() + "  " + " ".join(rng.choices(words, k=5)))
    for t in texts:
        want = {i: distance(x, decontaminate.normal(t)) for i, x in items}
        got = {i: e for i, e, _, _ in find.find(t)}
        assert got == {i: d for i, d in want.items() if d <= int(len(dict(items)[i]) * 0.08)}


def test_places_in_the_text():
    rng = random.Random(4)
    for _ in range(300):
        raw = "".join(rng.choices("aB é\t\nİß", k=rng.randint(0, 30)))
        text = decontaminate.normal(raw)
        at = decontaminate.places(raw, list(range(len(text) + 1)))
        assert len(at) == len(text) + 1 and at == sorted(at)
        for i, p in enumerate(at[:-1]):
            assert raw[p].isspace() if text[i] == " " else text[i] in raw[p].lower()


def test_matches(spark, docs):
    item = "A passage of the benchmark that is  long enough to be cut into pieces and found again."
    rows = [(1, f"Before. {item.upper()} After."), (2, "nothing here"), (3, f"é\n{item}"), (4, None), (None, item), (5, "short"), (6, "a (Short) one"), (7, "shorter, unshort")]
    df = docs([(i, t, None, None) for i, t in rows], extra=True)
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short"), (None, item), (11, item)], "item_id long, text string")
    for block in (2_000_000, 10):
        got = {(r.doc_id, r.item_id): (r.edits, r.start, r.stop) for r in decontaminate.matches(df, items, block_chars=block).collect()}
        assert set(got) == {(1, 7), (1, 11), (3, 7), (3, 11), (None, 7), (None, 11), (5, 10), (6, 10)}
        assert got[6, 10] == (0, 3, 8)
        text = dict(rows)[1]
        assert text[got[1, 7][1] : got[1, 7][2]] == item.upper()
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [2, 4, 7]
    assert decontaminate.matches(df, items.limit(0)).count() == 0 and decontaminate.clean(df, items.limit(0)).count() == 8
    assert decontaminate.matches(docs([]), items).count() == 0


def test_licences_by_hand(docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0. MIT license; MIT-License"),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the x"),
        (5, "permission is hereby denied to any person obtaining a copy of this software and associated documentation files"),
        (6, "cc by cc by É cc-by gnu general public licence"),
        (7, None),
        (8, ""),
        (9, "All rights reserved"),
    ]
    df = docs([(i, t, "en", "a") for i, t in rows], extra=True)
    out = {r.doc_id: r for r in licenses.scan(df, licenses.idf(df)).collect()}
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, v) for p, v in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({v for _, v in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert [out[i].labels for i in (1, 2, 3, 4, 5, 7, 8, 9)] == ["apache,mit", "gpl", "cc-by,cc-by-nc", "mit", "", "", "", "proprietary"]
    assert licenses.scan(docs([]), licenses.idf(docs([]))).count() == 0


def test_shared_edges(spark, docs):
    """Null, empty, blank, repeated and very long texts, a null id, and clashing names."""
    for extra in (False, True):
        df = docs(extra=extra)
        got = licenses.scan(df, licenses.idf(df))
        assert got.count() == 9 and got.filter("n_base > 0").count() == 0 and got.filter("doc_id = 6").first().n_words == 40_001
        long = "x" * 40 + " Straße été " + "Straße été " * 5
        items = spark.createDataFrame([(1, long), (2, "lazy dog again"), (3, None)], "item_id long, text string")
        found = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.matches(df, items).collect())
        assert found == [(1, 2, 0), (1, 2, 0), (5, 2, 0), (6, 1, 0)]
        assert sorted((r.doc_id or -1) for r in decontaminate.clean(df, items).collect()) == [-1, 2, 3, 4, 7]


def test_licence_places_keep_their_distance():
    index = licenses.Index(templates=[("x", "alpha beta gamma delta", ["beta gamma"])], base={})
    ids = lambda t: np.array([index.at.get(w, -1) for w in t.split()])
    assert index.notices(ids("zz alpha beta gamma delta")) == [(1, "x", 1.0)]
    assert index.notices(ids("alpha beta gamma zz")) == [(0, "x", 0.75)]
    assert index.notices(ids("gamma beta alpha delta")) == [] and index.notices(ids("zz")) == []


def test_no_licence_notice_is_lost_among_others(docs):
    filler = " ".join(w for _, t, _ in licenses.TEMPLATES for w in sorted(t.split()))
    bsd = "Copyright (c) 2020. All rights reserved. " + licenses.TEMPLATES[8][1]
    # the three rarest words of the template are altered, over 0.7 of it stands
    altered = "redistribution and use in source and binary forms with or without modification are permitted provided that the xx xx are xx"
    every = f" {filler} ".join(t for _, t, _ in licenses.TEMPLATES)
    df = docs([(1, every, "en", "a"), (2, bsd, "en", "a"), (3, altered, "en", "a"), (4, filler + " all rights reserved", "en", "a")])
    weights = licenses.idf(df) | {"following": 9.0, "conditions": 9.0, "met": 9.0}
    out = {r.doc_id: r for r in licenses.scan(df, weights).collect()}
    ws = every.split()
    found = {(p.word, p.label) for p in out[1].places if p.share == 1}
    for label, text, _ in licenses.TEMPLATES:
        n = len(text.split())
        assert {(i, label) for i in range(len(ws)) if ws[i : i + n] == text.split()} <= found
    assert (out[2].labels, out[3].labels, out[3].score) == ("bsd,proprietary", "bsd", 18 / 21) and "proprietary" in out[4].labels
