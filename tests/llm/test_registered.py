"""Every registered query of the subpackage over whole tables, against brute force."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash

from gazetrail.llm import decontaminate, licenses, queries
from gazetrail.llm.media import decode_png, encode_png, feature, padded

from .conftest import held_out
from .test_search import groups_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: queries.queries()[name](spark, SF).collect()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ids_of(tokenizer, texts, end):
    from tokenizers import Tokenizer

    got = Tokenizer.from_file(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*e.ids, end], "<u4") for e in got]


def test_all_are_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 11))


def test_op1(result, rows, tokenizer):
    rows = sorted(rows, key=lambda r: r.doc_id)
    got = sorted(result("op1_token_files"), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    for r, own in zip(got, ids_of(tokenizer, [r.text for r in rows], 0)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_op2(result, rows):
    got = {r.doc_id: r for r in result("op2_toxicity")}
    assert set(got) == {r.doc_id for r in rows} and len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op3(result, rows):
    got = {r.doc_id: r for r in result("op3_licenses")}
    for r in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(r.text))
        at = [(k, v) for p, v in licenses.BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        base, found, best = {v for _, v in at}, set(), 1.0 if at else 0.0
        for label, text, must in licenses.TEMPLATES:  # every place of every template
            t = text.split()
            for a in range(1 - len(t), len(ws)):
                share = sum(0 <= a + i < len(ws) and ws[a + i] == w for i, w in enumerate(t)) / len(t)
                here = ws[max(0, a) : a + len(t)]
                if share >= 0.7 and all(any(here[i : i + len(m.split())] == m.split() for i in range(len(here))) for m in must):
                    found.add(label)
                    best = max(best, share)
        x = got.pop(r.doc_id)
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(ws), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert (x.base_labels, x.labels, x.score) == (",".join(sorted(base)), ",".join(sorted(base | found)), pytest.approx(best))
    assert not got


def test_op4(result, rows):
    got = {r.doc_id: r for r in result("op4_media")}
    for r in rows:
        raw = (r.text or "").encode()
        p, x = padded(raw), got.pop(r.doc_id)
        image = encode_png(p)
        assert decode_png(image) == p and p[: len(raw)] == raw and not any(p[len(raw) :]) and len(p) % 64 == 0 and len(p) >= 64
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (x.media_bytes, x.media_sha256, x.feature) == (len(image), hashlib.sha256(image).hexdigest(), feature(p))
        assert (x.digest, x.length, x.width * x.height, x.bits) == (x.payload_sha256, x.media_bytes, len(p), 8) and x.shard.endswith(".tar") and x.offset % 512 == 0
    assert not got


def test_op5(result, rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    prints = []
    for r in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(r.text)) if w]
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    v = np.array(prints, np.uint64)
    root = groups_of(len(v), zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 3)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in result("op5_simhash_groups")}
    assert got == {r.doc_id: (f"{p:016x}", rows[root[i]].doc_id) for i, (r, p) in enumerate(zip(rows, prints))}


def test_op6(result, rows, tokenizer):
    got, total = {}, 0
    for r in result("op6_packing"):
        got.setdefault(r.doc_id, []).append(r)
    room = {}
    for r, own in zip(rows, ids_of(tokenizer, [r.text for r in rows], 2)):
        parts = sorted(got.pop(r.doc_id), key=lambda x: x.piece)
        assert [x.piece for x in parts] == list(range(len(parts))) and sum(x.length for x in parts) == len(own)
        at = 0
        for x in parts:
            assert x.start == at and (x.length == 1024 or x.piece == 0) and x.ids_crc32 == zlib.crc32(own[at : at + x.length].tobytes())
            room.setdefault(x.sequence_id, []).append((x.offset, x.length))
            at += x.length
        total += at
    for parts in room.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert not got and len(room) <= -(-total // 1024) + 3


def test_op7(result, rows):
    texts = {r.doc_id: r.text for r in rows}
    got = result("op7_secrets")
    for r in got:
        value = texts[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256 and r.is_secret == (r.probability >= 0.5)
    for i, text in texts.items():
        for m in re.finditer(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])", text or ""):
            assert any(r.doc_id == i and r.start == m.start() and r.is_secret for r in got)


def test_op8(spark, result, rows):
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in result("op8_decontaminate")}
    some = {i for i, _ in got} | {r.doc_id for r in rows[::10]}
    for r in rows:
        if r.doc_id in some:
            text = decontaminate.normal(r.text or "")
            for item_id, item in items:
                edits = 0 if item in text else decontaminate.Pattern(item).best(text)[0]
                assert got.pop((r.doc_id, item_id), None) == (edits if edits <= int(len(item) * 0.05) else None)
    assert not got


def test_op9(result):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()["op9_sharding"]).fetchall()
    assert sorted(map(tuple, result("op9_sharding"))) == sorted(want)


def test_op10(result, rows):
    got = {r.doc_id: r for r in result("op10_language")}
    langs = {r.lang for r in rows if r.lang is not None and not held_out(r.doc_id)}
    right = []
    for r in rows:
        x = got.pop(r.doc_id)
        letter = any(c.isalpha() for c in r.text or "")
        assert x.held_out == held_out(r.doc_id) and 0 <= x.score <= 1 and (x.lang_pred in langs if letter else x.lang_pred == "und")
        if letter and r.lang is not None and x.held_out:
            right.append(x.lang_pred == r.lang)
    assert not got and np.mean(right) > 0.95
