import random
import zlib

import numpy as np
import pytest

from gazetrail.llm import packing, storage, token_files
from gazetrail.llm.tokens import UnitEncoder


def whole(tokenizer, texts):
    from tokenizers import Tokenizer

    return [list(e.ids) for e in Tokenizer.from_file(tokenizer).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [800_000, 300, 40])
def test_units_are_the_whole_text(tokenizer, limit):
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "\t", "\r", "\x0b", "'", "_", "²", "٣", "<|", "longerthanfifteenbytes", "a", "B", "é", "'s", "'ll", "1", "23", ".", "!!", "ß", "中", "　", "\xa0", " ", "😀", "<|endoftext|>", "\0", "́", "\x1c", "\x85", "don't", " the"]
    texts = ["", " ", "  ", "a  b", *("".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(3000))]
    code = UnitEncoder(tokenizer, limit)
    got = [x.tolist() for a in range(0, len(texts), 100) for x in code.encode(texts[a : a + 100])]
    assert got == whole(tokenizer, texts)


def test_blocks_of_units(tokenizer):
    code = UnitEncoder(tokenizer)
    ids, at = code.encode_block(np.frombuffer("a b".encode(), np.uint8), np.array([0, 0, 1, 3, 3]), 7)
    parts = whole(tokenizer, ["", "a", " b", ""])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[*x, 7] for x in parts]
    none, at = code.encode_block(np.zeros(0, np.uint8), np.array([0, 0]))
    assert len(none) == 0 and at.tolist() == [0, 0]
    # one unit each where the file is of another kind
    code.cuts = False
    assert [x.tolist() for x in code.encode(["It's a\nb", "", "x y"])] == whole(tokenizer, ["It's a\nb", "", "x y"])


def test_cut_of_many_documents():
    n = np.array([1, 9, 10, 11, 25, 30])
    got = list(zip(*(x.tolist() for x in packing._cut(n, 10))))
    assert got == [(r, k, a, b - a) for r, m in enumerate(n.tolist()) for k, (a, b) in enumerate(packing.cuts(m, 10))]


def test_token_files_round_trip(spark, docs, tokenizer, tmp_path):
    df = docs(extra=True)
    folder = f"file://{tmp_path}/t"
    index = token_files.write_token_files(df, folder, tokenizer)
    got = token_files.read_token_files(spark, folder).collect()
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows] and [r.doc_index for r in got] == list(range(len(rows)))
    at = 0
    for r, e in zip(got, whole(tokenizer, [r.text for r in rows])):
        own = np.array([*e, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert token_files.read_ids(folder, index[0], 0).tolist() == [*whole(tokenizer, [rows[0].text])[0], 0]
    assert index[0]["bits"] == 16


def test_token_files_empty(spark, docs, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/t"
    assert token_files.write_token_files(docs([]), folder, tokenizer) == []
    assert token_files.read_token_files(spark, folder).count() == 0


def test_output_leaves_whole_files_only(tmp_path):
    with pytest.raises(RuntimeError), storage.Output(f"file://{tmp_path}/x") as f:
        f.write(b"part")
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []
    with storage.Output(f"{tmp_path}/x y") as f:
        f.write(b"all")
    assert storage.Input(f"file://{tmp_path}/x%20y").read(1, 2) == b"ll"


def test_cuts():
    assert packing.cuts(5, 10) == [(0, 5)] and packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(25, 10) == [(0, 5), (5, 15), (15, 25)] and packing.cuts(20, 10) == [(0, 10), (10, 20)]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths, room = rng.integers(1, 64, 400), 64
    b, at, n = packing.best_fit(lengths, room)
    used = np.zeros(n, int)
    for k in np.lexsort((at, b)):
        assert at[k] == used[b[k]]
        used[b[k]] += lengths[k]
    assert used.max() <= room and packing.lower_bound(lengths, room) <= n <= packing.lower_bound(lengths, room) * 1.05 + 1


def test_bound_knows_large_items():
    assert packing.lower_bound(np.array([33, 33, 33]), 64) == 3
    assert packing.lower_bound(np.array([22] * 6), 64) == 3  # two to a bin
    assert packing.lower_bound(np.array([], int), 64) == 0


def test_plan(spark, docs, tokenizer):
    df = docs(extra=True)
    rows = packing.plan(df, tokenizer, room=64, part_items=4).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    total, by_sequence = 0, {}
    for doc_id, own in texts.items():
        parts = [r for r in rows if r.doc_id == doc_id]
        e = [*whole(tokenizer, own[:1])[0], 2]
        total += len(e) * len(own)
        assert len(parts) == len(packing.cuts(len(e), 64)) * len(own)
        for r in parts:
            piece = np.array(e[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and (r.length == 64 or r.piece == 0)
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in rows) == total and len(by_sequence) <= -(-total // 64) + 3
    assert packing.plan(docs([]), tokenizer).count() == 0


def test_a_lone_gap_exchanges(spark):
    """One part with a gap beside one without: they are packed as one, and the saving is kept."""
    rng, room = np.random.default_rng(0), 40
    gap = lambda x: packing.best_fit(x, room)[2] - packing.lower_bound(x, room)
    for _ in range(10_000):
        a, b = rng.integers(5, 20, 17), rng.integers(5, 20, 17)
        both = np.concatenate([a, b])
        if gap(a) == 1 and gap(b) == 0 and packing.best_fit(both, room)[2] < packing.best_fit(a, room)[2] + packing.best_fit(b, room)[2]:
            break
    rows = [(i, 0, 0, int(n), i, int(i >= len(a))) for i, n in enumerate(both)]
    packed = packing._packed(spark.createDataFrame(rows, packing.PIECES + ", part long"), room)
    again, rest, low = packing._exchanged(packed, room, 1, 2)
    assert rest.count() == 0 and low == 3 and sorted(r.doc_id for r in again.collect()) == list(range(34))
    assert again.first().bins == packing.best_fit(both, room)[2]
    alone = packing._packed(spark.createDataFrame(rows[: len(a)], packing.PIECES + ", part long"), room)
    assert packing._exchanged(alone, room, 1, 2) is None


def test_sequences(spark, docs, tokenizer):
    df = docs([(i, f"text number {i} " * i, "en", "a") for i in range(1, 30)])
    placed = packing.plan(df, tokenizer, room=64)
    out = packing.sequences(df, placed, tokenizer, room=64).collect()
    first = {r.doc_id: r.text for r in df.collect()}
    for r in out:
        assert len(r.ids) == sum(s.length for s in r.spans) <= 64
        for s in r.spans:
            e = [*whole(tokenizer, [first[s.doc_id]])[0], 2]
            a = dict(enumerate(x for x, _ in packing.cuts(len(e), 64)))[s.piece]
            assert r.ids[s.offset : s.offset + s.length] == e[a : a + s.length]
