"""Best-fit packing of documents into sequences, with certified bin counts.

A document longer than a sequence is cut from its end into full pieces, so that only its first
piece is shorter; full pieces are sequences of their own and every other piece is an item.
Items are dealt by a hash into parts of about `part_items`, each packed by best-fit decreasing in one
task (a part is a few numbers for each item).  Lower bounds from dual feasible functions tell for each part
whether its count is the least possible; parts with a gap exchange their items, dealt
anew among half as many, and are packed again while that saves sequences.  A lone part with a gap exchanges with one
that has none; where there is one part in all, nothing can be exchanged and best-fit decreasing is the result.

A null or empty text has the end id alone.  Repeated rows are packed each on their own.  A row whose doc_id is
null is packed as any other.  An empty table gives no rows.  A long text is encoded as a whole, unit by unit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.llm import storage
from gazetrail.llm.tokens import encoder
from gazetrail.llm.textblocks import blocks, lean

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = PIECES + ", sequence_id long, offset long"


def cuts(n: int, room: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document of n tokens; only the first may be short."""
    first = n % room or min(n, room)
    return [(0, first), *((a, a + room) for a in range(first, n, room))]


def _cut(n: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of n tokens each, as `cuts` has them."""
    many = -(-n // room)
    row = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    head = n - (many - 1) * room
    start = np.where(piece > 0, head[row] + (piece - 1) * room, 0)
    return row, piece, start, np.where(piece > 0, room, head[row])


def pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32 (and ids, on demand)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for b in batches:
            for x, y, data, off in blocks(b.column("text")):
                flat, at = code.encode_block(data, off, end_id)
                row, piece, start, length = _cut(np.diff(at), room)
                first = at[row] + start
                raw = memoryview(flat.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(first.tolist(), (first + length).tolist())]
                cols = [b.column("doc_id").take(pa.array(x + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    ends = np.append(0, np.cumsum(length)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item by best-fit decreasing, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]  # bins by the room they have left
    some, count = 0, 0  # bit r: a bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            b, left, count = count, room, count + 1
        bins[i], offsets[i] = b, room - left
        if left > n:
            free[left - n].append(b)
            some |= 1 << (left - n)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """The most that dual feasible functions prove: the identity, thresholds, and roundings to k-ths."""
    if not len(lengths):
        return 0
    h = np.bincount(lengths, minlength=room + 1)[: room + 1].astype(np.int64)
    size = np.arange(room + 1)
    n, s = np.append(0, np.cumsum(h)), np.append(0, np.cumsum(h * size))
    best = -(-int(s[-1]) // room)
    half = room // 2
    for k in range(half + 1):
        large = n[-1] - n[room - k + 1]  # over room - k: alone, whatever is small
        mid = n[room - k + 1] - n[half + 1]
        left = mid * room - (s[room - k + 1] - s[half + 1])
        small = s[half + 1] - s[k]
        best = max(best, int(large + mid + max(0, -(-int(small - left) // room))))
    for k in range(1, 65):
        x = (k + 1) * size
        f = np.where(x % room == 0, size * k, x // room * room)  # of k * room
        best = max(best, -(-int((h * f).sum()) // (k * room)))
    return best


def _packer(room: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        lengths = part["length"].to_numpy(np.int64)
        b, at, count = best_fit(lengths, room)
        return part.assign(bin=b, offset=at, bins=count, bound=lower_bound(lengths, room))

    return run


def _packed(items: DataFrame, room: int) -> DataFrame:
    rows = items.groupBy("part").applyInPandas(_packer(room), PIECES + ", part long, bin long, offset long, bins long, bound long")
    return storage.written(rows, "packed")


def _state(packed: DataFrame) -> DataFrame:
    return packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))


def _dealt(rows: DataFrame, salt: int, low: int, many: int) -> DataFrame:
    """`rows` with a part from `low` on, by a hash; rows of one text go to different parts."""
    return rows.withColumn("part", low + F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(salt), F.monotonically_increasing_id()), F.lit(many)))


def _exchanged(packed: DataFrame, room: int, salt: int, low: int) -> tuple[DataFrame, DataFrame, int] | None:
    """(parts packed again, the parts as they were that stay, next number of a part), or None where nothing is saved."""
    state = storage.written(_state(packed), "part-bounds")
    pool = state.filter("bins > bound")
    if pool.limit(2).count() == 1:  # it exchanges with one that needs no saving
        pool = pool.unionAll(state.filter("bins <= bound").orderBy(F.xxhash64("part", F.lit(salt))).limit(1))
    pool = storage.written(pool, "open-parts")
    many, bins = pool.agg(F.count("*"), F.sum("bins")).first()
    if many < 2:
        return None
    open_ = packed.join(pool.select("part"), "part", "left_semi").select("doc_id", "piece", "start", "length", "ids_crc32")
    again = _packed(_dealt(open_, salt, low, many // 2), room)
    if _state(again).agg(F.sum("bins")).first()[0] >= bins:
        return None
    return again, packed.join(pool.select("part"), "part", "left_anti"), low + many // 2


def plan(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, part_items: int = 50_000, rounds: int = 3) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    every = storage.written(pieces(docs, tokenizer, room, end_id), "pieces")
    full = every.filter(F.col("length") == room).withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    items = every.filter(F.col("length") < room)
    n = items.count()
    if not n:
        return full
    parts = -(-n // part_items)
    packed, done, low = _packed(_dealt(items, 0, 0, parts), room), [], parts
    for salt in range(1, rounds + 1):
        got = _exchanged(packed, room, salt, low)
        if got is None:
            break
        packed, rest, low = got
        done.append(rest)
    for rows in done:
        packed = packed.unionByName(rows)
    out = packed.withColumn("sequence_id", 2 * (F.shiftleft(F.col("part"), 32) + F.col("bin")))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(cols).unionByName(full.select(cols))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2) -> DataFrame:
    """(sequence_id, ids, spans) of a plan: the tokens of each sequence and the documents they are of.  doc_id must be unique."""
    own = pieces(docs, tokenizer, room, end_id, with_ids=True).select("doc_id", "piece", "ids")
    rows = placed.join(own, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    packed = rows.groupBy("sequence_id").agg(parts.alias("p"))  # at most `room` tokens
    return packed.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x.offset.alias("offset"), x.length.alias("length"), x.doc_id.alias("doc_id"), x.piece.alias("piece"))).alias("spans"))
