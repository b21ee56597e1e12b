"""Near-duplicate groups by 64-bit SimHash fingerprints.

Fingerprints come from one pass over the whole texts.  Equal ones are merged first, so copies
cost one row.  Two that differ in at most k bits agree in one of k+1 blocks of
bits, so each goes to k+1 buckets, one for each block; the buckets of a task are joined with
themselves by a walk over pairs of nodes of a binary trie (`trie`).  A bucket
of more than `most` values is cut at the trie's next levels: each of its values goes to
the pairs of nodes it can belong to, and each pair is joined on its own.
A bucket gives a link to the smallest member for each value that has one, never all pairs;
the links' components are found with joins (`components`).

That is exact, and practical for the few bits of a fingerprint identity.  For similar texts
(`similar_groups`: Jaccard similarity of the sets of shingles) a budget of many bits has no selective block.  There, buckets are
16 pairs of 16 minima of the shingles' hashes under fixed permutations: texts of similarity 0.8 share one with
probability 0.99998.  The trie join with a budget of bits (and 7 equal minima) makes rough groups of
the buckets.  Only texts of a rough group are read once more for their sets of shingles, and within each the similarity itself
is computed, exactly and for every pair that may matter; large rough groups are dealt to many tasks (`_exact_links`).

Texts: A-Z are lower-cased, words are runs without ASCII white space, shingles of n words are joined by a
space (repeats count; fewer words: the whole sequence).  A bit is 1 if it is set in over half of the
shingles' XXH64 (seed 42).  No words, and a null text: fingerprint 0, which is linked like any other.
Null doc_ids are kept; a group's id is the smallest doc_id that is not null.  A row's key is its doc_id with a
hash of its text as it is: ids may be null or stand for several texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gazetrail.llm import sieve, storage
from gazetrail.llm.components import components
from gazetrail.llm.textblocks import blocks, lean
from gazetrail.llm.trie import Links, link

PIECE = 1 << 15  # shingles of a text that are counted together


KEYS, EQUAL = 16, 7
_ODD = np.random.default_rng(8).integers(0, 2**63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(9).integers(0, 2**63, KEYS, dtype=np.uint64)


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """The SimHash of a text in UTF-8."""
    words = text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else iter([b" ".join(words)])
    total, ones = max(1, len(words) - n + 1), np.zeros(64, np.int64)
    hashes = map(xxh64_intdigest, shingles, repeat(seed))
    for a in range(0, total, PIECE):
        m = min(PIECE, total - a)
        h = np.fromiter(hashes, "<u8", m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(x, shingle) for x in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return _rows(docs).mapInArrow(lean(run), "doc_id long, fp long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _raw(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for _, _, data, off in blocks(b.column("text")):
        raw, off = data.tobytes(), off.tolist()
        yield from (raw[x:y] for x, y in zip(off[:-1], off[1:]))


def shingle_set(text: bytes, n: int, seed: int = 42) -> tuple[int, np.ndarray]:
    """(hash of the sequence of words, sorted distinct hashes of the shingles)."""
    words = text.lower().split()
    joined = xxh64_intdigest(b" ".join(words), seed)
    if len(words) < n:
        return joined, np.array([joined] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n))))
    return joined, np.unique(np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - n + 1))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, raw, node, fp, sketch, cells): a hash of the text as it is, one of its words, the fingerprint of its distinct shingles,
    16 bits of each minimum, and the buckets of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, low = [], [], np.full((b.num_rows, KEYS), 2**64 - 1, np.uint64)
            for r, text in enumerate(_texts(b)):
                node, h = shingle_set(text, shingle)
                ones = np.zeros(64, np.int64)
                for a in range(0, len(h), PIECE):
                    part = h[a : a + PIECE]
                    ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    for k in range(KEYS):
                        x = part * _ODD[k] + _ADD[k]
                        low[r, k] = min(low[r, k], (x ^ (x >> np.uint64(32))).min())
                nodes.append(node)
                fps.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]))
            cells = (low ^ (np.roll(low, -1, axis=1) * _ODD)) * _ODD[0] + np.arange(KEYS, dtype=np.uint64)
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * KEYS), b.num_rows, [None, pa.py_buffer((low >> np.uint64(24)).astype("<u2").tobytes())])
            cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * KEYS), pa.array(cells.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("raw"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), sketch.cast(pa.binary()), cells], ["doc_id", "raw", "node", "fp", "sketch", "cells"])

    return _rows(docs).withColumn("raw", _raw("text")).mapInArrow(lean(run), "doc_id long, raw long, node long, fp long, sketch binary, cells array<long>")


def shingle_sets(docs: DataFrame, shingle: int, firsts: DataFrame) -> DataFrame:
    """(node, bag): the distinct shingles of texts, as sorted unsigned 32-bit hashes.  `firsts` has the slots
    (`_slot`) of one row of each text that is wanted; other rows are left out by a bounded table of bits, but for a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingle_set(x, shingle) for x in _texts(b)]
            bags = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for _, h in got]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x for x, _ in got], np.uint64).view(np.int64)), pa.array(bags, pa.binary())], ["node", "bag"])

    rows = _rows(docs).withColumn("slot", _slot(F.col("doc_id"), _raw("text")))
    rows = sieve.split(rows, firsts, "slot").filter("maybe").select("text")
    return rows.mapInArrow(lean(run), "node long, bag binary").groupBy("node").agg(F.first("bag").alias("bag"))


def _slot(doc_id: Column, raw: Column) -> Column:
    return F.xxhash64(doc_id, raw)


def _link_cells(budget: int, block: int):
    """Links within the cells of a task: rows (cell, side, key); side 0 is joined with itself,
    sides 1 and 2 with each other; `block` bits at the top of the key are alike in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        got = pa.Table.from_batches(parts)
        cell, side, key, fp = (got.column(c).to_numpy() for c in ("cell", "side", "key", "fp"))
        key = key.view(np.uint64)
        order = np.lexsort((key, side, cell))
        cell, side, key, fp = cell[order], side[order], key[order], fp[order]
        start = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])))
        end = np.append(start[1:], len(cell))
        own = side[start] == 0
        pair = np.flatnonzero((side[start[:-1]] == 1) & (side[start[1:]] == 2) & (cell[start[:-1]] == cell[start[1:]]))
        label = link(key, np.append(start[own], start[pair]), np.append(end[own], end[pair]), np.append(start[own], start[pair + 1]), np.append(end[own], end[pair + 1]), 63 - block, budget).label
        far = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["u", "v"])

    return run


def links(fps: DataFrame, budget: int = 3, most: int = 20_000) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v): links that connect all fingerprints within `budget` bits
    of each other; 1 to 31 bits."""
    width = 64 // (budget + 1)
    cuts = [(t * width, width) for t in range(budget + 1)]
    turned = lambda at: F.expr(f"shiftleft(fp, {at}) | shiftrightunsigned(fp, {64 - at})") if at else F.col("fp")
    rows = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("t"), turned(at).alias("key")) for t, (at, _) in enumerate(cuts)))).alias("r"))
    rows = rows.select("fp", "r.t", "r.key", F.expr(f"shiftrightunsigned(r.key, {64 - width})").alias("b"))
    large = rows.groupBy("t", "b").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    large = storage.written(large, "large-buckets")
    cells = rows
    if large.first() is not None:
        # n / 2^q is at most `most` where the values are even; q levels below the bucket's bits
        large = large.withColumn("q", F.least(F.lit(64 - width), F.lit(12), F.ceil(F.log2(F.col("n") / most)) + 1).cast("int"))
        cells = rows.join(large.drop("n"), ["t", "b"], "left")
        masks = F.broadcast(_masks(fps, budget, 12))
        hot = cells.filter("q is not null").withColumn("a", F.expr(f"shiftrightunsigned(shiftleft(key, {width}), 64 - q)"))
        hot = hot.join(masks, hot.q == masks.levels).withColumn("o", F.expr("a ^ mask"))
        hot = hot.select("fp", "key", _cell("t", "b", "least(a, o)", "greatest(a, o) + 1"), F.expr("int(if(mask = 0, 0, if(a < o, 1, 2)))").alias("side"))
        cells = cells.filter("q is null").select("fp", "key", _cell("t", "b"), F.lit(0).alias("side")).unionAll(hot)
    else:
        cells = cells.select("fp", "key", _cell("t", "b"), F.lit(0).alias("side"))
    return cells.repartition("cell").mapInArrow(lean(_link_cells(budget, width)), "u long, v long")


def _cell(t: str, b: str, low: str = "0", high: str = "0"):
    """A cell's number; t has 5 bits, b at most 32, the two nodes 13 each (high is 0 for a whole bucket)."""
    return F.expr(f"shiftleft({t}, 58) | shiftleft({b}, 26) | shiftleft({low}, 13) | {high}").alias("cell")


def _masks(df: DataFrame, budget: int, levels: int) -> DataFrame:
    """(levels, mask): the differences of at most `budget` bits between two nodes so many levels down."""
    from itertools import combinations

    rows = [(q, sum(1 << i for i in c)) for q in range(1, levels + 1) for k in range(budget + 1) for c in combinations(range(q), k)]
    return df.sparkSession.createDataFrame(rows, "levels int, mask long")


def _alike(sketch: np.ndarray):
    return lambda i, j: (sketch[i] == sketch[j]).sum(axis=1) >= EQUAL


class _Bags:
    """Sets of one task: sorted hashes, one set after the other."""

    def __init__(self, bags: pa.Array):
        raw = bags.to_pylist()
        self.size = np.array([len(x) // 4 for x in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(raw), "<u4")

    def of(self, k: int) -> np.ndarray:
        return self.all[self.first[k] : self.first[k] + self.size[k]]

    def similar(self, x: int, y: int, least: float) -> bool:
        """Whether the Jaccard similarity of two sets is `least` or more; two empty ones are alike."""
        n, m = int(self.size[x]), int(self.size[y])
        if n > m:
            x, y, n, m = y, x, m, n
        if n < least * m:
            return False
        if not m:
            return True
        a, b = self.of(x), self.of(y)
        at = np.minimum(np.searchsorted(b, a), m - 1)
        both = int((b[at] == a).sum())
        return both >= least * (n + m - both)

    def pairs(self, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of `left` and `right` of that similarity, from products of 0-1 matrices over the hashes that several sets have."""
        if len(left) * len(right) <= FEW_PAIRS:
            found = [(x, y) for x in left.tolist() for y in right.tolist() if x != y and self.similar(x, y, least)]
            return tuple(np.array(found, np.int64).reshape(-1, 2).T)
        rows = np.union1d(left, right)
        flat = np.concatenate([self.of(k) for k in rows.tolist()])
        at = np.repeat(np.arange(len(rows)), self.size[rows])
        order = np.argsort(flat, kind="stable")
        flat, at = flat[order], at[order]
        new = np.append(True, flat[1:] != flat[:-1]) if len(flat) else np.zeros(0, bool)
        many = np.diff(np.append(np.flatnonzero(new), len(flat)))
        shared = np.repeat(many > 1, many)
        column, at = (np.cumsum(new & shared) - 1)[shared], at[shared]
        li, ri = np.searchsorted(rows, left), np.searchsorted(rows, right)
        total = np.zeros((len(li), len(ri)), np.int32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
            ones = np.zeros((len(rows), min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
            ones[at[part], column[part] - c] = 1
            turned = ones[ri].T
            for x in range(0, len(li), SIDE):
                total[x : x + SIDE] += (ones[li[x : x + SIDE]] @ turned).astype(np.int32)  # counts of a part are exact
        n, m = self.size[left][:, None], self.size[right][None]
        a, b = np.nonzero((total >= least * (n + m - total)) & (left[:, None] != right[None]))
        return left[a], right[b]


FEW_PAIRS, SIDE, COLUMNS = 64, 512, 2048


def _sorted_cells(batches: Iterator[pa.RecordBatch], *columns: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows by cell and `columns`, order, first and last row of each cell)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    got = pa.Table.from_batches(parts)
    order = np.lexsort([*(got.column(c).to_numpy().view(np.uint64) for c in reversed(columns)), got.column("cell").to_numpy()])
    cell = got.column("cell").to_numpy()[order]
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return got, order, start, np.append(start[1:], len(cell))


def _link_rough(budget: int):
    """Links within the cells of a task by bits and minima: rows (cell, node, fp, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _sorted_cells(batches, "fp")
        if cells is None:
            return
        got, order, start, end = cells
        node, fp = got.column("node").to_numpy()[order], got.column("fp").to_numpy().view(np.uint64)[order]
        sketch = np.frombuffer(b"".join(got.column("sketch").to_pylist()), "<u2").reshape(-1, KEYS)[order]
        label = link(fp, start, end, start, end, 63, budget, _alike(sketch)).label
        far = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["u", "v"])

    return run


def _link_similar(similarity: float):
    """Links within the cells of a task by the similarity itself: rows (cell, node, bag, side, open).

    Open rows of side 0 are compared with each other; those of side 1 with all of side 2, which may have rows that are
    not open: these are linked with each other already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _sorted_cells(batches)
        if cells is None:
            return
        got, order, start, end = cells
        node, side, open_ = got.column("node").to_numpy()[order], got.column("side").to_numpy()[order], got.column("open").to_numpy(zero_copy_only=False)[order]
        bags, links = _Bags(got.column("bag").combine_chunks().take(pa.array(order))), Links(len(node))
        for a, b in zip(start.tolist(), end.tolist()):
            shut = a + np.flatnonzero(~open_[a:b])
            if len(shut):
                links.label[shut] = shut[0]
        before = links.label.copy()
        for a, b in zip(start.tolist(), end.tolist()):
            own = np.arange(a, b)
            left, right = own[side[a:b] < 2], own[side[a:b] != 1]
            if len(left) and len(right):
                links.join(*bags.pairs(left, right, similarity))
        far = np.flatnonzero((links.label != before) & (before == np.arange(len(node))))
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[links.label[far]])], ["u", "v"])

    return run


def _link_pivot(similarity: float):
    """(u, v) for each row of a cell (cell, node, bag, pivot) that is similar to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _sorted_cells(batches)
        if cells is None:
            return
        got, order, start, end = cells
        node, pivot = got.column("node").to_numpy()[order], got.column("pivot").to_numpy(zero_copy_only=False)[order]
        bags = _Bags(got.column("bag").combine_chunks().take(pa.array(order)))
        u, v = [], []
        for a, b in zip(start.tolist(), end.tolist()):
            k = a + int(np.flatnonzero(pivot[a:b])[0])
            near = [i for i in range(a, b) if not pivot[i] and bags.similar(i, k, similarity)]
            u += node[near].tolist()
            v += [int(node[k])] * len(near)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of buckets (cell, sketch, used, ...) in finer ones, each by one more of the minima; `used` has those a bucket is made of.

    Candidates have EQUAL of KEYS minima alike, hence some besides those used, as long as these are fewer: of any
    KEYS - EQUAL + 1 of the others they share one.  No pair is lost."""
    others = F.slice(F.filter(F.sequence(F.lit(0), F.lit(KEYS - 1)), lambda j: ~F.array_contains("used", j)), 1, KEYS - EQUAL + 1)
    rows = rows.withColumn("j", F.explode(others))
    value = F.call_function("substring", F.col("sketch"), 2 * F.col("j") + 1, F.lit(2))
    return rows.withColumns({"cell": F.xxhash64("cell", "j", value), "used": F.array_append("used", F.col("j"))}).drop("j")


def _buckets(nodes: DataFrame, *columns) -> DataFrame:
    """(cell, used, ...): a text's buckets, each of two neighbouring minima."""
    rows = nodes.select(*columns, F.posexplode("cells").alias("k", "cell"))
    return rows.withColumn("used", F.array("k", (F.col("k") + 1) % KEYS)).drop("k")


def _rough_links(nodes: DataFrame, budget: int, most: int) -> DataFrame:
    """Links (u, v) such that similar texts are in one component: within each bucket that has two texts at least, by bits
    and minima.  A bucket of more than `most` texts is refined once, and what is larger still is linked as a whole."""
    cells = _buckets(nodes, "node")
    sizes = storage.written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-cells")
    shared = cells.join(sizes.filter(F.col("n") <= most).select("cell"), "cell").select("cell", "node")
    hot = sizes.filter(F.col("n") > most)
    whole = None
    if hot.first() is not None:
        rows = cells.join(hot.select("cell"), "cell").join(nodes.select("node", "sketch"), "node")
        rows = storage.written(_finer(rows).select("cell", "node"), "finer-cells")
        again = storage.written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).filter("n > 1"), "shared-finer")
        shared = shared.unionByName(rows.join(again.filter(F.col("n") <= most).select("cell"), "cell"))
        whole = rows.join(again.filter(F.col("n") > most).select("cell", "low"), "cell").select(F.col("node").alias("u"), F.col("low").alias("v"))
    rows = shared.join(nodes.select("node", "fp", "sketch"), "node")
    out = rows.select("cell", "node", "fp", "sketch").repartition("cell").mapInArrow(lean(_link_rough(budget)), "u long, v long")
    return out if whole is None else out.unionAll(whole)


def _exact_links(rows: DataFrame, similarity: float, most: int, room: int) -> DataFrame:
    """Links (u, v) that connect what chains of similar texts do, within rough groups: rows (root, node, bag).

    A group of up to `most` texts and `room` bytes is one cell of a task.  In a larger one every text is first compared with one of
    them, the pivot, in as many tasks as it takes; copies that are like it are settled by that.  The others stay open.  Open
    texts are dealt to blocks and so are the rest, and a cell has two blocks: each open text meets every
    text of its group once.  Where all are like the pivot that is linear; where few are, each text goes to as many
    cells as there are blocks, whose size grows with the group's up to LARGEST."""
    sizes = storage.written(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bag") + 64).alias("bytes"), F.min("node").alias("pivot")), "group-sizes")
    block = F.least(F.greatest(F.ceil(F.col("n") / 64), F.lit(most)), F.lit(max(most, LARGEST)))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.ceil(n / F.col("n") * F.col("bytes") / room), F.lit(1)).cast("int")
    sizes = sizes.select("root", "pivot", "n", "bytes", blocks(F.col("n")).alias("tasks"))
    linker = lambda df: df.select("cell", "node", "bag", "side", "open").repartition("cell").mapInArrow(lean(_link_similar(similarity)), "u long, v long")
    small = rows.join(sizes.filter("tasks = 1").select("root"), "root", "left_semi").withColumns({"cell": F.col("root"), "side": F.lit(0), "open": F.lit(True)})
    found = linker(small)
    large = sizes.filter("tasks > 1")
    if large.first() is None:
        return found
    big = storage.written(rows.join(large, "root"), "large-groups")
    salted = lambda df, pivot: df.select(F.xxhash64("root", "salt").alias("cell"), "node", "bag", F.lit(pivot).alias("pivot"))
    pivots = big.filter("node = pivot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    members = big.filter("node <> pivot").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int"))
    star = salted(members, False).unionAll(salted(pivots, True)).repartition("cell").mapInArrow(lean(_link_pivot(similarity)), "u long, v long")
    star = storage.written(star, "pivot-links")
    closed = star.select(F.col("u").alias("node"), F.lit(False).alias("open"))
    big = big.select("root", "node", "bag", F.col("pivot").alias("of")).join(closed, "node", "left").withColumn("open", F.coalesce("open", F.col("node") != F.col("of"))).drop("of")
    opens = big.filter("open").groupBy("root").agg(F.count(F.lit(1)).alias("opens"))
    dealt = opens.join(sizes, "root").select("root", blocks(F.col("opens")).alias("bo"), blocks(F.col("n") - F.col("opens")).alias("bc"))
    dealt = storage.written(dealt, "open-groups")
    if dealt.first() is None:
        return found.unionAll(star)
    rows = big.join(dealt, "root").withColumn("x", F.pmod(F.xxhash64("node"), F.when(F.col("open"), F.col("bo")).otherwise(F.col("bc"))).cast("int"))
    # open blocks 0 to bo - 1, the others from bo on; cells (p, q) with p < bo and p <= q
    cell = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
    x, upto = F.col("x"), lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    first = F.transform(upto(x + 1, F.col("bo") + F.col("bc") - 1), lambda q: cell(x, q, 1))
    second = F.transform(upto(F.lit(0), x - 1), lambda p: cell(p, x, 2))
    mine = F.concat(F.array(cell(x, x, 0)), first, second)
    rest = F.transform(upto(F.lit(0), F.col("bo") - 1), lambda p: cell(p, F.col("bo") + x, 2))
    rows = rows.withColumn("pq", F.explode(F.when(F.col("open"), mine).otherwise(rest))).select(F.xxhash64("root", "pq.p", "pq.q").alias("cell"), "node", "bag", "pq.side", "open")
    return found.unionAll(star).unionAll(linker(rows))


def groups(docs: DataFrame, shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text): component_id is the
    smallest doc_id among the documents that chains of fingerprints within `budget` bits reach."""
    own = storage.written(fingerprints(docs, shingle), "fingerprints")
    distinct = _distinct(own)
    return _named(own, distinct, links(distinct.select("fp"), budget))


MOST, LARGEST, ROOM, ROUGH = 128, 2048, 16 << 20, 20_000  # texts of a block, at least and at most; bytes of its sets; texts of a bucket


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, budget: int | None = None, most: int = MOST, room: int = ROOM, rough: int = ROUGH) -> DataFrame:
    """(doc_id, component_id) for each row of `docs`: chains of texts of Jaccard similarity `similarity` or more
    between their sets of shingles (texts without words are alike).

    Two such sets have a cosine of 2s / (1 + s), so each bit differs with p = acos(...) / pi at most; the budget
    is the mean of 64 such bits and four standard deviations (21 at 0.8), unless it is given."""
    return _similar(docs, shingle, similarity, budget, most, room, rough).select("doc_id", F.col("first.doc_id").alias("component_id"))


def _similar(docs: DataFrame, shingle: int, similarity: float, budget: int | None = None, most: int = MOST, room: int = ROOM, rough: int = ROUGH) -> DataFrame:
    """(doc_id, raw, first) for each row of `docs`: first is the key of its group's first row, by doc_id with nulls last,
    then by the hash of the text."""
    if budget is None:
        p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        budget = int(64 * p + 4 * np.sqrt(64 * p * (1 - p)))
    since = storage.mark()
    own = storage.written(signatures(docs, shingle), "signatures")
    nodes = storage.written(own.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first"), *(F.first(c).alias(c) for c in ("fp", "sketch", "cells"))), "distinct-texts")
    groups_ = components(_rough_links(nodes, budget, rough)).select("node", "root")
    firsts = storage.written(groups_.join(nodes.select("node", "first"), "node").select("root", "node", _slot(F.col("first.doc_id"), F.col("first.raw")).alias("slot")), "rough-groups")
    sets = shingle_sets(docs, shingle, firsts.select("slot"))
    rows = storage.written(firsts.select("root", "node").join(sets, "node").select("root", "node", "bag"), "rough-sets")
    root = components(_exact_links(rows, similarity, most, room))
    storage.free(since, own, nodes, root)
    named = nodes.select("node", "first").join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("first"))
    return own.select("doc_id", "raw", "node").join(named.select("node", "root").join(ids, "root").select("node", "first"), "node").select("doc_id", "raw", "first")


def _distinct(own: DataFrame) -> DataFrame:
    return storage.written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")


def _named(own: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    root = components(found)
    named = distinct.join(root, distinct.fp == root.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return own.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of `similar_groups`, the one with the smallest doc_id (nulls last), unchanged.  Repeated rows
    of an id and text leave one."""
    since = storage.mark()
    found = storage.written(_similar(docs, shingle, similarity), "near-duplicates")
    storage.free(since, found)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("raw") == F.col("first.raw"))
    gone = found.filter(~stays).select("doc_id", "raw", F.lit(False).alias("once")).distinct()
    many = found.filter(stays).groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "raw", F.lit(True).alias("once"))
    marked = storage.written(gone.unionByName(many).withColumn("slot", _slot(F.col("doc_id"), F.col("raw"))), "marked-rows")
    # whole rows as one column: no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), _raw("text").alias("key"))
    rows = sieve.split(rows.withColumn("slot", _slot(F.col("id"), F.col("key"))), marked.select("slot"), "slot")
    some = rows.filter("maybe").drop("slot").join(marked.drop("slot"), rows["id"].eqNullSafe(marked["doc_id"]) & (rows["key"] == marked["raw"]), "left")
    once = some.filter("once").groupBy("id", "key").agg(F.first("row").alias("row")).select("row")
    return rows.filter("not maybe").select("row").unionByName(some.filter("once is null").select("row")).unionByName(once).select("row.*")
