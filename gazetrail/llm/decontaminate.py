"""Benchmark passages in documents, within an edit budget.

A passage of n characters may have k = floor(n * rate) edits.  Cut into k + 1 pieces, one piece at
least is untouched in any such occurrence, so all pieces of all items go into one Aho-Corasick
automaton that reads each document once; each hit fixes where the passage would lie, and Myers'
bit-parallel distance decides there.  Nothing within the budget is missed.

Both sides are compared in lower case with each run of white space as one space.  An item so short that it may have
no edit (fewer than 20 characters at 5 %) is found wherever it stands as whole words.  Empty and null items match nothing; null texts are
empty.  Equal items are found under each of their ids; a null item_id is skipped.  Repeated rows of documents have each
their results; long texts are read as a whole.

Items are a stated query set: they are read in blocks of at most `block_chars` characters by a count of
their lengths, and each block is a pass over the documents with an automaton of that bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.llm import storage
from gazetrail.llm.textblocks import lean

RATE, BLOCK_CHARS = 0.05, 2_000_000
COLUMNS = "doc_id long, item_id long, edits long, start long, stop long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] begins and ends no letter or digit of a longer word."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(a) and not inside(b)


def places(text: str, wanted: list[int]) -> list[int]:
    """Where in `text` the characters of normal(text) at `wanted` (ascending) come from; its length stands for its end."""
    out, at, gap, n = [], 0, False, 0
    rest = iter(wanted)
    want = next(rest, None)
    last = 0
    for i, c in enumerate(text):
        if want is None:
            break
        if c.isspace():
            gap = at > 0
            continue
        if gap:
            n, gap = 1, False
            while want is not None and want < at + n:
                out.append(i - 1)
                want = next(rest, None)
            at += n
        n = len(c.lower())
        while want is not None and want < at + n:
            out.append(i)
            want = next(rest, None)
        at += n
        last = i + 1
    return out + [last] * (len(wanted) - len(out))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece): one more than the edits that `item` may have."""
    n, k = len(item), int(len(item) * rate)
    cut = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:])]


class Pattern:
    """Myers' bit-parallel search of one pattern of any length."""

    def __init__(self, pattern: str):
        self.n, self.eq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Fewest edits between the pattern and a part of `text`, and the end of the first such part."""
        mask, top, eq = (1 << self.n) - 1, 1 << (self.n - 1), self.eq
        pv, mv, score = mask, 0, self.n
        best, end = score, 0
        for j, c in enumerate(text):
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv) & mask, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            pv, mv = mh | ~(xv | ph) & mask, ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.rate, self.ids, found = rate, {}, {}
        for item_id, text in items:
            text = normal(text or "")
            if item_id is not None and text:
                self.ids.setdefault(text, []).append(item_id)
        self.texts = sorted(self.ids)
        for i, text in enumerate(self.texts):
            for at, piece in pieces(text, rate):
                found.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()
        self.patterns: dict[int, tuple[Pattern, Pattern]] = {}

    def find(self, raw: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, stop in `raw`): the best occurrence of each item in a document."""
        if not self.texts:
            return []
        text = normal(raw)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for last, (n, where) in self.auto.iter(text):
            for i, at in where:
                a = last + 1 - n - at
                if best.get(i, (1,))[0] == 0 or a in tried.setdefault(i, set()):
                    continue
                item = self.texts[i]
                k = int(len(item) * self.rate)
                if k == 0:
                    if whole_words(text, a, a + len(item)):
                        best[i] = (0, a, a + len(item))
                    continue
                tried[i].add(a)
                if a >= 0 and text.startswith(item, a):
                    best[i] = (0, a, a + len(item))
                    continue
                lo = max(0, a - k)
                hit = self._verify(i, item, text[lo : a + len(item) + k], k)
                if hit and (i not in best or hit[0] < best[i][0]):
                    best[i] = (hit[0], lo + hit[1], lo + hit[2])
        wanted = sorted({p for _, a, b in best.values() for p in (a, b - 1)})
        at = dict(zip(wanted, places(raw, wanted))) if best else {}
        return [(x, e, at[a], at[b - 1] + 1 if b > a else at[a]) for i, (e, a, b) in best.items() for x in self.ids[self.texts[i]]]

    def _verify(self, i: int, item: str, window: str, k: int) -> tuple[int, int, int] | None:
        if i not in self.patterns:
            self.patterns[i] = (Pattern(item), Pattern(item[::-1]))
        edits, end = self.patterns[i][0].best(window)
        if edits > k:
            return None
        _, back = self.patterns[i][1].best(window[:end][::-1])
        return edits, end - back, end


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about `block_chars` characters; a longer item is a list of its own.  More than one list's
    worth is written once, in one folder for each hash class, so the whole is read twice and no more."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = 1 + 2 * int(total) // block_chars
    if n > 1:
        path = storage.new_folder(items.sparkSession, "items")
        rows.withColumn("class", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition("class").write.partitionBy("class").parquet(path)
        rows = items.sparkSession.read.parquet(path)
    block, size = [], 0
    for k in range(n):
        for r in (rows.filter(F.col("class") == k) if n > 1 else rows).select("item_id", "text").toLocalIterator():
            if block and size + len(r.text) > block_chars:
                yield block
                block, size = [], 0
            block.append((r.item_id, r.text))
            size += len(r.text) + 1
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): each item of `items` (item_id, text) in each document that holds it
    within the budget, with its best place as characters of the text.  Empty tables give no rows."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for block in item_blocks(items, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate)
            for b in batches:
                ids, got = b.column("doc_id").to_pylist(), []
                for a in range(0, b.num_rows, 256):
                    for doc_id, text in zip(ids[a : a + 256], b.column("text").slice(a, 256).to_pylist()):
                        got += [(doc_id, *x) for x in finder.find(text)]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "edits", "start", "stop"])

        part = rows.mapInArrow(lean(run), COLUMNS)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], COLUMNS) if out is None else out


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` without any item within the budget, unchanged and not shuffled."""
    for block in item_blocks(items, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate)
            for b in batches:
                keep: list[bool] = []
                for a in range(0, b.num_rows, 256):
                    keep += [not finder.find(x or "") for x in b.column("text").slice(a, 256).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
