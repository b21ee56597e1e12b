"""Token-id files: flat unsigned integers beside 64-bit document offsets.

A data set is a folder of shards in ascending doc_id order.  Shard s has three files:

- `s.ids`: all ids of its documents, one after the other, 16 bits each where the vocabulary
  has at most 65,536 ids and 32 bits otherwise, little-endian
- `s.off`: unsigned 64-bit, one more than it has documents: where each begins, in ids, from 0
- `s.doc`: signed 64-bit, the doc_id of each

and `index.json` lists the shards with the ids and documents before each: prefix
sums over one small row for each shard, so a document's place in the whole is a base plus
an offset and no task waits for another.

Documents are dealt by ranges of doc_id, so every shard holds one range; ties (repeated ids) keep
the order of the input and may go on in the next shard.  A null or empty text has the end id
alone, a null doc_id counts as the smallest (stored as -2**63), an empty table gives no shard.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetrail.llm import storage
from gazetrail.llm.tokens import encoder
from gazetrail.llm.textblocks import blocks, lean

NO_ID = -(2**63)


def _ranged(docs: DataFrame) -> DataFrame:
    """Documents with input order as tie-break, in ranges of both."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
        F.monotonically_increasing_id().alias("o"),
        F.coalesce("text", F.lit("")).alias("t"),
    )
    return rows.repartitionByRange("d", "o").sortWithinPartitions("d", "o")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[dict]:
    """Encode `docs` (doc_id, text) into `folder`; returns the index, one entry for each shard."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        kind = "<u2" if max(code.size, end_id + 1) <= 1 << 16 else "<u4"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"shard-{TaskContext.get().partitionId():06d}"
        at, docs_n = 0, 0
        with storage.Output(f"{folder}/{name}.ids") as ids, storage.Output(f"{folder}/{name}.off") as off, storage.Output(f"{folder}/{name}.doc") as doc:
            off.write(np.zeros(1, "<u8").tobytes())
            for b in (b for part in ([first], batches) for b in part):
                doc.write(b.column("d").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for _, _, data, ends in blocks(b.column("t")):
                    own, places = code.encode_block(data, ends, end_id)
                    ids.write(own.astype(kind).tobytes())
                    off.write((at + places[1:]).astype("<u8").tobytes())
                    at += len(own)
                docs_n += b.num_rows
        yield pa.RecordBatch.from_pylist([{"shard": name, "n_docs": docs_n, "n_ids": at, "bits": 8 * np.dtype(kind).itemsize}])

    made = _ranged(docs).mapInArrow(lean(shard), "shard string, n_docs long, n_ids long, bits long").collect()
    index, tokens, before = [], 0, 0
    for r in sorted(made, key=lambda r: r.shard):
        index.append(r.asDict() | {"ids_before": tokens, "docs_before": before})
        tokens, before = tokens + r.n_ids, before + r.n_docs
    _put_index(docs.sparkSession, folder, index)
    return index


def _put_index(spark: SparkSession, folder: str, index: list[dict]) -> None:
    with storage.Output(f"{folder}/index.json") as f:
        f.write(json.dumps(index).encode())


def read_token_files(spark: SparkSession, folder: str, index: list[dict] | None = None) -> DataFrame:
    """One row for each document, from the files alone: doc_id, start, n_tokens, ids_crc32 (of the
    ids as 32-bit integers), shard, doc_index (documents before it)."""
    if index is None:
        whole = storage.Input(f"{folder}/index.json")
        index = json.loads(whole.read(0, whole.size))
    cols = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, doc_index long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in (s for b in batches for s in b.to_pylist()):
            at = f"{folder}/{s['shard']}"
            ids, kind = storage.Input(f"{at}.ids"), f"<u{s['bits'] // 8}"
            off = np.frombuffer(storage.Input(f"{at}.off").read(0, 8 * (s["n_docs"] + 1)), "<u8").astype(np.int64)
            doc = np.frombuffer(storage.Input(f"{at}.doc").read(0, 8 * s["n_docs"]), "<i8")
            width = s["bits"] // 8
            crc = [zlib.crc32(np.frombuffer(ids.read(a * width, (b - a) * width), kind).astype("<u4")) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, mask=doc == NO_ID),
                    pa.array(off[:-1] + s["ids_before"]),
                    pa.array(np.diff(off)),
                    pa.array(crc, pa.int64()),
                    pa.array([s["shard"]] * len(doc)),
                    pa.array(np.arange(len(doc)) + s["docs_before"]),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "doc_index"],
            )

    shards = spark.createDataFrame([tuple(r[k] for k in ("shard", "n_docs", "n_ids", "bits", "ids_before", "docs_before")) for r in index], "shard string, n_docs long, n_ids long, bits long, ids_before long, docs_before long")
    return shards.repartition(max(1, len(index))).mapInArrow(lean(read), cols)


def read_ids(folder: str, entry: dict, k: int) -> np.ndarray:
    """ids of document `k` of the shard `entry`, from a range read."""
    a, b = np.frombuffer(storage.Input(f"{folder}/{entry['shard']}.off").read(8 * k, 16), "<u8").tolist()
    width = entry["bits"] // 8
    return np.frombuffer(storage.Input(f"{folder}/{entry['shard']}.ids").read(a * width, (b - a) * width), f"<u{width}")
