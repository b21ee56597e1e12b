"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored as the 8-bit samples
of a grey PNG image 64 samples wide.  Each task writes one tar shard whose members are named by the
SHA-256 of their payload; equal payloads of a shard are stored once.  Copies in different shards are stored in
each, so no payload is shuffled and a group of copies costs one member for each shard at most.
The index (doc_id, digest, shard, offset, length) is a Parquet table; `offset` is where the image begins.

Metadata columns come from range reads of the headers alone (`metadata`); `read_back` reads whole
members and computes what depends on the samples.  Null and empty texts are 64 zero bytes.  Repeated rows have each
their row and share a member; an empty table gives no shard and no row; a long text is a tall image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.llm import storage
from gazetrail.llm.textblocks import blocks, lean

WIDTH = 64
SIGN = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
META = INDEX + ", width long, height long, bits long, stored_name string"


def padded(data: bytes) -> bytes:
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 26 bytes of an image."""
    if head[:8] != SIGN or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    width, height, _ = png_header(image)
    data, at = b"", 8
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            data += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file, without times or owners."""
    head = bytearray(512)
    for at, text in ((0, name), (100, "0000644\0"), (108, "0000000\0"), (116, "0000000\0"), (124, f"{size:011o}\0"), (136, "00000000000\0"), (148, " " * 8), (156, "0"), (257, "ustar\x0000")):
        head[at : at + len(text)] = text.encode()
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """Store the texts of `docs` (doc_id, text) in `folder`; returns the index, written there too."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, at, seen = f"{folder}/media-{TaskContext.get().partitionId():06d}.tar", 0, {}
        with storage.Output(name) as out:
            for b in (b for part in ([first], batches) for b in part):
                rows = []
                for _, _, data, off in blocks(b.column("text")):
                    raw, off = data.tobytes(), off.tolist()
                    for x, y in zip(off[:-1], off[1:]):
                        digest = hashlib.sha256(payload := padded(raw[x:y])).digest()
                        if digest not in seen:
                            image = encode_png(payload)
                            out.write(tar_header(f"{digest.hex()}.png", len(image)) + image + bytes(-len(image) % 512))
                            seen[digest] = at + 512, len(image)
                            at = out.size
                        rows.append((y - x, digest.hex(), *seen[digest]))
                n, digests, offsets, lengths = zip(*rows) if rows else ([],) * 4
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array([name] * len(rows), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            out.write(bytes(1024))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(shard), INDEX)
    rows.write.parquet(f"{folder}/index.parquet")
    return docs.sparkSession.read.schema(rows.schema).parquet(f"{folder}/index.parquet")


def _by_shard(index: DataFrame) -> DataFrame:
    """A partition for each shard, by the number in its name."""
    number = F.regexp_extract("shard", r"media-(\d+)\.tar$", 1).cast("int")
    n = index.agg(F.max(number)).first()[0]
    return index.repartitionById(1 + (n or 0), number).sortWithinPartitions("shard", "offset")


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    name, file = None, None
    for b in batches:
        rows = []
        for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length"))):
            if shard != name:
                name, file = shard, storage.Input(shard)
            rows.append((file, offset, length))
        yield b, rows


HEAD = 512 + 26  # bytes of a member's tar header and the image's own


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, rows in _inputs(batches):
        heads = [f.read(offset - 512, HEAD) for f, offset, _ in rows]
        w, h, bits = zip(*(png_header(x[512:]) for x in heads)) if heads else ([],) * 3
        names = [x[:100].rstrip(b"\0").decode() for x in heads]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (w, h, bits)), pa.array(names, pa.string())], [*b.schema.names, "width", "height", "bits", "stored_name"])


def metadata(index: DataFrame) -> DataFrame:
    """The index with width, height, bits and stored_name, from range reads of HEAD bytes a row; rows come by shard."""
    return _by_shard(index).mapInArrow(lean(_headers), META)


def feature(payload: bytes) -> str:
    """Size, mean, spread and an 8 x 8 average hash of the samples."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    cuts = np.arange(8) * len(image) // 8
    rows = np.add.reduceat(image, cuts, axis=0) / np.maximum(1, np.diff(np.append(cuts, len(image))))[:, None]
    cells = rows.reshape(8, 8, 8).mean(axis=2)
    hash_ = int(np.packbits((cells > cells.mean()).ravel()).view(">u8")[0])
    return f"grey8 {WIDTH}x{len(image)} mean={image.mean():.3f} sd={image.std():.3f} hash={hash_:016x}"


READ = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, got = None, ()
    for b, rows in _inputs(batches):
        out = []
        for key in rows:
            if key != last:
                file, offset, length = last = key
                image = file.read(offset, length)
                payload = decode_png(image)
                got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload))
            out.append(got)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        values = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, k) for v, k in zip(values, kinds))], [*b.schema.names, *READ])


def read_back(index: DataFrame) -> DataFrame:
    """The index (of `write_shards`, or with the columns of `metadata`, whose order is kept) with payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256 and feature from the stored bytes."""
    known = "stored_name" in index.columns
    rows = index if known else _by_shard(index)
    return rows.mapInArrow(lean(_members), (META if known else INDEX) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
