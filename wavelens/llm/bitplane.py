"""Token files of bit-plane shuffled id blocks.

A segment holds the ids of whole documents in a row. Its ids are cut into
fixed-size blocks; each block is transposed into byte planes (or bit planes),
each plane is compressed with zstandard, and a chunk index at the head says
where every plane lies. Segments are rows of a Parquet table in document order,
so that Spark's committer makes the write atomic and any store can hold it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, wordkit
from ._common import Scratch, partitions, ship
from .bpe_codec import TOKENIZER

#: Ids of a block, ids after which a segment ends (with its document), id after each document.
CHUNK, SEGMENT, END_ID = 1 << 16, 1 << 21, 0
MAGIC = b"WLBP"
_HEAD = struct.Struct("<4sBBHIQQ")  # magic, version, planes are bits, -, ids of a block, documents, ids


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    every = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(every[:, k], bitorder="little").tobytes() for k in range(32)]


def _unplaned(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view("<u4")
    every = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(every, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_segment(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK, bits: bool = False, level: int = 3) -> bytes:
    """One segment file: head, documents, chunk index, planes."""
    squeeze, body, index, at = zstandard.ZstdCompressor(level), [], [], 0
    for i in range(0, len(ids), chunk):
        for plane in _planes(ids[i : i + chunk], bits):
            p = squeeze.compress(plane)
            index.append((at, len(p)))
            body.append(p)
            at += len(p)
    docs = squeeze.compress(b"".join(np.ascontiguousarray(x, kind).tobytes() for x, kind in ((doc_ids, "<i8"), (known, "u1"), (sizes, "<u8"))))
    table = np.array(index, "<u8").reshape(-1, 2).tobytes()
    return b"".join([_HEAD.pack(MAGIC, 1, bits, 0, chunk, len(doc_ids), len(ids)), struct.pack("<QQ", len(docs), len(table)), docs, table, *body])


class Segment:
    """A segment file; blocks are read one by one through the chunk index."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, self.chunk, n, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of token ids")
        a, b = struct.unpack_from("<QQ", data, _HEAD.size)
        at = _HEAD.size + 16
        self._loosen = zstandard.ZstdDecompressor()
        docs = self._loosen.decompress(data[at : at + a])
        self.doc_ids, self.known, self.sizes = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "u1", n, 8 * n), np.frombuffer(docs, "<u8", n, 9 * n).astype(np.int64)
        self.index = np.frombuffer(data, "<u8", b // 8, at + a).reshape(-1, 2)
        self._data, self._at = data, at + a + b

    def block(self, k: int) -> np.ndarray:
        planes = 32 if self.bits else 4
        n = min(self.chunk, self.n_ids - k * self.chunk)
        found = [self._loosen.decompress(self._data[self._at + int(o) : self._at + int(o + s)]) for o, s in self.index[k * planes : (k + 1) * planes]]
        return _unplaned(found, n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop of the segment; reads only the blocks they lie in."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // self.chunk
        blocks = [self.block(k) for k in range(first, (stop - 1) // self.chunk + 1)]
        return np.concatenate(blocks)[start - first * self.chunk : stop - first * self.chunk]


def _segments(path: str, end_id: int, chunk: int, segment: int, bits: bool):
    schema = pa.schema([(c, pa.int64()) for c in ("seg", "before", "n_docs", "n_ids")] + [("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seg, before = bpe.codec(path), 0, 0
        held: list[tuple] = []

        def flush():
            nonlocal seg, before
            ids, docs, known, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            data = write_segment(ids, docs, known, sizes, chunk, bits)
            seg, before = seg + 1, before + len(ids)
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((seg - 1, before - len(ids), len(docs), len(ids), data), schema, strict=True)], schema=schema)

        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), 12 << 20):
                ids, count = codec.encode_batch(texts)
                ends = np.cumsum(count)
                out = np.insert(ids, ends, end_id)  # after each document
                sizes, own = count + 1, part.column("doc_id")
                docs, known = own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False)
                bounds, i = np.concatenate([[0], np.cumsum(sizes)]), 0
                while i < len(sizes):
                    room = segment - sum(len(h[0]) for h in held)
                    j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + room, "right")) - 1)
                    held.append((out[bounds[i] : bounds[j]], docs[i:j], known[i:j], sizes[i:j]))
                    if j < len(sizes) or sum(len(h[0]) for h in held) >= segment:
                        yield flush()
                    i = j
        if held:
            yield flush()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID, chunk: int = CHUNK, segment: int = SEGMENT, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the ids in ascending
    doc_id order (null first; equal doc_ids, which may be many, by a hash of their
    text, then by text) to `folder`: rows part, seg, before (ids before the segment
    in its part), n_docs, n_ids, data. Texts, not ids, are range-partitioned: they
    are smaller."""
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h = F.xxhash64("text")
    ordered = src.repartitionByRange(partitions(spark), "doc_id", h).sortWithinPartitions("doc_id", h, "text")
    segments = ordered.mapInArrow(_segments(path, end_id, chunk, segment, bits), "seg long, before long, n_docs long, n_ids long, data binary")
    segments.withColumn("part", F.spark_partition_id().cast("long")).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            s, start = Segment(batch.column("data")[row].as_py()), batch.column("start")[row].as_py()
            ends = np.cumsum(s.sizes)
            crc, doc, blocks = np.zeros(len(ends), np.int64), 0, -(-s.n_ids // s.chunk)
            run, at = 0, 0
            for k in range(blocks):  # each block once, in turn
                ids = np.ascontiguousarray(s.block(k), "<u4")
                stop = at + len(ids)
                while doc < len(ends):
                    low, high = max(at, ends[doc] - s.sizes[doc]), min(stop, ends[doc])
                    run = zlib.crc32(ids[low - at : high - at], run)
                    if ends[doc] > stop:
                        break
                    crc[doc], run, doc = run, 0, doc + 1
                at = stop
            yield pa.record_batch([pa.array(s.doc_ids, pa.int64(), mask=s.known == 0), pa.array(start + ends - s.sizes, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    ship(spark)
    segments = spark.read.schema("seg long, before long, n_docs long, n_ids long, data binary, part long").parquet(folder)
    # Totals of the parts, as many as partitions were written.
    totals = sorted((x.part, x.n) for x in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    bases = spark.createDataFrame(rows, "part long, base long")
    return segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files (to the shared folder unless one is named) and read them
    back. Null texts count as empty and have the end id alone; repeated rows are
    written as often; an empty table gives no segment and an empty result."""
    folder = folder or f"{Scratch(spark, 'tokens').root}/files"
    write_token_files(spark, docs, folder, **options)
    return read_token_files(spark, folder)
