"""Token counts by distinct pre-tokens.

Blocks of documents are written once: their distinct pre-tokens, dealt to
buckets by hash, and for each document the frequency of each. A bucket takes
the pre-tokens of all blocks, counts the pieces of each distinct one once, and
gives every block its counts back; there the product with the documents'
frequencies gives the sums. No ids are kept, and a frequent pre-token travels
once for a block, not once for a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, wordkit
from ._common import Scratch, dealt, partitions
from .blobs import pack, unpack
from .bpe_codec import TOKENIZER

#: Bytes of text in a block and for each bucket (whose distinct pre-tokens are held together), and the
#: limit of the over_limit column.
TOGETHER, BUCKET, LIMIT = 16 << 20, 256 << 20, 512


def _dealt(pieces: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each piece, by its bytes."""
    w = wordkit.raw(pieces)
    one = wordkit.Words(w[0], w[1][:-1], w[1][1:], np.zeros(0, np.int64), np.zeros(0, np.int64))
    return (wordkit.hashes(one) % np.uint64(buckets)).astype(np.int64)


def _frequencies(path: str, buckets: int):
    schema = pa.schema([("tables", pa.binary()), ("pieces", pa.list_(pa.struct([("bucket", pa.int32()), ("blob", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
                distinct, place, count, _ = codec.pieces(texts)
                bucket = _dealt(distinct, buckets)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                # (document, pre-token) pairs and how often each occurs
                width = max(1, len(distinct))
                pairs, times = np.unique(np.repeat(np.arange(len(texts)), count) * width + rank[place], return_counts=True)
                doc, piece = np.divmod(pairs, width)
                step = np.diff(piece, prepend=0).astype(np.int32)
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                tables = pack([ids.fill_null(0).to_numpy(), known, np.diff(wordkit.raw(texts)[1]), np.bincount(doc, minlength=len(texts)).astype(np.int32), step, times.astype(np.int32)])
                ends, sorted_pieces, blobs = np.cumsum(np.bincount(bucket, minlength=buckets)), distinct.take(pa.array(order)), []
                for b in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
                    own = sorted_pieces.slice(ends[b - 1] if b else 0, ends[b] - (ends[b - 1] if b else 0))
                    data, at = wordkit.raw(own)
                    blobs.append({"bucket": b, "blob": pack([data, np.diff(at).astype(np.int32)])})
                yield pa.record_batch([pa.array([tables], pa.binary()), pa.array([blobs], schema.field("pieces").type)], schema=schema)

    return run


def _counted(path: str):
    """All blobs of some buckets: each distinct pre-token is counted once, each
    blob gets its counts."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())])

    def bucket(codec: bpe.Codec, rows: list[tuple]) -> pa.RecordBatch:
        lists = []
        for _, _, blob in rows:
            data, sizes = unpack(blob)
            at = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            lists.append(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at), pa.py_buffer(data)))
        coded = pa.concat_arrays(lists).dictionary_encode()
        _, sizes = codec.encode_pieces(coded.dictionary)
        counts, ends = sizes[coded.indices.to_numpy()].astype(np.int32), np.cumsum([len(x) for x in lists])
        return pa.record_batch([[b for b, _, _ in rows], [b for _, b, _ in rows], [pack([c]) for c in np.split(counts, ends[:-1])]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held = bpe.codec(path), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "blob")), strict=True):
                if held and held[-1][1] != row[1]:  # sorted by bucket
                    yield bucket(codec, held)
                    held = []
                held.append(row)
        if held:
            yield bucket(codec, held)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            ids, known, n_bytes, entries, step, times = unpack(batch.column("tables")[row].as_py())
            parts = sorted((batch.column("counts")[row].as_py() or []), key=lambda x: x["bucket"])
            sizes = np.concatenate([np.zeros(0, np.int32), *(unpack(x["counts"])[0] for x in parts)]).astype(np.int64)
            worth = sizes[np.cumsum(step.astype(np.int64))] * times if len(step) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(worth)])[np.concatenate([[0], np.cumsum(entries.astype(np.int64))])]
            yield pa.record_batch([pa.array(ids, pa.int64(), mask=known == 0), pa.array(n_bytes, pa.int64()), pa.array(np.diff(ends), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(spark: SparkSession, docs: DataFrame, path: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of
    each whole text, as the tokenizers library counts it without added special
    tokens; marks of special tokens inside a text count one, as by its default.

    Null counts as empty (0 bytes, 0 tokens). Repeated rows give repeated
    results, an empty table an empty result; other columns are not read."""
    scratch = Scratch(spark, "counts")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-size // BUCKET))
    blocks = src.mapInArrow(_frequencies(path, buckets), "tables binary, pieces array<struct<bucket:int,blob:binary>>")
    blocks = scratch.write(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    uses = blocks.select("block", F.explode("pieces").alias("p")).select("block", "p.bucket", "p.blob")
    counted = dealt(uses).mapInArrow(_counted(path), "block long, bucket int, counts binary")
    # A block has at most one row for each bucket.
    counts = counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("counts"))
    summed = blocks.select("block", "tables").join(counts, "block", "left").mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
