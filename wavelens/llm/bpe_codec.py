"""BPE encoding and decoding of whole texts (see bpe.py for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, wordkit
from ._common import ship

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are encoded together; equal pieces among them are encoded once.
TOGETHER = 4 << 20
_TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _joined(values: pa.Array, bounds: np.ndarray, by) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), values), by)


def _codec(path: str, outputs: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        pieces = pa.array([codec.bytes_of.get(i, b"") for i in range(max(codec.bytes_of) + 1)], pa.large_binary())
        decimals = pa.array([str(i) for i in range(len(pieces))], pa.large_string())
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), TOGETHER):
                ids, count = codec.encode_batch(texts)
                bounds = np.concatenate([[0], np.cumsum(count)])
                out: dict[str, pa.Array] = {"n_tokens": pa.array(count, pa.int64())}
                if "ids" in outputs:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                at = pa.array(ids.astype(np.int64))
                if "ids_sha256" in outputs:
                    out["ids_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in _joined(decimals.take(at), bounds, pa.scalar(",", pa.large_string()))], pa.string())
                if {"decoded", "decoded_sha256"} & set(outputs):
                    # The bytes of all ids in turn; UTF-8 is repaired as the library does.
                    texts_again = [x.as_py().decode("utf-8", "replace") for x in _joined(pieces.take(at), bounds, pa.scalar(b"", pa.large_binary()))]
                    out["decoded"] = pa.array(texts_again, pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts_again], pa.string())
                yield pa.record_batch([part.column("doc_id"), *(out[c] for c in outputs)], names=["doc_id", *outputs])

    return run


def encode_decode(spark: SparkSession, docs: DataFrame, path: str = TOKENIZER, outputs: Sequence[str] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen outputs (ids, n_tokens, decoded, and digests of
    both) of each whole text: encoded without added special tokens, then decoded
    with special tokens kept. Marks of special tokens inside a text become their
    ids, as the library's default has it.

    Null counts as empty (no ids, an empty decoded text). Rows are independent,
    so repeated rows give repeated results and an empty table an empty result;
    other columns are not read. path: a plain byte-level BPE file (others raise
    ValueError) of public_tokenizers, or one that every machine has. Nothing is
    shuffled."""
    bpe.codec(path)
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_codec(path, list(outputs)), "doc_id long, " + ", ".join(f"{c} {_TYPES[c]}" for c in outputs))


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(path)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return run


def decode(spark: SparkSession, encoded: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that its ids decode to (null and empty ids: empty). An
    id that the file doesn't have raises KeyError. Rows are independent, an empty
    table gives an empty result, other columns are not read."""
    ship(spark)
    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(_decoder(path), "doc_id long, decoded string")
