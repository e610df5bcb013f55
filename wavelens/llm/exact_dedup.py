"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. Blocks are sorted into
integer names: a 64-bit hash and the rank of the content among the sorted
distinct contents of that hash, so equal names mean equal blocks and the name
doesn't depend on partitioning. The least and the largest content of each hash
tell the hashes that have several; all other contents are the first of theirs. Adjacent names are paired and named again the
same way until each document has one name; with the number of blocks it is the
document's identity, free of collisions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordkit
from ._common import Scratch, growing, join_unique, prefix, row_hash

#: Bytes of a block, and contents of clashing hashes that are broadcast at most.
BLOCK, CLASHES = 4096, 1000


def _blocks(block: int):
    """Batches of (doc_id, text) to one row per block; what holds for the
    document stands in the row of its first block."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_cp", pa.int64()), ("text_sha256", pa.string()), ("n_blocks", pa.int64()), ("pos", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in wordkit.slices(batch, wordkit.as_texts(batch.column("text")), 8 << 20):
                data, at = wordkit.raw(texts)
                keep = ~wordkit._SPACE[data]
                bounds = np.concatenate([[0], np.cumsum(keep)])[at]
                # A code point has one byte that doesn't continue another.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
                norm = data[keep].tobytes()
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, n_cp, a, b in zip(part.column("doc_id").to_pylist(), np.diff(points).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = max(1, -(-(b - a) // block))
                    for pos in range(n):
                        first = not pos
                        row = (doc, n_cp if first else None, hashlib.sha256(norm[a:b]).hexdigest() if first else None, n, pos, norm[a + pos * block : min(b, a + (pos + 1) * block)])
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def name_keys(scratch: Scratch, df: DataFrame, keys: list[str], hashed=F.xxhash64) -> DataFrame:
    """df with (h, r) instead of `keys`: an integer name that two rows share if
    and only if their keys are equal. Whatever a key's share of the rows, it is
    one entry of a partial aggregate. The contents of hashes that have several
    (about n^2 / 2^65 of n) are joined back, by broadcast up to CLASHES of them."""
    df = df.withColumn("h", hashed(*keys))
    content = F.struct(*keys)
    clash = scratch.write(df.groupBy("h").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").select("h"), "clash")
    if not clash.head(1):
        return df.withColumn("r", F.lit(1)).drop(*keys)
    rank = F.row_number().over(Window.partitionBy("h").orderBy(*keys))
    names = scratch.write(df.join(growing(clash), "h", "left_semi").select("h", *keys).distinct().withColumn("r", rank), "names")
    names = F.broadcast(names) if names.limit(CLASHES + 1).count() <= CLASHES else growing(names)
    return df.join(names, ["h", *keys], "left").withColumn("r", F.coalesce("r", F.lit(1))).drop(*keys)


def identities(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, Scratch]:
    """One row per input row: row (a number of its own), doc_id, n_cp (code
    points), text_sha256 (of the normalised text), and the identity (n_blocks, h, r)."""
    scratch = Scratch(spark, "exact")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = src.mapInArrow(_blocks(block), "doc_id long, n_cp long, text_sha256 string, n_blocks long, pos long, block binary")
    # Rows of a document are neighbours of one task: the number of its first row, less the position, is its own.
    blocks = blocks.withColumn("row", F.monotonically_increasing_id() - F.col("pos"))
    level = scratch.write(name_keys(scratch, blocks, ["block"]), "level0")
    about = level.where("pos = 0").select("row", "doc_id", "n_cp", "text_sha256", "n_blocks")
    found = [level.where("n_blocks = 1").select("row", "h", "r")]
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    names, size = level.where("n_blocks > 1").select("row", "pos", "n_blocks", F.col("n_blocks").alias("left"), "h", "r"), most
    while size > 1:
        even = F.col("pos") % 2 == 0
        pairs = names.groupBy("row", F.floor(F.col("pos") / 2).cast("long").alias("pos"), "n_blocks", F.floor((F.col("left") + 1) / 2).cast("long").alias("left")).agg(
            *(F.max(F.when(even, F.col(c))).alias(f"{c}a") for c in "hr"), *(F.coalesce(F.max(F.when(~even, F.col(c))), F.lit(-1)).alias(f"{c}b") for c in "hr")
        )
        names = scratch.write(name_keys(scratch, pairs, ["ha", "ra", "hb", "rb"]), "level")
        found.append(names.where("`left` = 1").select("row", "h", "r"))
        names, size = names.where("`left` > 1"), (size + 1) // 2
    named = found[0]
    for x in found[1:]:
        named = named.unionByName(x)
    return about.join(named, "row"), scratch


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (`[\\x20\\x09-\\x0D]`). Of
    equal texts the row with the most code points stays, then the smallest
    doc_id (null last), then one of the repeated rows. Null and empty texts, and
    those of white space only, are equal to each other. An empty table gives an
    empty result. Other columns are not read."""
    rows, scratch = identities(spark, docs, id_col, text_col, block)
    rows = scratch.write(rows, "rows")
    key = ["n_blocks", "h", "r"]
    best = F.min(F.struct((-F.col("n_cp")).alias("minus"), F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    classes = scratch.write(rows.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")), "classes")
    classes = classes.select(*key, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.col("group_size").alias("weight"))
    out = join_unique(rows, classes, key, "weight", rows.count())
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row")


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of docs. Rows are matched by
    doc_id and, where that is repeated or null, by their text: of rows with equal
    id and text one stays, the first by a hash of all its columns. Null and empty
    texts are equal; an empty table stays empty; clashing names of other columns
    are kept apart."""
    p = prefix(docs)
    own = [f"{p}{c}" for c in ("id", "sha", "kept", "n", "texts", "any", "copies", "own", "pick")]
    i, sha, kept, n, texts, some, copies, norm, pick = own
    scratch = Scratch(spark, "kept")
    found = exact_dedup(spark, docs, id_col, text_col).groupBy(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias(kept), F.count("*").alias(n))
    found = scratch.write(found, "found")
    single = scratch.write(found.groupBy(i).agg(F.count("*").alias(texts), F.max(kept).alias(some), F.max(n).alias(copies)), "ids")
    once, same = (F.col(texts) == 1) & (F.col(copies) == 1), F.col(id_col).cast("long").eqNullSafe(F.col(i))
    plain = docs.join(growing(single.where(once & F.col(some))), same, "left_semi")
    if not single.where(~once).head(1):
        return plain
    # Repeated ids are rare: those rows are settled one by one.
    again = docs.join(single.where(~once & F.col(some)), same, "left_semi")
    again = again.withColumn(norm, F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", ""), 256))
    again = again.join(found.where(F.col(kept)), same & (F.col(norm) == F.col(sha)), "left_semi")
    again = again.withColumn(pick, F.row_number().over(Window.partitionBy(id_col, norm).orderBy(F.length(text_col).desc_nulls_last(), row_hash(docs)))).where(F.col(pick) == 1)
    return plain.unionByName(again.select(*docs.columns))
