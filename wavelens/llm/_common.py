"""What every operator of this subpackage shares: the scratch tables that cut
lineage, the package's way to the executors and the join for skewed keys."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

#: `[\x20\x09-\x0D]`: the white space of all operators here (fixed values).
SPACE = " \t\n\x0b\x0c\r"
#: A key holding at least this share of the rows counts as hot; at most 1 / share such keys exist.
HOT_SHARE = 1 / 200
#: Bits of a filter of ids (at most 32 MB; a fuller one only lets more through).
FILTER_BITS = 28


class Scratch:
    """Written tables in the shared folder. `write` materialises a frame there
    and returns the frame that reads it back: lineage ends at the file, so lost
    executors cost no recomputation and nondeterministic inputs (sampled range
    bounds, ids by partition) are fixed once."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/wavelens-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: list[str] = []

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def write_bucketed(self, df: DataFrame, key: str, buckets: int, name: str = "t") -> DataFrame:
        """As `write`, in files by bucket of the key: a join by the key leaves
        this side where it is."""
        path, table = f"{self.root}/{len(self.paths)}-{name}", f"wavelens_{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out._scratch_path, out._scratch_table = path, table
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        if hasattr(df, "_scratch_table"):
            self.spark.sql(f"DROP TABLE {df._scratch_table}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of steps whose frames are gone."""
        gc.collect()
        self.spark._jvm.System.gc()


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner equi-join of `left` with `right`, whose keys are unique and whose
    `weight` is the number of left rows of the key (`total` in all).

    Keys with HOT_SHARE of the rows or more are at most 1 / HOT_SHARE, whatever
    the input's size, so they are broadcast and their rows stay where they are;
    the others are joined by shuffle, where no key is large."""
    least = max(2.0, total * HOT_SHARE)
    hot, cold = right.where(F.col(weight) >= least).drop(weight), right.where(F.col(weight) < least).drop(weight)
    return left.join(F.broadcast(hot), keys, "inner").unionByName(left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner"))


def id_filter(spark: SparkSession, ids: DataFrame) -> tuple[Column, object, int]:
    """For a scan that is to let through the rows of some doc_ids and few others:
    the place of a row's doc_id in a bitmap, the bitmap as a broadcast of bounded
    size, and its number of bits. ids: (doc_id), not null."""
    bits = max(20, min(FILTER_BITS, int(np.ceil(np.log2(8 * max(1, ids.count()))))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    number = ids.select((place + 1).alias("v"))
    maps = number.groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect()
    held = np.zeros((1 << bits) // 8, np.uint8)
    for x in maps:
        held[(x.b - 1) * 4096 : x.b * 4096] = np.frombuffer(x.m, np.uint8)
    return place, spark.sparkContext.broadcast(held.tobytes()), bits


def in_filter(bitmap, place: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(bitmap.value, np.uint8)
    return (bits[place >> 3] >> (place & 7)) & 1 == 1


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: joined by shuffle at every
    size, never broadcast because it happens to be small."""
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """Rows by their column `bucket`: buckets go to partitions in turn, so that
    each has as many of them as the others, and lie in the order of bucket, order."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", *order)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prefix(df: DataFrame) -> str:
    """What no column name of the frame starts with: own columns beside the
    frame's are named so."""
    have, p = [c.lower() for c in df.columns], "_wl_"
    while any(c.startswith(p) for c in have):
        p = "_" + p
    return p


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns: an order for rows that are alike in all else."""
    return F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
