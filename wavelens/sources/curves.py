"""Curve sets: reading, making them from wide or packed forms, and writing.

Canonical form: one row per grid point, curve_id, x (from 1) and value columns;
a missing point is a row with nulls or no row. `len` of a curve is kept apart, so
that missing points at the end count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def from_wide(df: DataFrame, x: str, columns: Sequence[str], id_name: str = "curve_id", value: str = "y") -> DataFrame:
    """SC3: each named column is a curve over the column x."""
    return df.unpivot([x], list(columns), id_name, value).withColumnRenamed(x, "x")


def to_wide(points: DataFrame, ids: Sequence, value: str = "y") -> DataFrame:
    """SC4: one column for each of the named curves."""
    return points.where(F.col("curve_id").isin(list(ids))).groupBy("x").pivot("curve_id", list(ids)).agg(F.first(value))


def from_arrays(df: DataFrame, id_col: str, array_col: str, value: str = "y") -> DataFrame:
    """SC1: an array of values per curve; x is the place in it, from 1."""
    return df.select(F.col(id_col).alias("curve_id"), F.posexplode(array_col).alias("x", value)).withColumn("x", F.col("x") + 1)


def packed(points: DataFrame, lengths: DataFrame, values: Sequence[str] = ("y",)) -> DataFrame:
    """SC1: one row per curve with an array per value column, null where missing."""
    held = points.groupBy("curve_id").agg(*(F.map_from_entries(F.collect_list(F.struct("x", v))).alias(v) for v in values))

    def filled(v: str):
        return F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.try_element_at(F.col(v), i)).alias(v)

    return lengths.join(held, "curve_id", "left").select("curve_id", "len", *map(filled, values))


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("curve_id").agg(F.max("x").cast("int").alias("len"))


# -- curve sets of the driver's tables ------------------------------------
def ev_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' daily sums of event values in cents."""
    cents = F.round(F.col("value") * 100).cast("long")
    x = (F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("curve_id"), x.alias("x")).agg(F.sum(cents).alias("y"))


def li_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' monthly quantities and numbers of lines."""
    x = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("curve_id"), x.alias("x")).agg(F.sum(F.col("l_quantity").cast("long")).alias("y"), F.count("*").alias("n"))


def ord_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' monthly order totals in cents."""
    x = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).cast("int")
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_nationkey").cast("long").alias("curve_id"), x.alias("x")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("y"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as curves over their coordinates."""
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# -- runs on disk ----------------------------------------------------------
def write_run(df: DataFrame, path: str) -> None:
    """SC5: write results of runs; clusters (K), c and init are directories. A
    run's directory is replaced as a whole, so writing a run again is safe."""
    df.write.partitionBy("clusters", "c", "init").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_runs(spark: SparkSession, path: str, K: Sequence[int] | None = None, c: Sequence[int] | None = None) -> DataFrame:
    """SC7: results of the chosen K and c; other directories are not opened."""
    df = spark.read.parquet(path)
    df = df.where(F.col("clusters").isin(list(K))) if K else df
    return df.where(F.col("c").isin(list(c))) if c else df


def run_grid(spark: SparkSession, K: Sequence[int], c: Sequence[int], n_init: int) -> DataFrame:
    """JO5: all runs, numbered in the order of K, c, init from 1."""
    rows = [(k, m, i) for k in K for m in c for i in range(1, n_init + 1)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, 1)], "run_id long, clusters int, c int, init int")


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """SC6, JO13: runs without a result."""
    return grid.join(done.select("clusters", "c", "init").distinct(), ["clusters", "c", "init"], "left_anti").select(*grid.columns)
