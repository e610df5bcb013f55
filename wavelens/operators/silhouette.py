"""Adapted silhouette of the pieces that motifs hold (API3, JO4, JO14, AG17-AG20, WI6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_distances(pieces: DataFrame, values: Sequence[str] = ("y",), runs: Sequence[str] = ()) -> DataFrame:
    """Mean squares between pieces laid on each other from their first position:
    pieces has k, curve_id, pos and values. (runs, ka, a, kb, b, d), both ways."""
    a = pieces.select(*runs, F.col("k").alias("ka"), F.col("curve_id").alias("a"), "pos", *(F.col(v).alias(f"a_{v}") for v in values))
    b = pieces.select(*runs, F.col("k").alias("kb"), F.col("curve_id").alias("b"), "pos", *(F.col(v).alias(f"b_{v}") for v in values))
    half = a.join(b, [*runs, "pos"]).where("ka < kb or (ka = kb and a < b)")
    square = sum(((F.col(f"a_{v}") - F.col(f"b_{v}")) * (F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values), F.lit(0))
    half = half.groupBy(*runs, "ka", "a", "kb", "b").agg((F.sum(square) / F.count("*") / len(values)).alias("d"))
    return half.unionByName(half.select(*runs, F.col("kb").alias("ka"), F.col("b").alias("a"), F.col("ka").alias("kb"), F.col("a").alias("b"), "d"))


def mean_distances(pieces: DataFrame, values: Sequence[str] = ("y",), runs: Sequence[str] = ()) -> DataFrame:
    """(runs, ka, a, kb, mean): the means of `pair_distances` from each piece to
    the (other) pieces of each motif, without making pairs. Pieces of a motif that
    have the same positions are one class, with sums and sums of squares at each;
    a piece meets classes, whose number depends on the gaps, not on the pieces."""
    key = [*runs, "k", "curve_id"]
    held = pieces.select(*key, "pos", *(F.col(v).cast("double").alias(v) for v in values))
    shape = held.groupBy(*key).agg(F.sort_array(F.collect_list("pos")).alias("shape"))  # as long as the motif
    held = held.join(shape, key)
    moments = [*(F.sum(v).alias(f"s1_{v}") for v in values), *(F.sum(F.col(v) * F.col(v)).alias(f"s2_{v}") for v in values)]
    classes = held.groupBy(*runs, F.col("k").alias("kb"), F.col("shape").alias("other"), "pos").agg(F.count("*").alias("n"), *moments)
    square = sum((F.col("n") * F.col(v) * F.col(v) - 2 * F.col(v) * F.col(f"s1_{v}") + F.col(f"s2_{v}") for v in values), F.lit(0.0))
    met = held.join(classes, [*runs, "pos"])
    each = met.groupBy(*runs, F.col("k").alias("ka"), F.col("curve_id").alias("a"), "shape", "kb", "other")
    each = each.agg((F.greatest(F.lit(0.0), F.sum(square)) / F.count("*") / len(values)).alias("total"), F.max("n").alias("n"))
    itself = ((F.col("ka") == F.col("kb")) & (F.col("shape") == F.col("other"))).cast("long")
    out = each.withColumn("n", F.col("n") - itself).groupBy(*runs, "ka", "a", "kb")
    return out.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean")).where("mean is not null")


def silhouette(distances: DataFrame, members: DataFrame, runs: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """AG17, AG18, WI6: (runs, k, curve_id, sil, ord) from distances both ways
    and the members (runs, k, curve_id). a: mean to the own motif's other pieces;
    b: least mean to another motif's; a lone piece and a lone motif give 0. Means
    have as divisor the size of the motif that they are taken over."""
    return from_means(distances.groupBy(*runs, "ka", "a", "kb").agg(F.avg("d").alias("mean")), members, runs, compat)


def from_means(mean: DataFrame, members: DataFrame, runs: Sequence[str] = (), compat: bool = False) -> DataFrame:
    """The same from the means (runs, ka, a, kb, mean). compat (Q2): sums over
    another motif are divided by the size of the motif that follows the own one."""
    if compat:
        sizes = members.groupBy(*runs, "k").agg(F.count("*").alias("n"))
        count = F.max("k").over(Window.partitionBy(*runs))
        heads = sizes.select(*runs, F.col("k").alias("ka"), (F.col("k") % count + 1).alias("next"))
        after = heads.join(sizes.withColumnsRenamed({"k": "next", "n": "divisor"}), [*runs, "next"])
        mean = mean.join(after.drop("next"), [*runs, "ka"]).join(sizes.withColumnRenamed("k", "kb"), [*runs, "kb"])
        mean = mean.withColumn("mean", F.when(F.col("ka") == F.col("kb"), F.col("mean")).otherwise(F.col("mean") * F.col("n") / F.col("divisor")))
    both = mean.groupBy(*runs, F.col("ka").alias("k"), F.col("a").alias("curve_id")).agg(F.max(F.when(F.col("ka") == F.col("kb"), F.col("mean"))).alias("own"), F.min(F.when(F.col("ka") != F.col("kb"), F.col("mean"))).alias("other"))
    out = members.select(*runs, "k", "curve_id").join(both, [*runs, "k", "curve_id"], "left")
    top = F.when(F.col("own").isNotNull() & F.col("other").isNotNull(), F.greatest("own", "other"))
    out = out.withColumn("sil", F.coalesce(F.try_divide(F.col("other") - F.col("own"), top), F.lit(0.0)))
    ordered = F.row_number().over(Window.partitionBy(*runs, "k").orderBy(F.desc("sil"), "curve_id"))
    return out.select(*runs, "k", "curve_id", "sil", ordered.alias("ord"))


def average(sil: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """AG19, AG20: (runs, k, avg_sil, size)."""
    return sil.groupBy(*runs, "k").agg(F.avg("sil").alias("avg_sil"), F.count("*").alias("size"))


def run_summary(averages: DataFrame, runs: Sequence[str]) -> DataFrame:
    """AG19: mean and deviation over the motifs of a run."""
    return averages.groupBy(*runs).agg(F.avg("avg_sil").alias("mean_sil"), F.stddev_samp("avg_sil").alias("sd_sil"))
