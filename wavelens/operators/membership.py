"""Memberships, convergence and cleaning (AG8-AG13, FI6-FI7, FI17, SF9-SF11, WI9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuzzy(distances: DataFrame, m: float = 2.0, runs: Sequence[str] = ()) -> DataFrame:
    """AG9, WI9, FI17, SF11: p of every (runs, curve_id, k, d). A curve at no
    distance from a motif belongs to that one alone (to the smallest k of
    several); a null distance gives p 0."""
    row = Window.partitionBy(*runs, "curve_id")
    zero = F.min(F.when(F.col("d") == 0, F.col("k"))).over(row)
    power = F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-1.0 / (m - 1))))
    p = F.when(zero.isNotNull(), (F.col("k") == zero).cast("double")).otherwise(F.coalesce(F.col("_w") / F.sum("_w").over(row), F.lit(0.0)))
    return distances.withColumn("_w", power).withColumn("p", p).drop("_w")


def rescued(membership: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """AG10: a motif without any member gets the nearest curve with p = 1."""
    empty = membership.groupBy(*runs, "k").agg(F.sum("p").alias("all_p"), F.min(F.struct("d", "curve_id")).alias("near")).where("all_p = 0").select(*runs, "k", F.col("near.curve_id").alias("_one"))
    out = membership.join(empty, [*runs, "k"], "left")
    return out.withColumn("p", F.when(F.col("_one") == F.col("curve_id"), F.lit(1.0)).otherwise(F.col("p"))).drop("_one")


def total_objective(membership: DataFrame, m: float = 2.0, runs: Sequence[str] = ()) -> DataFrame:
    """AG8: sum of d p^m."""
    return membership.groupBy(*runs).agg(F.sum(F.col("d") * F.pow("p", F.lit(float(m)))).alias("j"))


def bhattacharyya(old: DataFrame, new: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """AG11: (runs, curve_id, bc) between old and new memberships (infinite if disjoint)."""
    both = old.select(*runs, "curve_id", "k", F.col("p").alias("_old")).join(new, [*runs, "curve_id", "k"])
    overlap = F.sum(F.sqrt(F.col("_old") * F.col("p")))
    both = both.groupBy(*runs, "curve_id").agg(overlap.alias("_o"))
    return both.select(*runs, "curve_id", F.when(F.col("_o") == 0, F.lit(float("inf"))).otherwise(-F.ln("_o")).alias("bc"))


def convergence(bc: DataFrame, how: str = "max", quantile: float = 0.5, runs: Sequence[str] = ()) -> DataFrame:
    """AG12: the statistic that is held against the tolerance."""
    stat = {"max": F.max("bc"), "mean": F.avg("bc"), "quantile": F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY bc)")}[how]
    return bc.groupBy(*runs).agg(stat.alias("bc_dist"))


def cleaned(membership: DataFrame, quantile: float, runs: Sequence[str] = ()) -> DataFrame:
    """FI6, FI7, AG13: p_clean is 1 where d is below the pooled quantile (linear
    interpolation, strict), and for the nearest curve of a motif that would have
    none."""
    cut = membership.groupBy(*runs).agg(F.percentile("d", F.lit(quantile)).alias("_cut"))
    out = membership.join(cut, list(runs)) if runs else membership.crossJoin(cut)
    out = out.withColumn("p_clean", F.coalesce((F.col("d") < F.col("_cut")).cast("int"), F.lit(0)))
    near = out.groupBy(*runs, "k").agg(F.max("p_clean").alias("_any"), F.min(F.when(F.col("d").isNotNull(), F.struct("d", "curve_id"))).alias("_near"))
    near = near.where("_any = 0").select(*runs, "k", F.col("_near.curve_id").alias("_one"))
    out = out.join(near, [*runs, "k"], "left")
    return out.withColumn("p_clean", F.when(F.col("_one") == F.col("curve_id"), 1).otherwise(F.col("p_clean"))).drop("_cut", "_one")


def hash_uniform(*columns: Column | str, seed: int = 1) -> Column:
    """A number in [0, 1) by arithmetic on integers, the same in any engine."""
    primes = (7919, 104729, 15485863)
    total = F.lit(seed * 1299709)
    for c, p in zip(columns, primes, strict=False):
        total = total + (F.col(c) if isinstance(c, str) else c) * p
    return F.pmod(total, F.lit(1000003)) / F.lit(1000003.0)


def initial_membership(curves: DataFrame, K: int, seed: int = 1, runs: Sequence[str] = ()) -> DataFrame:
    """SF9, SO6: memberships uniform on the simplex: the gaps between K - 1
    sorted hash-uniform numbers."""
    cuts = [hash_uniform("curve_id", F.lit(k), seed=seed) for k in range(1, K)]
    ends = F.concat(F.array(F.lit(0.0)), F.array_sort(F.array(*cuts)) if cuts else F.array().cast("array<double>"), F.array(F.lit(1.0)))
    out = curves.select(*runs, "curve_id", ends.alias("e")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(K))))
    return out.select(*runs, "curve_id", "k", (F.element_at("e", F.col("k") + 1) - F.element_at("e", F.col("k"))).alias("p"))


def initial_shift(ints: DataFrame, c: Sequence[int], seed: int = 1) -> DataFrame:
    """SF10: for each curve and motif one of the places where c_k present points
    follow each other: the one of the least hash."""
    per = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(c))).alias("k"), F.array(*map(F.lit, c)).alias("c"))).alias("kc")
    room = ints.select("curve_id", "start", "end", per).select("curve_id", "start", "end", "kc.*").where(F.col("end") - F.col("start") + 1 >= F.col("c"))
    room = room.withColumn("s", F.explode(F.sequence(F.col("start"), (F.col("end") - F.col("c") + 1).cast("int"))))
    return room.groupBy("curve_id", "k").agg(F.min(F.struct(hash_uniform("curve_id", "k", "s", seed=seed).alias("h"), "s")).alias("b")).select("curve_id", "k", F.col("b.s").cast("int").alias("s"))
