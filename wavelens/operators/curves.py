"""Curve algebra: missing values, intervals, scaling (PR1-PR9, WI1, AG14-AG15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repair(points: DataFrame, values: Sequence[str]) -> DataFrame:
    """PR1, PR2: a point that is missing in one column is missing in all."""
    known = None
    for v in values:
        ok = F.col(v).isNotNull()
        known = ok if known is None else known & ok
    return points.withColumns({v: F.when(known, F.col(v)) for v in values})


def domain(points: DataFrame, values: Sequence[str]) -> DataFrame:
    """PR5, PR6: the points that are not missing."""
    for v in values:
        points = points.where(F.col(v).isNotNull())
    return points


def intervals(points: DataFrame, values: Sequence[str] = ("y",)) -> DataFrame:
    """WI1: (curve_id, start, end, length) of each run of present points."""
    w = Window.partitionBy("curve_id").orderBy("x")
    island = domain(points, values).withColumn("island", F.col("x") - F.row_number().over(w))
    out = island.groupBy("curve_id", "island").agg(F.min("x").alias("start"), F.max("x").alias("end"))
    return out.select("curve_id", "start", "end", (F.col("end") - F.col("start") + 1).cast("int").alias("length"))


def feasible(ints: DataFrame, c: int) -> DataFrame:
    """FI11: intervals in which a motif of c points has room."""
    return ints.where(F.col("length") >= c)


def shortest_longest(ints: DataFrame) -> DataFrame:
    """AG15: the least, over curves, of the longest interval."""
    return ints.groupBy("curve_id").agg(F.max("length").alias("longest")).agg(F.min("longest").alias("c_most"))


def standardize(points: DataFrame, levels: Sequence[str], derivatives: Sequence[str] = ()) -> DataFrame:
    """PR3: 100 (y - mean) / sd, pooled over all points of all curves;
    derivatives are divided by the sd of their level only. One row of totals is
    broadcast."""
    stats = points.agg(*(f(v).alias(f"_{n}_{v}") for v in levels for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    out = points.crossJoin(F.broadcast(stats))
    out = out.withColumns({v: (F.col(v) - F.col(f"_mean_{v}")) / F.col(f"_sd_{v}") * 100 for v in levels} | {d: F.col(d) / F.col(f"_sd_{v}") * 100 for v, d in zip(levels, derivatives, strict=False)})
    return out.drop(*stats.columns)


def derivative(points: DataFrame, value: str = "y", out: str = "dy") -> DataFrame:
    """Central differences, one-sided at the ends of an interval, null for a
    lone point (a fixture: callers bring derivatives of their own)."""
    w = Window.partitionBy("curve_id").orderBy("x")
    near = lambda c, f, x: F.when(f("x").over(w) == F.col("x") + x, f(c).over(w))
    a, b, y = near(value, F.lag, -1), near(value, F.lead, 1), F.col(value)
    d = F.when(a.isNotNull() & b.isNotNull(), (b - a) / 2.0).when(b.isNotNull(), (b - y).cast("double")).when(a.isNotNull(), (y - a).cast("double"))
    return points.withColumn(out, d)


def rescale(points: DataFrame, values: Sequence[str], by: float) -> DataFrame:
    """PR9."""
    return points.withColumns({v: F.col(v) * by for v in values})
