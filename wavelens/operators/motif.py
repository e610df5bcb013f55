"""Motif centers (AG5-AG7, FI8-FI10, IT4b, JO7, JO8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import _square


def member_points(points: DataFrame, membership: DataFrame, motifs: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """JO7, FI10: the points of members (p > 0) under each motif, with pos, p and
    the member's overlap."""
    held = points.join(membership.where("p > 0").select("curve_id", *keys, "s", "p"), "curve_id").join(motifs.select(*keys, "length"), list(keys))
    held = held.withColumn("pos", F.col("x") - F.col("s") + 1).where((F.col("pos") >= 1) & (F.col("pos") <= F.col("length")))
    return held.withColumn("overlap", F.count("*").over(Window.partitionBy("curve_id", *keys)))


def centroid(points: DataFrame, membership: DataFrame, motifs: DataFrame, m: float = 2.0, values: Sequence[str] = ("y",), keys: Sequence[str] = ("k",), compat: bool = False) -> DataFrame:
    """AG5: (keys, pos, values) of the weighted centers; a member weighs p^m by
    its overlap. Positions that no member covers are absent; compat (Q4): where a
    motif has one member only, they are 0."""
    held = member_points(points, membership, motifs, keys).withColumn("c", F.pow("p", F.lit(float(m))) / F.col("overlap"))
    out = held.groupBy(*keys, F.col("pos").cast("int").alias("pos")).agg(*((F.sum(F.col("c") * F.col(v)) / F.sum("c")).alias(v) for v in values))
    if not compat:
        return out
    alone = membership.where("p > 0").groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1")
    empty = motifs.join(alone, list(keys)).select(*keys, F.explode(F.sequence(F.lit(1), F.col("length"))).alias("pos"))
    empty = empty.join(out, [*keys, "pos"], "left_anti")
    return out.unionByName(empty.select(*keys, "pos", *(F.lit(0.0).alias(v) for v in values)))


def trimmed(center: DataFrame, keys: Sequence[str] = ("k",)) -> tuple[DataFrame, DataFrame]:
    """AG6: the center from its first to its last position, counted from 1, and
    the header (keys, length, trim_left); shifts move by trim_left."""
    header = center.groupBy(*keys).agg((F.max("pos") - F.min("pos") + 1).alias("length"), (F.min("pos") - 1).alias("trim_left"))
    return center.join(header.select(*keys, "trim_left"), list(keys)).withColumn("pos", F.col("pos") - F.col("trim_left")).drop("trim_left"), header


def objective(points: DataFrame, membership: DataFrame, motif_points: DataFrame, m: float = 2.0, values: Sequence[str] = ("y",), weights: Sequence[float] | None = None, keys: Sequence[str] = ("k",), keep: str | None = None) -> DataFrame:
    """AG7, FI8: (keys, j, least_kept) with j the sum of p^m times the distance,
    members without overlap left out, and the least overlap among members where
    the column `keep` holds (0 without overlap)."""
    own = motif_points.select(*keys, "pos", *(F.col(v).alias(f"m_{v}") for v in values))
    members = membership.where("p > 0")
    met = points.join(members.select("curve_id", *keys, "s"), "curve_id").withColumn("pos", F.col("x") - F.col("s") + 1).join(own, [*keys, "pos"])
    each = met.groupBy("curve_id", *keys).agg(F.count("*").alias("overlap"), (F.sum(_square(values, weights)) / F.count("*")).alias("dist"))
    each = members.join(each, ["curve_id", *keys], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    kept = F.when(F.col(keep), F.col("overlap")) if keep else F.col("overlap")
    return each.groupBy(*keys).agg(F.sum(F.col("dist") * F.pow("p", F.lit(float(m)))).alias("j"), F.min(kept).alias("least_kept"))


def elongations(motifs: DataFrame, max_elong: float = 0.5, trials: int = 10, keys: Sequence[str] = ("k",)) -> DataFrame:
    """IT4b, JO8: (keys, add_left, add_right, new_length) of all elongations to
    try; motifs has length and c_max. Up to `trials` sizes from 0 on each side,
    evenly spread and rounded half to even, that add up to the most at most."""
    most = F.least(F.floor(F.col("length") * max_elong), F.col("c_max").cast("long") - F.col("length")).cast("int")
    sized = motifs.withColumn("most", most).where("most >= 1")
    n = F.least(F.col("most"), F.lit(trials))
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rint(1 + i * (F.col("most") - 1) / F.greatest(n - 1, F.lit(1))).cast("int"))
    every = F.when(F.col("most") <= trials, F.sequence(F.lit(1), F.col("most"))).otherwise(even)
    sizes = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), every)))
    grid = sized.withColumn("sizes", sizes).withColumn("add_left", F.explode("sizes")).withColumn("add_right", F.explode("sizes"))
    grid = grid.where("add_left + add_right > 0 and add_left + add_right <= most")
    return grid.select(*keys, "add_left", "add_right", (F.col("length") + F.col("add_left") + F.col("add_right")).cast("int").alias("new_length"))


def best_elongation(tried: DataFrame, accept: float = 0.05, keys: Sequence[str] = ("k",)) -> DataFrame:
    """IT4c, SO3: of (keys, add_left, add_right, j_before, j_after, feasible) the
    least relative increase per motif if it is below `accept`."""
    rel = (F.col("j_after") - F.col("j_before")) / F.col("j_before")
    best = tried.where("feasible").groupBy(*keys).agg(F.min(F.struct(rel.alias("rel"), "add_left", "add_right")).alias("b"))
    return best.select(*keys, "b.*").where(F.col("rel") < accept)
