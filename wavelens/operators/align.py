"""Alignment of curves with motifs (PR7-PR8, JO1-JO2, FI1-FI4, AG1-AG4, AG16).

points: curve_id, x and value columns, without missing points; lengths: curve_id,
len. motifs: k (and any columns that name a run), length, c_k; motif_points: the
same keys, pos (from 1) and value columns, without gaps. The distance at a shift
is the weighted mean square over the points that both have; a shift s lays the
motif's first position on the curve's point s."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of motif points up to which they are broadcast, and of a part of more.
BROADCAST_ROWS = 500_000


def _met(curves: DataFrame, own: DataFrame, fits: Column, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Every point of a curve with every point of a motif that fits. Up to
    BROADCAST_ROWS motif points are sent to the curves; more are cut into parts of
    about that many, and a task takes one slice of the curves with one part."""
    n = own.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return curves.join(F.broadcast(own), fits)
    parts, slices = -(-n // BROADCAST_ROWS), int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda many, name: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    curves = curves.select("*", F.pmod(F.xxhash64("curve_id"), F.lit(slices)).cast("int").alias("_slice"), every(parts, "_part"))
    own = own.select("*", F.pmod(F.xxhash64(*keys, "pos"), F.lit(parts)).cast("int").alias("_part"), every(slices, "_slice"))
    return curves.join(own, ["_slice", "_part"]).where(fits)


def _square(values: Sequence[str], weights: Sequence[float] | None) -> Column:
    out = None
    for i, v in enumerate(values):
        gap = F.col(v) - F.col(f"m_{v}")
        term = gap * gap if weights is None else F.lit(float(weights[i])) * (gap * gap)
        out = term if out is None else out + term
    return out


def shift_distances(points: DataFrame, lengths: DataFrame, motifs: DataFrame, motif_points: DataFrame, values: Sequence[str] = ("y",), weights: Sequence[float] | None = None, contained: bool = False, keys: Sequence[str] = ("k",), rows: int | None = None) -> DataFrame:
    """JO2, FI1, FI3: (curve_id, keys, length, c_k, s, overlap, diss) of every
    shift with an overlap. Shifts run from where c_k points can overlap on the
    left to where they can on the right; contained: only where the motif lies
    within the curve. Partial sums are made before the shuffle."""
    heads = motifs.select(*keys, "length", "c_k")
    own = motif_points.select(*keys, "pos", *(F.col(v).alias(f"m_{v}") for v in values)).join(heads, list(keys))
    curves = points.join(lengths, "curve_id")
    s = F.col("x") - F.col("pos") + 1
    if contained:
        fits = (s >= 1) & (s <= F.col("len") - F.col("length") + 1)
    else:
        fits = (s >= 1 - (F.col("length") - F.col("c_k"))) & (s <= F.col("len") - F.col("c_k") + 1)
    met = _met(curves, own, fits, keys, rows)
    by = ["curve_id", *keys, "length", "c_k", s.cast("int").alias("s")]
    return met.groupBy(*by).agg(F.sum(_square(values, weights)).alias("ss"), F.count("*").alias("overlap")).withColumn("diss", F.col("ss") / F.col("overlap"))


def best_shift(distances: DataFrame, keys: Sequence[str] = ("k",), fallback: bool = True) -> DataFrame:
    """FI2, WI8, AG3: (curve_id, keys, s, d, overlap): the least distance among
    shifts that overlap in c_k points, or, where no shift does, in as many as any
    shift has; ties go to the smaller shift."""
    by = ["curve_id", *keys]
    most = F.max("overlap").over(Window.partitionBy(*by))
    enough = F.col("overlap") >= (F.least(F.col("c_k").cast("long"), most) if fallback else F.col("c_k"))
    out = distances.withColumn("enough", enough).where("enough").groupBy(*by).agg(F.min(F.struct("diss", "s", "overlap")).alias("b"))
    return out.select(*by, F.col("b.s").alias("s"), F.col("b.diss").alias("d"), F.col("b.overlap").alias("overlap"))


def align(points: DataFrame, lengths: DataFrame, motifs: DataFrame, motif_points: DataFrame, values: Sequence[str] = ("y",), weights: Sequence[float] | None = None, contained: bool = False, keys: Sequence[str] = ("k",), rows: int | None = None) -> DataFrame:
    """JO1: every curve with every motif; s and d are null where no point overlaps."""
    best = best_shift(shift_distances(points, lengths, motifs, motif_points, values, weights, contained, keys, rows), keys)
    every = lengths.select("curve_id").crossJoin(motifs.select(*keys))
    return every.join(best, ["curve_id", *keys], "left")


def fixed_shift(points: DataFrame, motif_points: DataFrame, shifts: DataFrame, values: Sequence[str] = ("y",), weights: Sequence[float] | None = None, keys: Sequence[str] = ("k",)) -> DataFrame:
    """AG16: (curve_id, keys, s, overlap, d) at the given shifts (curve_id, keys, s)."""
    own = motif_points.select(*keys, "pos", *(F.col(v).alias(f"m_{v}") for v in values))
    met = points.join(shifts.select("curve_id", *keys, "s"), "curve_id").withColumn("pos", F.col("x") - F.col("s") + 1).join(own, [*keys, "pos"])
    return met.groupBy("curve_id", *keys, "s").agg(F.count("*").alias("overlap"), (F.sum(_square(values, weights)) / F.count("*")).alias("d"))


def windows(points: DataFrame, shifts: DataFrame, length: int, values: Sequence[str] = ("y",)) -> DataFrame:
    """PR7: positions 1..length of each curve from its shift on, null where the
    curve has no point (also before its start and after its end)."""
    grid = shifts.withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(length)))).withColumn("x", (F.col("s") + F.col("pos") - 1).cast("int"))
    return grid.join(points.select("curve_id", "x", *values), ["curve_id", "x"], "left").select("curve_id", "s", "pos", *values)


def crop(points: DataFrame, shifts: DataFrame, length: int, values: Sequence[str] = ("y",)) -> DataFrame:
    """PR8: the same without padding."""
    pos = F.col("x") - F.col("s") + 1
    return points.join(shifts, "curve_id").where((pos >= 1) & (pos <= length)).select("curve_id", "s", pos.cast("int").alias("pos"), *values)
