"""Labels, agreement, averages and distributions (PR10-PR13, PR17-PR18, FI18,
AG25-AG30, API10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hard_labels(membership: DataFrame, least: float = 0.5) -> DataFrame:
    """PR10: the motif with p over the limit (null if there is none)."""
    return membership.groupBy("curve_id").agg(F.sum(F.when(F.col("p") > least, F.col("k"))).alias("label"))


def clean_labels(membership: DataFrame) -> DataFrame:
    """PR11: sum of the motifs that hold the curve: with K = 2, 0 none, 3 both."""
    return membership.groupBy("curve_id").agg(F.sum(F.col("p_clean") * F.col("k")).alias("label"))


def crisp(membership: DataFrame, least: float = 0.5) -> DataFrame:
    """PR12: p_clean from p."""
    return membership.withColumn("p_clean", (F.col("p") > least).cast("int"))


def bands(membership: DataFrame, k: int = 1, high: float = 0.6, low: float = 0.4) -> DataFrame:
    """FI18: sure, unsure or other, by p of one motif."""
    band = F.when(F.col("p") >= high, "high").when(F.col("p") <= low, "low").otherwise("between")
    return membership.where(F.col("k") == k).select("curve_id", band.alias("band"))


def assigned_shift(membership: DataFrame, labels: DataFrame) -> DataFrame:
    """PR13: the shift of each curve at its motif."""
    return labels.join(membership, (labels["curve_id"] == membership["curve_id"]) & (F.col("label") == F.col("k"))).select(labels["curve_id"], "label", "s")


def contingency(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """AG26, JO15: counts of (label, truth)."""
    return labels.join(truth, "curve_id").groupBy("label", "truth").agg(F.count("*").alias("n"))


def cer(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """AG27, API10: share of pairs that one labelling joins and the other does
    not, from the counts of the contingency table: no pair is made."""
    table = contingency(labels, truth)
    pairs = lambda n: n * (n - 1) / 2
    both = table.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    one = table.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    two = table.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    return both.crossJoin(one).crossJoin(two).select(((F.col("a") + F.col("b") - 2 * F.col("both")) / pairs(F.col("n"))).alias("cer"))


def best_restart(iterations: DataFrame) -> DataFrame:
    """AG25: the run with the least objective at its last iteration, per (clusters, c)."""
    last = iterations.groupBy("clusters", "c", "init").agg(F.max(F.struct("iter", "j")).alias("b")).select("clusters", "c", "init", F.col("b.iter").alias("iter"), F.col("b.j").alias("j"))
    return last.groupBy("clusters", "c").agg(F.min(F.struct("j", "init", "iter")).alias("b")).select("clusters", "c", F.col("b.init").alias("init"), F.col("b.iter").alias("iter"), F.col("b.j").alias("j"))


def mean_curve(windows: DataFrame, labels: DataFrame, value: str = "y") -> DataFrame:
    """AG28: mean of the aligned curves of each label at each position."""
    return windows.join(labels, "curve_id").groupBy("label", "pos").agg(F.avg(value).alias("mean_y"), F.count(value).alias("n"))


def median_shift(shifts: DataFrame) -> DataFrame:
    """AG28."""
    return shifts.groupBy("label").agg(F.median("s").alias("median_shift"))


def histogram(values: DataFrame, value: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """AG29: counts in bins of a width, from bin * width on."""
    return values.where(F.col(value).isNotNull()).groupBy(*by, F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def density(values: DataFrame, value: str, grid: DataFrame, width: float) -> DataFrame:
    """AG29: Gaussian kernel density at the grid's values (column g; the grid is
    a figure's axis and is broadcast)."""
    z = (F.col("g") - F.col(value)) / width
    kernel = F.exp(z * z * -0.5) / (width * 2.5066282746310002)
    return values.crossJoin(F.broadcast(grid)).groupBy("g").agg(F.avg(kernel).alias("density"))


def five_numbers(values: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """AG29, AG30: box-plot numbers; quartiles are interpolated (hinges differ a
    little from them)."""
    q = lambda p: F.percentile(value, F.lit(p))
    return values.groupBy(*by).agg(F.min(value).alias("low"), q(0.25).alias("q1"), q(0.5).alias("mid"), q(0.75).alias("q3"), F.max(value).alias("high"), F.count(value).alias("n"))


def percent_of_least(length: Column, c: Column) -> Column:
    """PR17."""
    return length * 100.0 / c


def width_by_membership(p: Column) -> Column:
    """PR18: line width of a curve in a figure (rounded half to even)."""
    return F.bround(p * 5, 2)


def width_by_distance(diss: Column, r: Column) -> Column:
    """PR18: line width of an occurrence in a figure."""
    return F.bround(diss * -4 / r + 5, 2)


def ordered_runs(runs: DataFrame, value: str) -> DataFrame:
    """WI7: runs within (clusters, c) by a value, largest first."""
    return runs.withColumn("ord", F.row_number().over(Window.partitionBy("clusters", "c").orderBy(F.desc(value), "init")))
