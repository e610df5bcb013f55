"""Tables that the figures draw (API2, API7, API9, API11; PL1-PL15). Nothing is
rendered: each function returns a frame of what a figure shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, metrics
from ..options import check_plot
from .discovery import Found, Grid, Groups
from .fit import Fit


def aligned_curves(result: Fit, points: DataFrame, values: Sequence[str] = ("y",), cleaned: bool = False) -> DataFrame:
    """PL1: curves under each motif with their line width (members only if cleaned)."""
    size = result.motif_points.where(F.col("cleaned") == cleaned).groupBy("run_id", "k").agg(F.max("pos").alias("length"))
    shift = "s_clean" if cleaned else "s"
    held = result.membership.where("p_clean = 1" if cleaned else "p > 0").withColumn("_s", F.col(shift))
    pos = (F.col("x") - F.col("_s") + 1).cast("int")
    out = points.join(held, "curve_id").join(size, ["run_id", "k"]).withColumn("pos", pos).where("pos between 1 and length")
    return out.select("run_id", "k", "curve_id", "pos", *values, metrics.width_by_membership(F.col("p")).alias("width"))


def centers(result: Fit, cleaned: bool = False) -> DataFrame:
    """PL2."""
    return result.motif_points.where(F.col("cleaned") == cleaned).drop("cleaned")


def memberships(result: Fit, labels: DataFrame | None = None) -> DataFrame:
    """PL3, API11: bars of p and p_clean, with labels where given."""
    out = result.membership.select("run_id", "k", "curve_id", "p", "p_clean")
    return out.join(labels, "curve_id", "left") if labels is not None else out


def traces(result: Fit) -> DataFrame:
    """PL4, AG31."""
    return result.iterations


def silhouette_bars(sil: DataFrame) -> DataFrame:
    """PL5: pieces in order with their motif's number and average."""
    per = sil.groupBy("run_id", "k").agg(F.count("*").alias("n"), F.avg("sil").alias("avg_sil"))
    return sil.join(per, ["run_id", "k"])


def run_silhouettes(grid: Grid) -> DataFrame:
    """PL6: mean and deviation per run, ordered within (clusters, c)."""
    per = grid.table("motifs").groupBy("clusters", "c", "init").agg(F.avg("avg_sil").alias("mean_sil"), F.stddev_samp("avg_sil").alias("sd_sil"))
    return metrics.ordered_runs(per, "mean_sil")


def run_times(grid: Grid) -> DataFrame:
    """PL7."""
    return metrics.ordered_runs(grid.table("runs").select("clusters", "c", "init", "seconds", "iter", "status"), "seconds")


def run_distances(grid: Grid, cleaned: bool = False, by: Sequence[str] = ("clusters", "c", "init")) -> DataFrame:
    """PL8: box-plot numbers of distances."""
    return metrics.five_numbers(grid.table("membership"), "d_clean" if cleaned else "d", tuple(by))


def run_lengths(grid: Grid) -> DataFrame:
    """PL9: raw and cleaned lengths, absolute and in percent of the least length."""
    size = grid.table("motif_points").groupBy("clusters", "c", "init", "k").agg(F.max(F.when(~F.col("cleaned"), F.col("pos"))).alias("length"), F.max(F.when(F.col("cleaned"), F.col("pos"))).alias("length_clean"))
    return size.withColumns({"pct": metrics.percent_of_least(F.col("length"), F.col("c")), "pct_clean": metrics.percent_of_least(F.col("length_clean"), F.col("c"))})


def distance_bins(grouped: Groups, width: float, per_group: bool = False) -> DataFrame:
    """PL10, FI19: histogram of distances of members and others, with the radius."""
    d = grouped.candidates.distances
    if not per_group:
        return metrics.histogram(d, "d", width, ("p_clean",)).withColumn("r", F.lit(grouped.r_all))
    d = d.join(grouped.groups, "motif_id")
    return metrics.histogram(d, "d", width, ("grp", "p_clean")).join(grouped.radii, "grp")


def distance_densities(grouped: Groups, grid: DataFrame, width: float) -> DataFrame:
    """PL10."""
    both = [metrics.density(grouped.candidates.distances.where(F.col("p_clean") == c), "d", grid, width).withColumn("p_clean", F.lit(c)) for c in (0, 1)]
    return both[0].unionByName(both[1])


def dendrogram(grouped: Groups) -> DataFrame:
    """PL11: merges with the height of the cut."""
    return grouped.merges.withColumn("cut", F.lit(2 * grouped.r_all))


def group_alignment(grouped: Groups) -> DataFrame:
    """PL12: where each motif of a group lies along the group's first motif."""
    heads = grouped.groups.join(grouped.candidates.motifs.select("motif_id", "length"), "motif_id")
    first = heads.groupBy("grp").agg(F.min("motif_id").alias("first"))
    laid = heads.join(first, "grp").join(grouped.pairs.select(F.col("m1").alias("first"), F.col("m2").alias("motif_id"), "shift"), ["first", "motif_id"], "left")
    start = F.coalesce("shift", F.lit(1))
    return laid.select("grp", "motif_id", start.alias("start"), (start + F.col("length") - 1).alias("end"))


def frequency_scatter(grouped: Groups) -> DataFrame:
    """PL13: approximate frequency and mean distance of each motif."""
    near = grouped.candidates.distances.join(grouped.groups.join(grouped.radii, "grp"), "motif_id")
    return discovery.approximate_frequencies(near, ["grp", "motif_id"])


def found_motifs(found: Found, freq_threshold: int = 5, top_n: int | str = "all") -> DataFrame:
    """PL14, FI15."""
    check_plot(freq_threshold, top_n, found.motifs.agg(F.max("frequency")).first()[0] or 0)
    return discovery.top(found.motifs, freq_threshold, top_n)


def found_segments(found: Found, points: DataFrame, values: Sequence[str] = ("y",), freq_threshold: int = 1, top_n: int | str = "all") -> DataFrame:
    """PL14, JO11: the stretch of curve of each occurrence, with its line width."""
    chosen = found_motifs(found, freq_threshold, top_n).select("rank", "motif_id", "length", "r")
    held = found.occurrences.join(chosen, "motif_id")
    pos = (F.col("x") - F.col("shift") + 1).cast("int")
    out = points.join(held, "curve_id").withColumn("pos", pos).where("pos between 1 and length")
    return out.select("rank", "motif_id", "curve_id", "shift", "pos", *values, metrics.width_by_distance(F.col("diss"), F.col("r")).alias("width"))


def label_figures(windows: DataFrame, labels: DataFrame, shifts: DataFrame, value: str = "y") -> tuple[DataFrame, DataFrame]:
    """PL15, SO5: mean curve of each label, and shift bars in their order."""
    bars = labels.join(shifts, "curve_id").orderBy("label", "curve_id")
    return metrics.mean_curve(windows, labels, value), bars
