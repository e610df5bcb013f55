"""Choosing, grouping and searching motifs (API5, API6, API8; JO3, JO9, JO10,
AG21-AG25, WI2-WI5, FI4, FI5, FI12-FI15, SO1, SO4)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .align import _square


#: Motifs that are linked at most: their matrix has 800 MB.
MOST_MOTIFS = 10_000


def candidates(motifs: DataFrame, sil_threshold: float = 0.5, size_threshold: int = 2, K: Sequence[int] | None = None, c: Sequence[int] | None = None) -> DataFrame:
    """FI12, FI13, SO1: motifs (clusters, c, init, k, length, avg_sil, size) that pass,
    the longest first, then in the order of clusters (K), c, init, k; motif_id from 1."""
    out = motifs.where((F.col("avg_sil") >= sil_threshold) & (F.col("size") >= size_threshold))
    out = out.where(F.col("clusters").isin(list(K))) if K else out
    out = out.where(F.col("c").isin(list(c))) if c else out
    return out.withColumn("motif_id", F.row_number().over(Window.orderBy(F.desc("length"), "clusters", "c", "init", "k")).cast("long"))


def motif_pairs(motifs: DataFrame, motif_points: DataFrame, motif_overlap: float = 0.6, values: Sequence[str] = ("y",), weights: Sequence[float] | None = None) -> DataFrame:
    """JO3: (m1, m2, shift, d) of each unordered pair, m1 the longer (of equal
    ones the smaller motif_id): m2 is laid along m1 at every shift with at least
    floor(motif_overlap * shorter length) common points, or the most there are.
    The motifs are as many as a person can look at: their pairs are few."""
    order = motifs.select("motif_id", "length", F.row_number().over(Window.orderBy(F.desc("length"), "motif_id")).alias("ord"))
    a = order.toDF("m1", "l1", "o1")
    pairs = a.join(order.toDF("m2", "l2", "o2"), F.col("o1") < F.col("o2")).withColumn("c_k", F.floor(F.col("l2") * motif_overlap + 1e-9).cast("int"))
    p1 = motif_points.select(F.col("motif_id").alias("m1"), F.col("pos").alias("x"), *values)
    p2 = motif_points.select(F.col("motif_id").alias("m2"), "pos", *(F.col(v).alias(f"m_{v}") for v in values))
    met = pairs.join(p1, "m1").join(p2, "m2").withColumn("shift", (F.col("x") - F.col("pos") + 1).cast("int"))
    met = met.where((F.col("shift") >= 1 - (F.col("l2") - F.col("c_k"))) & (F.col("shift") <= F.col("l1") - F.col("c_k") + 1))
    each = met.groupBy("m1", "m2", "c_k", "shift").agg((F.sum(_square(values, weights)) / F.count("*")).alias("d"), F.count("*").alias("overlap"))
    most = F.max("overlap").over(Window.partitionBy("m1", "m2"))
    each = each.withColumn("enough", F.col("overlap") >= F.least(F.col("c_k").cast("long"), most)).where("enough")
    return each.groupBy("m1", "m2").agg(F.min(F.struct("d", "shift")).alias("b")).select("m1", "m2", F.col("b.shift").alias("shift"), F.col("b.d").alias("d"))


def radius(train: DataFrame, k: int = 3, votes: float = 0.5, grid: int = 10_000, groups: Sequence[str] = ()) -> DataFrame:
    """AG21, JO9: (groups, r) from training pairs (groups, d, p_clean): the
    largest distance of a member if no other is nearer; else the least of `grid`
    values between the extreme distances at which at most the share `votes` of the
    k nearest training distances (with all ties of the k-th) are members'. Null
    if there is none.

    The k nearest of a grid value lie among the k before and the k after it, so
    of all distances between two grid values the k first and k last are enough:
    2 k * grid rows at most are gathered, however many curves there are."""
    known = train.where("d is not null")
    stats = known.groupBy(*groups).agg(F.max(F.when(F.col("p_clean") == 1, F.col("d"))).alias("top"), F.min(F.when(F.col("p_clean") == 0, F.col("d"))).alias("low"), F.min("d").alias("least"), F.max("d").alias("most"))
    apart = F.col("top").isNotNull() & (F.col("low").isNull() | (F.col("top") <= F.col("low")))
    easy = stats.where(apart).select(*groups, F.col("top").alias("r"))
    hard = stats.where(~apart)
    # Distinct distances with their members and sizes, in order.
    by = known.join(F.broadcast(hard.select(*groups)), list(groups), "left_semi") if groups else (known if hard.head(1) else known.limit(0))
    table = by.groupBy(*groups, "d").agg(F.sum("p_clean").alias("ones"), F.count("*").alias("n"))
    table = table.join(F.broadcast(hard.select(*groups, "least", "most")), list(groups)) if groups else table.crossJoin(F.broadcast(hard.select("least", "most")))
    cell = F.floor((F.col("d") - F.col("least")) / F.greatest(F.col("most") - F.col("least"), F.lit(1e-300)) * (grid - 1))
    table = table.withColumn("cell", cell)
    place = lambda order: F.row_number().over(Window.partitionBy(*groups, "cell").orderBy(order))
    table = table.withColumns({"up": place(F.asc("d")), "down": place(F.desc("d"))}).where(f"up <= {k} or down <= {k}")
    sorted_table = table.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("d", "ones", "n"))).alias("t"))
    values = hard.join(sorted_table, list(groups)) if groups else hard.crossJoin(sorted_table)
    step = (F.col("most") - F.col("least")) / (grid - 1)
    least = F.udf(_least_value(k, votes, grid), "double")
    found = values.select(*groups, least(F.transform("t", lambda x: x["d"]), F.transform("t", lambda x: x["ones"]), F.transform("t", lambda x: x["n"]), F.col("least"), step).alias("r"))
    return easy.unionByName(found)


def _least_value(k: int, votes: float, grid: int):
    def run(d, ones, n, least, step):
        """One call per group; the grid is walked in numpy."""
        d, ones, n = np.array(d, float), np.array(ones, float), np.array(n, float)
        g = least + step * np.arange(grid)
        right = np.searchsorted(d, g)
        at = right[:, None] + np.arange(-k, k)[None, :]
        there = (at >= 0) & (at < len(d))
        at = np.clip(at, 0, len(d) - 1)
        gap = np.where(there, np.abs(d[at] - g[:, None]), np.inf)
        order = np.argsort(gap, axis=1, kind="stable")
        gap, size, one = (np.take_along_axis(x, order, 1) for x in (gap, np.where(there, n[at], 0), np.where(there, ones[at], 0)))
        enough = np.argmax(np.cumsum(size, 1) >= min(k, n.sum()), axis=1)
        inside = gap <= np.take_along_axis(gap, enough[:, None], 1)
        share = (one * inside).sum(1) / (size * inside).sum(1)
        ok = np.flatnonzero(share <= votes)
        return float(g[ok[0]]) if len(ok) else None

    return run


def average_linkage(ids: Sequence[int], d: np.ndarray) -> list[tuple[int, int, int, float]]:
    """AG22: merges (step, left, right, height) of a symmetric matrix; negative
    numbers are ids' places (from 1), positive ones earlier steps. Of equal
    heights the first pair by place goes first."""
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(len(ids)), [-(i + 1) for i in range(len(ids))], []
    alive = np.ones(len(ids), bool)
    for step in range(1, len(ids)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        out.append((step, name[i], name[j], float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i], alive[j] = size[i] + size[j], step, False
    return out


def cut(n: int, merges: Sequence[tuple[int, int, int, float]], height: float) -> list[int]:
    """Group of each place when merges up to `height` are done; groups are
    numbered in the order in which places meet them."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    top: dict[int, int] = {}
    for step, left, right, h in merges:
        a, b = (-left - 1 if left < 0 else top[left]), (-right - 1 if right < 0 else top[right])
        top[step] = a
        if h <= height:
            parent[find(b)] = find(a)
    seen: dict[int, int] = {}
    return [seen.setdefault(find(i), len(seen) + 1) for i in range(n)]


def linkage(spark: SparkSession, motifs: DataFrame, pairs: DataFrame, height: float) -> tuple[DataFrame, DataFrame]:
    """(step, left_id, right_id, height) and (motif_id, grp). Linkage is one
    sequential computation on the motifs' matrix, for up to MOST_MOTIFS of them."""
    if motifs.count() > MOST_MOTIFS:
        raise ValueError(f"more than {MOST_MOTIFS} motifs; filter them first")
    ids = [x.motif_id for x in motifs.select("motif_id").orderBy("motif_id").collect()]
    place = {m: i for i, m in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.inf)
    for x in pairs.select("m1", "m2", "d").collect():
        d[place[x.m1], place[x.m2]] = d[place[x.m2], place[x.m1]] = x.d
    merges = average_linkage(ids, d)
    groups = cut(len(ids), merges, height)
    return spark.createDataFrame(merges, "step int, left_id int, right_id int, height double"), spark.createDataFrame(list(zip(ids, groups, strict=True)), "motif_id long, grp int")


def occurrences(distances: DataFrame, radius: DataFrame | float, keys: Sequence[str] = ("motif_id",)) -> DataFrame:
    """FI4, FI5, WI2: (keys, curve_id, shift, diss): of each run of valid shifts
    in a row within the radius, the nearest one (the first of equal ones).
    distances: contained shifts with c_k and overlap; valid ones overlap in c_k
    points; runs are counted along the valid shifts only."""
    valid = distances.where(F.col("overlap") >= F.col("c_k"))
    if isinstance(radius, DataFrame):
        valid = valid.join(F.broadcast(radius), list(keys))
    else:
        valid = valid.withColumn("r", F.lit(float(radius)))
    by = [*keys, "curve_id"]
    n = F.row_number().over(Window.partitionBy(*by).orderBy("s"))
    hits = valid.withColumn("n", n).where("diss <= r")
    island = F.col("n") - F.row_number().over(Window.partitionBy(*by).orderBy("s"))
    best = hits.withColumn("island", island).groupBy(*by, "island").agg(F.min(F.struct("diss", "s")).alias("b"))
    return best.select(*by, F.col("b.s").alias("shift"), F.col("b.diss").alias("diss"))


def frequencies(found: DataFrame, keys: Sequence[str] = ("motif_id",)) -> DataFrame:
    """AG24: (keys, frequency, mean_diss) of motifs with an occurrence (FI14)."""
    return found.groupBy(*keys).agg(F.count("*").alias("frequency"), F.avg("diss").alias("mean_diss"))


def approximate_frequencies(distances: DataFrame, keys: Sequence[str] = ("motif_id",)) -> DataFrame:
    """AG23: from (keys, d, r): curves within the radius and their mean (null if none)."""
    near = F.col("d") <= F.col("r")
    return distances.groupBy(*keys).agg(F.count_if(near).alias("frequency"), F.avg(F.when(near, F.col("d"))).alias("mean_diss"))


def average_rank(value: Column, by: Sequence[str] = ()) -> Column:
    """WI3: rank with ties at their mean; nulls last."""
    order = Window.partitionBy(*by).orderBy(value.asc_nulls_last())
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def rank_sum(motifs: DataFrame, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """WI4: motifs (motif_id, frequency, mean_diss) in the order of the sum of
    two ranks, many first and near first; ties by motif_id."""
    score = average_rank(-F.col("frequency"), by) + average_rank(F.col("mean_diss"), by)
    out_order = Window.partitionBy(*by).orderBy("score", "motif_id")
    return motifs.withColumn("score", score).withColumn(out, F.row_number().over(out_order))


def diverse(ranked: DataFrame, length_diff: float = float("inf")) -> DataFrame:
    """WI5: within a group, in rank order, a motif stays if its length differs
    from that of each kept one by more than length_diff times it (in either
    direction); infinite: only the first. ranked: motif_id, grp, rank, length."""
    if length_diff == float("inf"):
        return ranked.where("rank = 1")

    def run(pdf):
        kept: list[float] = []
        keep = []
        for length in pdf.sort_values("rank")["length"]:
            ok = all(length > x * (1 + length_diff) or length < x * (1 - length_diff) for x in kept)
            keep.append(ok)
            kept += [length] if ok else []
        return pdf.sort_values("rank")[keep]

    return ranked.groupBy("grp").applyInPandas(run, ranked.schema)


def top(ranked: DataFrame, freq_threshold: int = 5, top_n: int | str = "all") -> DataFrame:
    """FI15, SO4."""
    out = ranked.where(F.col("frequency") >= freq_threshold).orderBy("rank")
    return out if top_n == "all" else out.limit(int(top_n))
