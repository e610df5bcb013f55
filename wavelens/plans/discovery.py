"""Functional motif discovery, end to end (API3-API9): runs over a grid with
resumable results, candidates, groups and radii, occurrences of chosen motifs."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import align, discovery, silhouette
from ..options import SHORT, FitOptions, check_filter
from ..sources import curves as source
from .fit import Fit, fit, run_folder


def pieces(result: Fit) -> DataFrame:
    """(run_id, k, curve_id, y): what each cleaned motif holds of its curves, laid
    on the raw motif's positions; its gaps are left out."""
    domain = result.motif_points.where("not cleaned").groupBy("run_id", "k").agg(F.max("pos").alias("length"), F.collect_set(F.when(F.col("ch").isNotNull(), F.col("pos"))).alias("inside"))
    held = result.membership.where("p_clean = 1").select("run_id", "k", "curve_id", "s_clean").join(domain, ["run_id", "k"]).join(result.curves, "curve_id")
    channels = result.channels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                w = kernels.window(np.frombuffer(row["y"]).reshape(-1, channels), row["s_clean"], row["length"])
                w[np.isin(np.arange(1, row["length"] + 1), row["inside"], invert=True)] = np.nan
                out.append(w.tobytes())
            yield pa.record_batch([batch.column("run_id"), batch.column("k"), batch.column("curve_id"), pa.array(out, pa.binary())], names=["run_id", "k", "curve_id", "y"])

    return held.mapInArrow(run, "run_id long, k int, curve_id long, y binary")


def piece_distances(parts: DataFrame, result: Fit, contained: bool = False) -> DataFrame:
    """JO4: (run_id, ka, a, kb, b, d), both ways, of all pairs of pieces of a run,
    the shorter laid along the longer. contained: only inside it, and without a
    shift between equally long ones; else with an overlap of the run's least
    length. A row is a pair: for the means of many pieces see `mean_piece_distances`."""
    runs = {x.run_id: x.c for x in result.runs.select("run_id", "c").collect()}
    channels, weights = result.channels, np.array(result.weights)
    a, b = parts.toDF("run_id", "ka", "a", "ya"), parts.toDF("run_id", "kb", "b", "yb")
    pairs = a.join(b, "run_id").where("ka < kb or (ka = kb and a < b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run_id, x, y in zip(*(batch.column(c).to_pylist() for c in ("run_id", "ya", "yb")), strict=True):
                x, y = np.frombuffer(x).reshape(-1, channels), np.frombuffer(y).reshape(-1, channels)
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                least = min(runs[run_id], len(y))
                d = kernels.best_shift(x, y, least, weights, contained)[1]
                out.append(None if math.isnan(d) else d)
            yield pa.record_batch([*(batch.column(c) for c in ("run_id", "ka", "a", "kb", "b")), pa.array(out, pa.float64())], names=["run_id", "ka", "a", "kb", "b", "d"])

    half = pairs.mapInArrow(run, "run_id long, ka int, a long, kb int, b long, d double")
    return half.unionByName(half.select("run_id", F.col("kb").alias("ka"), F.col("b").alias("a"), F.col("ka").alias("kb"), F.col("a").alias("b"), "d"))


#: Pieces and bytes of a block, about.
_BLOCK, _BLOCK_BYTES = 8192, 8 << 20


def mean_piece_distances(parts: DataFrame, result: Fit, contained: bool = False) -> DataFrame:
    """(run_id, ka, a, kb, mean): means of `piece_distances` from each piece to the
    (other) pieces of each motif. Pieces of a motif go to blocks; each pair of
    blocks is one matrix computation that gives sums for its pieces, so that all
    pairs are met and none is a row."""
    runs = {x.run_id: x.c for x in result.runs.select("run_id", "c").collect()}
    channels, weights = result.channels, np.array(result.weights)
    held = parts.groupBy("run_id", "k").agg(F.count("*").alias("n"), F.max(F.length("y")).alias("size")).collect()  # one a motif
    of = {(x.run_id, x.k): -(-x.n // max(1, min(_BLOCK, _BLOCK_BYTES // max(1, x.size)))) for x in held}
    blocks = [(*at, b) for at, n in sorted(of.items()) for b in range(n)]
    pairs = [(i, j) for i, x in enumerate(blocks) for j, y in enumerate(blocks) if i <= j and x[0] == y[0]]
    meets: dict[int, list[int]] = {}
    for at, (i, j) in enumerate(pairs):
        for b in {i, j}:
            meets.setdefault(b, []).append(at)
    spark = result.runs.sparkSession
    known = spark.createDataFrame([(*at, n) for at, n in of.items()], "run_id long, k int, many int")
    sent = spark.createDataFrame([(*x, i, meets[i]) for i, x in enumerate(blocks)], "run_id long, k int, part int, block int, pairs array<int>")
    cut = parts.join(F.broadcast(known), ["run_id", "k"]).withColumn("part", F.expr("cast(pmod(xxhash64(curve_id), many) as int)"))
    packed = cut.groupBy("run_id", "k", "part").agg(F.collect_list(F.struct("curve_id", "y")).alias("held"))
    dealt = packed.join(F.broadcast(sent), ["run_id", "k", "part"]).select(F.explode("pairs").alias("pair"), "block", "run_id", "k", "held")
    alone = {at for at, (i, j) in enumerate(pairs) if i == j}

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: x["block"])
        if len(rows) == 1 and rows[0]["pair"] not in alone:  # the hashes left the other block empty
            return schema.empty_table()
        made = [np.frombuffer(b"".join(p["y"] for p in x["held"])).reshape(len(x["held"]), -1, channels) for x in rows]
        least = min(runs[rows[0]["run_id"]], *(y.shape[1] for y in made))
        sums = kernels.block_sums(made[0], made[1] if len(made) > 1 else None, least, weights, contained)
        out = []
        for own, other, v in zip(rows, rows[::-1], sums, strict=False):  # a block with itself: once
            n = len(own["held"])
            cols = [np.full(n, own["run_id"]), np.full(n, own["k"], np.int32), [p["curve_id"] for p in own["held"]], np.full(n, other["k"], np.int32), v[:, 0], v[:, 1].astype(np.int64)]
            out.append(pa.table(dict(zip(("run_id", "ka", "a", "kb", "total", "n"), cols, strict=True)), schema=schema))
        return pa.concat_tables(out)

    schema = pa.schema([("run_id", pa.int64()), ("ka", pa.int32()), ("a", pa.int64()), ("kb", pa.int32()), ("total", pa.float64()), ("n", pa.int64())])
    met = dealt.repartition(max(1, min(len(pairs), 512)), "pair").groupBy("pair").applyInArrow(run, "run_id long, ka int, a long, kb int, total double, n long")
    return met.groupBy("run_id", "ka", "a", "kb").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean")).where("mean is not null")


def silhouettes(result: Fit, contained: bool = False) -> DataFrame:
    """API3, Q18: (run_id, k, curve_id, sil, ord). A run of one motif gives 0, with a warning."""
    if result.runs.where("clusters = 1").head(1):
        warnings.warn("a run of one motif has nothing to be apart from: its silhouettes are 0", stacklevel=2)
    parts = pieces(result)
    return silhouette.from_means(mean_piece_distances(parts, result, contained), parts.select("run_id", "k", "curve_id"), ["run_id"])


@dataclass
class Grid:
    """Results of a grid of runs, as tables under a folder (keys clusters, c, init),
    with the options that they were made with."""

    spark: SparkSession
    folder: str
    options: FitOptions
    weights: list[float]  # of the channels in the distance
    K: list[int]
    c: list[int]

    def table(self, name: str, K: Sequence[int] | None = None, c: Sequence[int] | None = None) -> DataFrame:
        return source.read_runs(self.spark, f"{self.folder}/{name}", K, c)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A written table; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _settings(options: FitOptions, levels: Sequence[str], derivatives: Sequence[str], contained: bool) -> str:
    """What all runs of a grid share, as text. short_curves is left out at its
    default, so that folders from before it still go on."""
    shared = {k: v for k, v in asdict(options).items() if k not in ("K", "c", "seed") and (k, v) != ("short_curves", SHORT[0])}
    return json.dumps({"options": shared, "levels": list(levels), "derivatives": list(derivatives), "contained": contained}, sort_keys=True)


def open_grid(spark: SparkSession, folder: str) -> Grid:
    """SC7, SC8: a written grid with its options."""
    base = folder.rstrip("/")
    row = spark.read.parquet(f"{base}/settings").first()
    held = json.loads(row.settings)
    options = FitOptions(K=row.K[0], c=row.c[0], **{k: tuple(v) if isinstance(v, list) else v for k, v in held["options"].items()})
    return Grid(spark, base, options, list(row.weights), list(row.K), list(row.c))


def find_candidates(
    spark: SparkSession, points: DataFrame, lengths: DataFrame, K: Sequence[int], c: Sequence[int], n_init: int, folder: str, options: FitOptions | None = None,
    levels: Sequence[str] = ("y",), derivatives: Sequence[str] = (), contained: bool = False, at_once: int = 20, max_restarts: int = 3,
) -> Grid:
    """API4, D12, SC5, SC6, SC8, Q19: all runs of K x c x n_init that the folder
    has no result of, `at_once` of them in one fit.

    A run that reaches iter_max starts again from another seed, up to
    max_restarts times; one that then has not converged is kept, marked so, and
    gives no candidates. Tables of a run replace those of an interrupted write;
    `runs` is written last and tells what is done. Spaces in the folder's last
    name become underscores, with a warning. The options are stored; a folder
    with other ones raises ValueError."""
    options = options or FitOptions(2, 2)
    if not (isinstance(n_init, int) and n_init >= 1):
        raise ValueError("n_init is an integer of 1 or more")
    base = folder.rstrip("/")
    head, _, name = base.rpartition("/")
    if " " in name:
        warnings.warn("spaces in the name become underscores", stacklevel=2)
        base = f"{head}/{name.replace(' ', '_')}"
    settings = _settings(options, levels, derivatives, contained)
    known = _read(spark, f"{base}/settings")
    row = known.first() if known is not None else None
    if row is not None and row.settings != settings:
        raise ValueError("the folder has runs of other options")
    checked = replace(options, K=K[0], c=c[0]).checked(dims=len(levels))
    weights = checked.channel_weights(len(levels))
    every = [sorted({*new, *(old or [])}) for new, old in ((K, row and row.K), (c, row and row.c))]
    if row is None or every != [list(row.K), list(row.c)]:
        made = [(settings, *every, weights)]
        held = spark.createDataFrame(made, "settings string, K array<int>, c array<int>, weights array<double>")
        held.coalesce(1).write.mode("overwrite").parquet(f"{base}/settings")
    grid, done = source.run_grid(spark, K, c, n_init), _read(spark, f"{base}/runs")
    todo = grid if done is None else source.pending(grid, done)
    work = [(x, 0) for x in todo.orderBy("run_id").collect()]  # as many rows as runs
    while work:
        part, work = work[:at_once], work[at_once:]
        seeds = [x.init + 10_007 * tries for x, tries in part]
        result = fit(spark, points, lengths, [replace(options, K=x.clusters, c=x.c, seed=seed) for (x, _), seed in zip(part, seeds, strict=True)], levels, derivatives)
        status = {x.run_id: x.status for x in result.runs.collect()}
        again = [n for n, (_, tries) in enumerate(part, 1) if status[n] != "converged" and tries < max_restarts]
        work += [(part[n - 1][0], part[n - 1][1] + 1) for n in again]
        over = [(n, x.clusters, x.c, x.init, tries) for n, (x, tries) in enumerate(part, 1) if n not in again]
        if over:
            _write_runs(spark, result, over, base, contained)
    return open_grid(spark, base)


def _write_runs(spark: SparkSession, result: Fit, over: list[tuple], base: str, contained: bool) -> None:
    """Tables of the runs (run_id, clusters, c, init, restarts) that are over."""
    names = F.broadcast(spark.createDataFrame(over, "run_id long, clusters int, c int, init int, restarts int"))
    keyed = lambda df: df.drop("clusters", "c").join(names, "run_id").drop("run_id")
    path = f"{run_folder(spark)}/silhouettes"
    silhouettes(result, contained).write.parquet(path)  # all pairs are met once
    sil = spark.read.parquet(path)
    average = silhouette.average(sil, ["run_id"])
    size = result.motif_points.where("cleaned").groupBy("run_id", "k").agg(F.max("pos").alias("length"))
    tables = {"motif_points": result.motif_points, "membership": result.membership, "iterations": result.iterations, "silhouettes": sil, "motifs": size.join(average, ["run_id", "k"])}
    for name, df in tables.items():
        source.write_run(keyed(df).drop("restarts"), f"{base}/{name}")
    source.write_run(keyed(result.runs), f"{base}/runs")
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Kept:
    """SC10: frames of a result (fields) that can be saved in a folder and loaded."""

    def save(self, folder: str) -> None:
        for f in fields(self):
            value, path = getattr(self, f.name), f"{folder.rstrip('/')}/{f.name}"
            if isinstance(value, Kept):
                value.save(path)
            elif isinstance(value, DataFrame):
                value.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, folder: str):
        base = folder.rstrip("/")
        if "candidates" in {f.name for f in fields(cls)}:
            return cls(Candidates.load(spark, f"{base}/candidates"), *(spark.read.parquet(f"{base}/{f.name}") for f in fields(cls)[1:]))
        return cls(*(spark.read.parquet(f"{base}/{f.name}") for f in fields(cls)))


@dataclass
class Candidates(Kept):
    """D14: motif_id with its run, its cleaned points, and every curve's distance."""

    motifs: DataFrame  # motif_id, clusters, c, init, k, length, avg_sil, size
    motif_points: DataFrame  # motif_id, pos, ch
    distances: DataFrame  # motif_id, curve_id, d, p_clean
    settings: DataFrame  # weights, max_gap


def _subset(name: str, chosen: Sequence[int] | None, known: list[int]) -> list[int] | None:
    """FI13: the chosen values; all, with a warning, where some are not of the grid."""
    if chosen is not None and not set(chosen) <= set(known):
        warnings.warn(f"{name} is not a subset of the grid's; all are used", stacklevel=3)
        return None
    return list(chosen) if chosen is not None else None


def filter_candidates(grid: Grid, sil_threshold: float = 0.5, size_threshold: int = 2, K: Sequence[int] | None = None, c: Sequence[int] | None = None, converged: bool = True) -> Candidates:
    """API5, SC7: only directories of the chosen K and c are read. converged:
    motifs of runs that reached iter_max in all their starts are left out."""
    check_filter(sil_threshold, size_threshold)
    K, c = _subset("K", K, grid.K), _subset("c", c, grid.c)
    key = ["clusters", "c", "init"]
    found = grid.table("motifs", K, c)
    if converged:
        found = found.join(grid.table("runs", K, c).where("status = 'converged'").select(*key), key, "left_semi")
    motifs = discovery.candidates(found, sil_threshold, size_threshold)
    rows = motifs.collect()  # motifs that a person chooses from
    if not rows:
        raise ValueError("no motif passes the filter")
    motifs = grid.spark.createDataFrame(rows, motifs.schema)
    key = [*key, "k"]
    ids = F.broadcast(motifs.select("motif_id", *key))
    own = grid.table("motif_points", K, c).where("cleaned").join(ids, key).select("motif_id", "pos", "ch")
    d = grid.table("membership", K, c).join(ids, key).select("motif_id", "curve_id", F.col("d_clean").alias("d"), "p_clean")
    settings = grid.spark.createDataFrame([(grid.weights, float(grid.options.max_gap))], "weights array<double>, max_gap double")
    return Candidates(motifs, own, d, settings)


def _flat(points: DataFrame, channels: int) -> DataFrame:
    """Channels as columns, without gaps."""
    return points.where("ch is not null").select(*(c for c in points.columns if c != "ch"), *(F.col("ch")[i].alias(f"v{i}") for i in range(channels)))


def _rows(df: DataFrame) -> DataFrame:
    """A table of a row a motif, group or pair of motifs as its rows: what it is
    made of is planned once, not again in each table that uses it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@dataclass
class Groups(Kept):
    """API6: distances between motifs, linkage, groups and radii."""

    candidates: Candidates
    pairs: DataFrame
    merges: DataFrame
    groups: DataFrame
    radii: DataFrame  # grp, r
    overall: DataFrame  # r_all

    @property
    def r_all(self) -> float:
        return self.overall.first().r_all


def group_candidates(spark: SparkSession, found: Candidates, weights: Sequence[float] | None = None, motif_overlap: float = 0.6, k_knn: int = 3, votes_all: float = 0.5, votes_group: float = 0.5, r_all: float | None = None, radii: Sequence[float] | None = None) -> Groups:
    """API6, and with r_all or radii the choices that a person makes after API7.
    weights of the channels: those of the fits unless given."""
    weights = list(found.settings.first().weights) if weights is None else list(weights)
    values = [f"v{i}" for i in range(len(weights))]
    own = _flat(found.motif_points, len(weights))
    pairs = _rows(discovery.motif_pairs(found.motifs, own, motif_overlap, values, weights))
    if r_all is None:
        r_all = discovery.radius(found.distances.select("d", "p_clean"), k_knn, votes_all).first()[0]
        if r_all is None:
            raise ValueError("no radius keeps the share of votes; give r_all")
    merges, groups = discovery.linkage(spark, found.motifs, pairs, 2 * r_all)
    n = groups.agg(F.max("grp")).first()[0]
    if radii is not None:
        if len(radii) != n:
            raise ValueError(f"there are {n} groups")
        made = spark.createDataFrame([(i, float(r)) for i, r in enumerate(radii, 1)], "grp int, r double")
    elif found.motifs.count() == 1:
        made = spark.createDataFrame([(1, float(r_all))], "grp int, r double")
    else:
        by = found.distances.join(groups, "motif_id").select("grp", "d", "p_clean")
        made = _rows(discovery.radius(by, k_knn, votes_group, groups=["grp"]))
    return Groups(found, pairs, merges, groups, made, spark.createDataFrame([(float(r_all),)], "r_all double"))


@dataclass
class Found(Kept):
    motifs: DataFrame  # rank, motif_id, grp, length, frequency, mean_diss, r
    occurrences: DataFrame  # motif_id, curve_id, shift, diss


def search(spark: SparkSession, grouped: Groups, points: DataFrame, lengths: DataFrame, values: Sequence[str], weights: Sequence[float] | None = None, max_gap: float | None = None, use_real_occurrences: bool = False, length_diff: float = math.inf) -> Found:
    """API8: the best motifs of each group by the sum of ranks of frequency and
    mean distance, their occurrences in all curves, and their final order. By
    default groups are ranked by the curves within the radius; with
    use_real_occurrences all motifs are searched first. weights and max_gap: those
    of the fits unless given."""
    held = grouped.candidates.settings.first()
    weights = list(held.weights) if weights is None else list(weights)
    max_gap = held.max_gap if max_gap is None else max_gap
    names = [f"v{i}" for i in range(len(weights))]
    renamed = points.select("curve_id", "x", *(F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)))
    for n in names:
        renamed = renamed.where(F.col(n).isNotNull())
    heads = grouped.candidates.motifs.select("motif_id", "length", "c").join(grouped.groups, "motif_id").join(grouped.radii, "grp")
    heads = heads.withColumn("c_k", F.greatest("c", F.floor(F.col("length") * (1 - max_gap) + 1e-9).cast("int")))
    heads, own = _rows(heads), _flat(grouped.candidates.motif_points, len(weights))

    def occurrences(chosen: DataFrame) -> DataFrame:
        d = align.shift_distances(renamed, lengths, chosen, own, names, weights, contained=True, keys=["motif_id"])
        return discovery.occurrences(d, chosen.select("motif_id", "r"))

    if use_real_occurrences:
        hits = occurrences(heads)
        ranked = discovery.rank_sum(discovery.frequencies(hits).join(heads, "motif_id"), ["grp"])
        kept = _rows(discovery.diverse(ranked.select("motif_id", "grp", "rank", "length"), length_diff))
        hits = hits.join(kept.select("motif_id"), "motif_id")
    else:
        near = discovery.approximate_frequencies(grouped.candidates.distances.join(heads.select("motif_id", "r"), "motif_id"))
        ranked = discovery.rank_sum(near.join(heads, "motif_id"), ["grp"])
        kept = _rows(discovery.diverse(ranked.select("motif_id", "grp", "rank", "length"), length_diff))
        hits = occurrences(heads.join(kept.select("motif_id"), "motif_id"))
    final = discovery.rank_sum(discovery.frequencies(hits)).join(heads.select("motif_id", "grp", "length", "r"), "motif_id")
    return Found(final.select("rank", "motif_id", "grp", "length", "frequency", "mean_diss", "r"), hits)
