"""Probabilistic local clustering: fuzzy K-means with alignment (API1, IT0-IT8).

All runs of a grid advance together. The state is one row per curve: for every
run and motif, shift, membership and distance. The curves' points are written
once. Both tables are bucketed by curve, so that an iteration joins them where
they lie, and only the small state is written anew, to the shared folder, which
cuts lineage; the state before the last one is deleted. A motif is as small as
its length, so motifs live on the driver; every step over the curves is one map
job whose partial sums are added up by a grouped aggregate."""

from __future__ import annotations

import math
import time
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import curves as algebra
from ..options import FitOptions
from ..session import shared_folder, ship


def run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/fit-{uuid.uuid4().hex[:12]}"


@dataclass
class Run:
    """One fit of the grid: options, current motifs, and its traces."""

    run_id: int
    options: FitOptions
    motifs: list[np.ndarray] = field(default_factory=list)
    lefts: list[int] = field(default_factory=list)  # trims of this iteration
    iterations: list[tuple[int, float, float]] = field(default_factory=list)
    bc: float = math.inf
    status: str = "running"
    began: float = 0.0
    seconds: float = 0.0

    def c_k(self, k: int) -> int:
        return max(self.options.c[k], math.floor(len(self.motifs[k]) * (1 - self.options.max_gap) + 1e-9))


@dataclass
class Fit:
    """Results of all runs: small tables of motifs, traces and memberships."""

    motif_points: DataFrame  # run_id, k, cleaned, pos, ch (null: gap); levels then derivatives, for d1_L2 derivatives then levels
    membership: DataFrame  # run_id, curve_id, k, s, d, p, s_clean, d_clean, p_clean
    iterations: DataFrame  # run_id, iter, j, bc_dist
    runs: DataFrame  # run_id, clusters, c, status, iter, seconds
    curves: DataFrame  # curve_id, len, y (packed)
    channels: int
    weights: list[float]


def _y(blob: bytes, channels: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, channels)


def pack_curves(points: DataFrame, lengths: DataFrame, values: Sequence[str]) -> DataFrame:
    """(curve_id, len, y): y has the curve's points by channel in one blob, NaN
    where missing. A curve is one row: it must fit in a task, as any curve does."""
    held = points.groupBy("curve_id").agg(F.collect_list(F.struct("x", F.array(*(F.col(v).cast("double") for v in values)).alias("v"))).alias("pts"))
    both = lengths.join(held, "curve_id", "left").select("curve_id", "len", "pts")
    width = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, pts in zip(batch.column("len").to_pylist(), batch.column("pts").to_pylist(), strict=True):
                y = np.full((n, width), np.nan)
                for pt in pts or ():
                    if 1 <= pt["x"] <= n and all(v is not None for v in pt["v"]):
                        y[pt["x"] - 1] = pt["v"]
                out.append(y.tobytes())
            yield pa.record_batch([batch.column("curve_id"), batch.column("len"), pa.array(out, pa.binary())], names=["curve_id", "len", "y"])

    return both.mapInArrow(run, "curve_id long, len int, y binary")


_STATE = "curve_id long, state array<struct<run_id:long,k:int,s:int,d:double,p:double,keep:boolean>>, bc array<struct<run_id:long,bc:double>>"
#: Bins of the first pass of a quantile.
_BINS = 1000


def _rows(batch: pa.RecordBatch, channels: int):
    for row in batch.to_pylist():
        yield row, _y(row["y"], channels)


def _batch(rows: list[dict], batch: pa.RecordBatch) -> pa.RecordBatch:
    state = pa.list_(pa.struct([("run_id", pa.int64()), ("k", pa.int32()), ("s", pa.int32()), ("d", pa.float64()), ("p", pa.float64()), ("keep", pa.bool_())]))
    bc = pa.list_(pa.struct([("run_id", pa.int64()), ("bc", pa.float64())]))
    return pa.record_batch([batch.column("curve_id"), pa.array([r["state"] for r in rows], state), pa.array([r["bc"] for r in rows], bc)], names=["curve_id", "state", "bc"])


def _uniform(*numbers: int) -> float:
    return sum(n * q for n, q in zip(numbers, (7919, 104729, 15485863, 1299709), strict=False)) % 1000003 / 1000003


def _initial(runs: list[tuple[int, FitOptions]], channels: int, given: dict[int, dict[int, tuple[list[float], list[int]]]]):
    """SF9, SF10: memberships uniform on the simplex and starts in places with
    enough points (a curve without any: with the most), both from hashes of
    (curve, motif, seed); or the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, y in _rows(batch, channels):
                there, state = ~np.isnan(y[:, 0]), []
                for run_id, o in runs:
                    p, s = given.get(run_id, {}).get(row["curve_id"], (None, None))
                    if p is None:
                        cuts = sorted(_uniform(row["curve_id"], k, 0, o.seed) for k in range(1, o.K))
                        p = np.diff([0.0, *cuts, 1.0]).tolist()
                    # A given start must have a whole window of points.
                    if s is None or any(np.isnan(kernels.window(y, s[k], o.c[k])[:, 0]).any() for k in range(o.K)):
                        s = []
                        for k in range(o.K):
                            held = np.convolve(there, np.ones(o.c[k]), "valid") if len(there) >= o.c[k] else np.zeros(0)
                            starts = np.flatnonzero(held == held.max(initial=1)) + 1
                            s.append(int(min(starts, key=lambda x: (_uniform(row["curve_id"], k + 1, int(x), o.seed), x))) if len(starts) else 1)
                    state += [{"run_id": run_id, "k": k + 1, "s": int(s[k]), "d": None, "p": float(p[k]), "keep": True} for k in range(o.K)]
                out.append({"state": state, "bc": []})
            yield _batch(out, batch)

    return run


def _stepped(runs, channels: int, weights: np.ndarray):
    """IT5, IT6: alignment of every curve with every motif, new memberships, and
    their distance from the old ones. runs: (run_id, m, c_k of each, motifs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, active = [], {x[0] for x in runs.value}
            for row, y in _rows(batch, channels):
                old = {(x["run_id"], x["k"]): x["p"] for x in row["state"]}
                state, bc = [x for x in row["state"] if x["run_id"] not in active], []  # the others are done
                for run_id, m, least, motifs in runs.value:
                    found = [kernels.best_shift(y, v, c, weights) for v, c in zip(motifs, least, strict=True)]
                    d = np.array([x[1] for x in found])
                    p = kernels.fuzzy(d, m)
                    overlap = sum(math.sqrt(old[run_id, k + 1] * p[k]) for k in range(len(p)))
                    # A curve without a point has no membership that could settle.
                    bc.append({"run_id": run_id, "bc": -math.log(overlap) if overlap > 0 else math.inf if p.any() else None})
                    state += [{"run_id": run_id, "k": k + 1, "s": s, "d": None if math.isnan(dk) else dk, "p": float(p[k]), "keep": True} for k, (s, dk) in enumerate(found)]
                out.append({"state": state, "bc": bc})
            yield _batch(out, batch)

    return run


def _summed(requests, channels: int, m: dict[int, float]):
    """IT3, IT4: partial sums of centers. requests: run_id, k -> (request,
    left shift, domain); one row per request and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row, y in _rows(batch, channels):
                for x in row["state"]:
                    for request, left, inside in requests.value.get((x["run_id"], x["k"]), ()):
                        got = kernels.contribution(y, x["s"] - left, x["p"], m[x["run_id"]], inside)
                        if got:
                            have = sums.get(request)
                            sums[request] = got if have is None else (have[0] + got[0], have[1] + got[1])
        ids = list(sums)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([np.concatenate([sums[i][0], sums[i][1][:, None]], 1).reshape(-1).tolist() for i in ids], pa.list_(pa.float64()))], names=["request", "v"])

    return run


def _judged(requests, channels: int, weights: np.ndarray, m: dict[int, float], room: dict[int, int]):
    """AG7: objectives of candidate motifs, and their least overlap with kept
    curves that have `room` points in a row (others never overlap enough)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row, y in _rows(batch, channels):
                longest = kernels.longest_run(y)
                for x in row["state"]:
                    for request, left, v in requests.value.get((x["run_id"], x["k"]), ()):
                        d, n = kernels.distance_at(y, v, x["s"] - left, weights)
                        have = sums.setdefault(request, [0.0, 1 << 30])
                        if not math.isnan(d):
                            have[0] += d * x["p"] ** m[x["run_id"]]
                        if x["keep"] and longest >= room[x["run_id"]]:
                            have[1] = min(have[1], n)
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["request", "j", "least"])

    return run


def pooled_quantiles(values: DataFrame, quantiles: dict[int, float]) -> dict[int, float]:
    """run_id -> its quantile (linear between two ranks) of (run_id, d), nulls
    left out. Two passes: counts in equal bins, then the values of the one or two
    bins that hold the ranks, sorted; no task holds a run's values."""
    known = values.where("d is not null")
    span = known.groupBy("run_id").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    span = {x.run_id: x for x in span.collect()}  # one a run
    if not span:
        return {}
    of = lambda name: F.element_at(F.create_map(*[F.lit(v) for x in span.values() for v in (x.run_id, float(x[name]))]), F.col("run_id"))
    bins = F.least(F.lit(_BINS - 1), F.floor((F.col("d") - of("low")) / F.greatest(F.lit(1e-300), of("high") - of("low")) * _BINS))
    binned = known.withColumn("bin", bins.cast("int"))
    counts: dict[int, np.ndarray] = {r: np.zeros(_BINS, np.int64) for r in span}
    for x in binned.groupBy("run_id", "bin").count().collect():  # _BINS a run
        counts[x.run_id][x.bin] = x["count"]
    wanted, ranks = [], {}
    for r, x in span.items():
        at = (x.n - 1) * quantiles[r]
        low, high, upto = math.floor(at), math.ceil(at), np.cumsum(counts[r])
        first, last = (int(np.searchsorted(upto, k, "right")) for k in (low, high))
        before = int(upto[first] - counts[r][first])
        ranks[r] = (at - low, low - before, first, high - int(upto[last] - counts[r][last]), last)
        wanted += [(r, first), (r, last)]
    chosen = F.create_map(*[F.lit(v) for r, b in set(wanted) for v in (f"{r}:{b}", True)])
    place = F.row_number().over(Window.partitionBy("run_id", "bin").orderBy("d")) - 1
    ordered = binned.where(F.coalesce(chosen[F.concat_ws(":", "run_id", "bin")], F.lit(False))).withColumn("place", place)
    exact = {f"{r}:{b}:{k}" for r, (_, k1, b1, k2, b2) in ranks.items() for k, b in ((k1, b1), (k2, b2))}
    found = {(x.run_id, x.bin, x.place): x.d for x in ordered.where(F.concat_ws(":", "run_id", "bin", "place").isin(list(exact))).collect()}
    out = {}
    for r, (part, k1, b1, k2, b2) in ranks.items():
        low, high = found[r, b1, k1], found[r, b2, k2]
        out[r] = low + part * (high - low) if high != low else low
    return out


class Fitter:
    def __init__(self, spark: SparkSession, curves: DataFrame, channels: int, weights: Sequence[float], runs: list[Run], given=None):
        ship(spark)
        self.spark, self.channels, self.weights, self.runs = spark, channels, np.array(weights, float), runs
        self.root, self.turn = run_folder(spark), 0
        self.tables: list[tuple[str, str]] = []
        known = [(r.run_id, r.options) for r in runs]
        for r in runs:
            r.began = time.perf_counter()
            r.motifs = [np.zeros((r.options.c[k], channels)) for k in range(r.options.K)]
        self.curves = self._write(curves)
        self.tables.clear()  # the curves stay
        self.state = self._write(self.curves.mapInArrow(_initial(known, channels, given or {}), _STATE))

    def _write(self, df: DataFrame) -> DataFrame:
        """The frame as a table bucketed by curve; joins of two such tables move nothing."""
        self.turn += 1
        path, table = f"{self.root}/{self.turn}", f"wavelens_fit_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, "curve_id").option("path", path).saveAsTable(table)
        self.tables.append((table, path))
        return self.spark.table(table)

    def _forget(self, keep: int) -> None:
        """Delete all but the last `keep` tables of the state."""
        old, self.tables = self.tables[: len(self.tables) - keep], self.tables[len(self.tables) - keep :]
        for table, path in old:
            self.spark.sql(f"DROP TABLE {table}")
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _with_points(self, state: DataFrame) -> DataFrame:
        return state.join(self.curves.hint("merge"), "curve_id")

    def _m(self) -> dict[int, float]:
        return {r.run_id: r.options.m for r in self.runs}

    def _flat(self) -> DataFrame:
        return self.state.select("curve_id", F.explode("state").alias("x")).select("curve_id", "x.*")

    def centers(self, state: DataFrame, wanted: list[tuple[Run, int, int, np.ndarray]]) -> list[np.ndarray | None]:
        """Weighted centers for (run, motif place, left, domain); NaN where no
        member covers a position, None without any member there."""
        by: dict[tuple[int, int], list] = {}
        for i, (r, k, left, inside) in enumerate(wanted):
            by.setdefault((r.run_id, k + 1), []).append((i, left, inside))
        sent = self.spark.sparkContext.broadcast(by)
        parts = self._with_points(state).mapInArrow(_summed(sent, self.channels, self._m()), "request long, v array<double>")
        total = parts.select("request", F.posexplode("v").alias("at", "x")).groupBy("request", "at").agg(F.sum("x").alias("x"))
        rows = total.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("request", F.col("v.x").alias("v")).collect()
        out: list[np.ndarray | None] = [None] * len(wanted)
        for row in rows:
            v = np.array(row.v).reshape(-1, self.channels + 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[row.request] = np.where(v[:, -1:] > 0, v[:, :-1] / v[:, -1:], np.nan)
        return out

    def objectives(self, state: DataFrame, wanted: list[tuple[Run, int, int, np.ndarray]]) -> list[tuple[float, int]]:
        by: dict[tuple[int, int], list] = {}
        for i, (r, k, left, v) in enumerate(wanted):
            by.setdefault((r.run_id, k + 1), []).append((i, left, v))
        sent = self.spark.sparkContext.broadcast(by)
        room = {r.run_id: max(r.options.c) for r in self.runs}
        parts = self._with_points(state).mapInArrow(_judged(sent, self.channels, self.weights, self._m(), room), "request long, j double, least long")
        found = {x.request: (x.j, x.least) for x in parts.groupBy("request").agg(F.sum("j").alias("j"), F.min("least").alias("least")).collect()}
        return [found.get(i, (0.0, 0)) for i in range(len(wanted))]

    def masked(self, quantiles: dict[int, float], into: str) -> DataFrame:
        """FI6, FI7: the state with `into` (p or keep) set for distances below a
        pooled quantile of the run, and for the nearest curve of an empty motif."""
        flat = self._flat().where(F.col("run_id").isin(list(quantiles)))
        cuts = pooled_quantiles(flat.select("run_id", "d"), quantiles)
        cut = F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv])
        near = flat.groupBy("run_id", "k").agg(F.min("d").alias("low"), F.min(F.when(F.col("d").isNotNull(), F.struct("d", "curve_id"))).alias("b")).collect()
        alone = {(x.run_id, x.k): x.b.curve_id for x in near if x.b is not None and not x.low < cuts[x.run_id]}
        one = F.create_map(*[F.lit(v) for (r, k), i in alone.items() for v in (f"{r}:{k}", i)]) if alone else None

        def change(x):
            hit = F.coalesce(x["d"] < cut[x["run_id"]], F.lit(False))
            if one is not None:
                hit = hit | F.coalesce(one[F.concat_ws(":", x["run_id"], x["k"])] == F.col("curve_id"), F.lit(False))
            mine = x["run_id"].isin(list(cuts))
            p = F.when(mine, hit.cast("double")).otherwise(x["p"]) if into == "p" else x["p"]
            keep = F.when(mine, hit).otherwise(x["keep"]) if into == "keep" else x["keep"]
            return F.struct(x["run_id"].alias("run_id"), x["k"].alias("k"), x["s"].alias("s"), x["d"].alias("d"), p.alias("p"), keep.alias("keep"))

        return self.state.withColumn("state", F.transform("state", change))

    def moved(self, state: DataFrame, lefts: dict[tuple[int, int], int]) -> DataFrame:
        """Shifts after motifs lost (or gained) positions on the left."""
        lefts = {k: v for k, v in lefts.items() if v}
        if not lefts:
            return state
        by = F.create_map(*[F.lit(v) for (r, k), n in lefts.items() for v in (f"{r}:{k}", n)])
        return state.withColumn("state", F.transform("state", lambda x: F.struct(x["run_id"].alias("run_id"), x["k"].alias("k"), (x["s"] + F.coalesce(by[F.concat_ws(":", x["run_id"], x["k"])], F.lit(0))).cast("int").alias("s"), x["d"].alias("d"), x["p"].alias("p"), x["keep"].alias("keep"))))

    # -- one iteration of all active runs -----------------------------------
    def iterate(self, active: list[Run]) -> None:
        cleaning = {r.run_id: r.options.quantile4clean for r in active if len(r.iterations) and (len(r.iterations) + 1) % r.options.iter4clean == 0 and r.bc < r.options.tol4clean}
        state = self.masked(cleaning, "p") if cleaning else self.state
        wanted = [(r, k, 0, ~np.isnan(v[:, 0])) for r in active for k, v in enumerate(r.motifs)]
        lefts: dict[tuple[int, int], int] = {}
        for (r, k, _, _), v in zip(wanted, self.centers(state, wanted), strict=True):
            if v is None:
                raise ValueError(f"motif {k + 1} of run {r.run_id} has no member")
            r.motifs[k], lefts[r.run_id, k + 1] = kernels.trim(v)
        growing = [r for r in active if len(r.iterations) and (len(r.iterations) + 1) % r.options.iter4elong == 0 and r.bc < r.options.tol4elong]
        if growing:
            state = self._write(self.moved(state, lefts))
            self._elongate(state, growing)
        sent = self.spark.sparkContext.broadcast([(r.run_id, r.options.m, [r.c_k(k) for k in range(r.options.K)], r.motifs) for r in active])
        # Old memberships are those before cleaning.
        self.state = self._write(self._with_points(self.state).mapInArrow(_stepped(sent, self.channels, self.weights), _STATE))
        js = self._rescue()
        quantiles = sorted({r.options.quantile for r in active if r.options.stop_criterion == "quantile"})
        exact = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x.bc)").alias(f"q{i}") for i, q in enumerate(quantiles)]
        bc = self.state.select(F.explode("bc").alias("x")).groupBy("x.run_id")
        stats = {x.run_id: x for x in bc.agg(F.max("x.bc").alias("max"), F.avg("x.bc").alias("mean"), *exact).collect()}
        self._forget(1)
        for r in active:
            how = r.options.stop_criterion
            r.bc = stats[r.run_id][how if how != "quantile" else f"q{quantiles.index(r.options.quantile)}"]
            r.iterations.append((len(r.iterations) + 1, js[r.run_id], r.bc))
            if r.bc <= r.options.tol or len(r.iterations) >= r.options.iter_max:
                r.status = "converged" if r.bc <= r.options.tol else "iter_max"
                r.seconds = time.perf_counter() - r.began
                if r.status == "iter_max":
                    warnings.warn(f"run {r.run_id} reached iter_max", stacklevel=2)

    def _rescue(self) -> dict[int, float]:
        """AG8, AG10: objectives of the runs; a motif without a member gets the nearest curve first."""
        m = F.create_map(*[F.lit(v) for r in self.runs for v in (r.run_id, float(r.options.m))])
        near = F.min(F.when(F.col("d").isNotNull(), F.struct("d", "curve_id"))).alias("b")
        flat = self._flat().groupBy("run_id", "k").agg(F.sum("p").alias("p"), F.sum(F.col("d") * F.pow("p", m[F.col("run_id")])).alias("j"), near)
        rows = flat.collect()  # one a motif
        empty = {f"{x.run_id}:{x.k}": x.b.curve_id for x in rows if x.p == 0 and x.b is not None}
        if not empty:
            out: dict[int, float] = {}
            for x in rows:
                out[x.run_id] = out.get(x.run_id, 0.0) + (x.j or 0.0)
            return out
        for x in rows:
            if f"{x.run_id}:{x.k}" in empty:
                warnings.warn(f"motif {x.k} of run {x.run_id} has no member; it gets curve {x.b.curve_id}", stacklevel=2)
        one = F.create_map(*[F.lit(v) for kv in empty.items() for v in kv])

        def change(x):
            mine = F.coalesce(one[F.concat_ws(":", x["run_id"], x["k"])] == F.col("curve_id"), F.lit(False))
            p = F.when(mine, F.lit(1.0)).otherwise(x["p"]).alias("p")
            return F.struct(x["run_id"].alias("run_id"), x["k"].alias("k"), x["s"].alias("s"), x["d"].alias("d"), p, x["keep"].alias("keep"))

        self.state = self._write(self.state.withColumn("state", F.transform("state", change)))
        return self._rescue()

    def _elongate(self, state: DataFrame, growing: list[Run]) -> None:
        """IT4: gaps are filled and motifs grow where the objective rises little."""
        gaps = [(r, k, 0, np.ones(len(v), bool)) for r in growing for k, v in enumerate(r.motifs) if np.isnan(v[:, 0]).any()]
        if gaps:
            filled = self.centers(state, gaps)
            both = [(r, k, 0, r.motifs[k]) for r, k, _, _ in gaps] + [(r, k, 0, v) for (r, k, _, _), v in zip(gaps, filled, strict=True)]
            js = self.objectives(state, both)
            for i, (r, k, _, _) in enumerate(gaps):
                before, after = js[i][0], js[len(gaps) + i][0]
                if before > 0 and (after - before) / before < r.options.deltaJk_elong:
                    r.motifs[k] = filled[i]
        wanted = []
        for r in growing:
            for k, v in enumerate(r.motifs):
                most = int(min(math.floor(len(v) * r.options.max_elong), r.options.c_max[k] - len(v)))
                n = r.options.trials_elong
                sizes = list(range(1, most + 1)) if most <= n else [round(1 + i * (most - 1) / max(1, n - 1)) for i in range(n)]
                sizes = sorted({0, *sizes}) if most >= 1 else [0]
                inside = ~np.isnan(v[:, 0])
                wanted += [(r, k, a, np.concatenate([np.ones(a, bool), inside, np.ones(b, bool)])) for a in sizes for b in sizes if 0 < a + b <= sizes[-1]]
        if not wanted:
            return
        grown = self.centers(state, wanted)
        tried = [(w, v) for w, v in zip(wanted, grown, strict=True) if v is not None and not np.isnan(v[0, 0])]
        tried = [((r, k, a, inside), kernels.trim(v)[0]) for (r, k, a, inside), v in tried]
        kept = self._keeping(state, {r.run_id: 0.25 for r in growing})
        before = [(r, k, 0, v) for r in growing for k, v in enumerate(r.motifs)]
        js = self.objectives(kept, before + [(r, k, a, v) for (r, k, a, _), v in tried])
        base = {(r.run_id, k): j for (r, k, _, _), (j, _) in zip(before, js, strict=False)}
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for i, ((r, k, a, _), v) in enumerate(tried):
            j, least = js[len(before) + i]
            c_k = max(r.options.c[k], math.floor(len(v) * (1 - r.options.max_gap) + 1e-9))
            j0 = base[r.run_id, k]
            if least < c_k or not j0 > 0:
                continue
            rel = (j - j0) / j0
            if rel < r.options.deltaJk_elong and rel < best.get((r.run_id, k), (math.inf, 0))[0]:
                best[r.run_id, k] = (rel, i)
        for _, i in best.values():
            (r, k, _, _), v = tried[i]
            r.motifs[k] = v

    def _keeping(self, state: DataFrame, quantiles: dict[int, float]) -> DataFrame:
        held, self.state = self.state, state
        try:
            return self.masked(quantiles, "keep")
        finally:
            self.state = held

    # -- results -------------------------------------------------------------
    def finish(self) -> Fit:
        """IT8: centers of the last memberships, cleaned memberships, centers and distances."""
        wanted = [(r, k, 0, ~np.isnan(v[:, 0])) for r in self.runs for k, v in enumerate(r.motifs)]
        raw, clean_left, raw_left = {}, {}, {}
        for (r, k, _, _), v in zip(wanted, self.centers(self.state, wanted), strict=True):
            raw[r.run_id, k + 1], raw_left[r.run_id, k + 1] = kernels.trim(v)
        masked = self._write(self.masked({r.run_id: r.options.quantile4clean for r in self.runs}, "p"))
        clean = {}
        for (r, k, _, _), v in zip(wanted, self.centers(masked, wanted), strict=True):
            clean[r.run_id, k + 1], clean_left[r.run_id, k + 1] = kernels.trim(v)
        sent, channels, weights = self.spark.sparkContext.broadcast((clean, clean_left, raw_left)), self.channels, self.weights

        def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            motifs, lefts, _ = sent.value
            names = ["run_id", "curve_id", "k", "s_clean", "d_clean", "p_clean"]
            for batch in batches:
                out: list[list] = [[] for _ in names]
                for row, y in _rows(batch, channels):
                    for x in row["state"]:
                        at = (x["run_id"], x["k"])
                        s = x["s"] + lefts[at]
                        d, _ = kernels.distance_at(y, motifs[at], s, weights)
                        for c, v in zip(out, (x["run_id"], row["curve_id"], x["k"], s, None if math.isnan(d) else d, int(x["p"])), strict=True):
                            c.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()), strict=True)], names=names)

        cleaned = self._with_points(masked).mapInArrow(distances, "run_id long, curve_id long, k int, s_clean int, d_clean double, p_clean int")
        flat = self.moved(self.state, raw_left).select("curve_id", F.explode("state").alias("x")).select("x.run_id", "curve_id", "x.k", "x.s", "x.d", "x.p")
        membership = self._write(flat.join(cleaned, ["run_id", "curve_id", "k"]))
        self.tables.pop()  # a result
        self._forget(0)
        points = [(r, k, c, i + 1, None if np.isnan(row[0]) else row.tolist()) for c, table in ((False, raw), (True, clean)) for (r, k), v in table.items() for i, row in enumerate(v)]
        make = self.spark.createDataFrame
        return Fit(
            make(points, "run_id long, k int, cleaned boolean, pos int, ch array<double>"),
            membership,
            make([(r.run_id, *x) for r in self.runs for x in r.iterations], "run_id long, iter int, j double, bc_dist double"),
            make([(r.run_id, r.options.K, r.options.c[0], r.status, len(r.iterations), r.seconds) for r in self.runs], "run_id long, clusters int, c int, status string, iter int, seconds double"),
            self.curves,
            self.channels,
            self.weights.tolist(),
        )


def checked_start(given: dict[int, dict[int, tuple[list[float], list[int]]]], many: Sequence[FitOptions]) -> dict[int, dict[int, tuple[list[float] | None, list[int]]]]:
    """Given memberships that are no memberships (range, sums of curves, a motif
    without any) are replaced by hashed ones for the run, with a warning."""
    out = {}
    for run_id, rows in given.items():
        k = many[run_id - 1].K
        right = all(len(p) == k and min(p) >= 0 and max(p) <= 1 and abs(sum(p) - 1) <= 1e-9 for p, _ in rows.values())
        right = right and all(any(p[i] > 0 for p, _ in rows.values()) for i in range(k))
        if not right:
            warnings.warn(f"the memberships given for run {run_id} are not valid; hashed ones are used", stacklevel=3)
        if any(len(s) != k for _, s in rows.values()):
            warnings.warn(f"the shifts given for run {run_id} are not valid; hashed ones are used", stacklevel=3)
            rows = {}
        out[run_id] = {i: (p if right else None, s) for i, (p, s) in rows.items()}
    return out


def fit(spark: SparkSession, points: DataFrame, lengths: DataFrame, options: FitOptions | Sequence[FitOptions], levels: Sequence[str] = ("y",), derivatives: Sequence[str] = (), given: dict[int, dict[int, tuple[list[float], list[int]]]] | None = None) -> Fit:
    """API1: fit all options (one run each, numbered from 1) on the curves.

    points: curve_id, x and value columns, null or no row where missing; lengths:
    curve_id, len; rows without an id belong to no curve. Runs share distance,
    alpha and weights. given: memberships and shifts of curves to start from, per
    run; others, and starts without a whole window of points, are made from hashes
    of the seed. Curves without room for a shortest motif: see short_curves."""
    many = [options] if isinstance(options, FitOptions) else list(options)
    # Arrow batches hold the very types: ids may come as int, lengths as long.
    points, lengths = (df.withColumn("curve_id", F.col("curve_id").cast("long")).where("curve_id is not null") for df in (points, lengths))
    lengths = lengths.withColumn("len", F.col("len").cast("int"))
    n = lengths.count()
    many = [o.checked(n, len(levels)) for o in many]
    first = many[0]
    if any((o.distance, o.alpha, o.w) != (first.distance, first.alpha, first.w) for o in many):
        raise ValueError("runs of one call share distance, alpha and w")
    if first.distance != "d0_L2" and len(derivatives) != len(levels):
        raise ValueError("this distance needs a derivative for each level")
    # A fit by derivatives carries the levels along with weight 0, for their centers.
    values = {"d0_L2": list(levels), "d1_L2": [*derivatives, *levels]}.get(first.distance, [*levels, *derivatives])
    if first.standardize:
        points = algebra.standardize(points, list(levels), list(derivatives))
    runs = [Run(i, o) for i, o in enumerate(many, 1)]
    points = algebra.repair(points, values)
    weights = first.channel_weights(len(levels))
    weights += [0.0] * (len(values) - len(weights))
    fitter = Fitter(spark, pack_curves(points, lengths, values), len(values), weights, runs, checked_start(given or {}, many))
    most = algebra.intervals(points, values).groupBy("curve_id").agg(F.max("length").alias("longest")).groupBy("longest").agg(F.count("*").alias("n"))
    have = {x.longest: x.n for x in most.collect()}  # a row a length
    for r in runs:
        need = max(r.options.c)
        longest = min((x for x in have if x >= need), default=0)  # of the curves with room
        if short := sum(n for x, n in have.items() if x < need):
            if not longest or r.options.short_curves == "refuse":
                raise ValueError('every curve needs room for the shortest motif (short_curves="overlap" lays others where they overlap most)')
            warnings.warn(f"{short} curves have no room for a motif of {need} points; they lie where they overlap most", stacklevel=2)
        elif not longest:
            raise ValueError("every curve needs room for the shortest motif")
        cap = math.floor((1 + r.options.max_gap) * longest + 1e-9)
        if any(c != math.inf and c > cap for c in r.options.c_max):
            warnings.warn(f"c_max is over what the curves allow; {cap} is used", stacklevel=2)
        r.options = replace(r.options, c_max=tuple(min(c, cap) for c in r.options.c_max))
    while active := [r for r in runs if r.status == "running"]:
        fitter.iterate(active)
    return fitter.finish()
