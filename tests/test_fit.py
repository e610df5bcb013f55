"""Fits: one iteration against the relational operators, monotone objective,
recovery of planted motifs, and the whole discovery."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.functions import kernels
from wavelens.operators import align, membership, motif
from wavelens.operators import curves as algebra
from wavelens.options import FitOptions
from wavelens.plans import discovery, plotdata
from wavelens.plans.fit import Fit, checked_start, fit, pooled_quantiles


def planted(n=12, length=60, size=15, seed=3):
    """Curves of noise; the first half has one motif, the second another."""
    rng, out = np.random.default_rng(seed), []
    a, b = 10 * np.sin(np.arange(size)), 10 * np.cos(np.arange(size) / 2)
    for i in range(n):
        y = rng.normal(0, 0.2, length) + rng.normal(0, 3, length).cumsum() * 0.3
        at = int(rng.integers(0, length - size))
        y[at : at + size] = (a if i < n // 2 else b) + rng.normal(0, 0.1, size)
        out.append((i, at + 1, y))
    return out


def frames(spark, curves):
    points = spark.createDataFrame([(i, x, float(v)) for i, _, y in curves for x, v in enumerate(y, 1)], "curve_id long, x int, y double").cache()
    return points, points.groupBy("curve_id").agg(F.max("x").alias("len"))


def test_one_iteration_agrees_with_operators(spark):
    curves = planted()
    points, lengths = frames(spark, curves)
    points = points.where("not (curve_id = 3 and x between 20 and 24)")
    p0 = {i: ([0.3 + 0.02 * i, 0.7 - 0.02 * i], [i + 1, 2 * i + 2 if i != 3 else 30]) for i, _, _ in curves}
    with pytest.warns(UserWarning):
        got = fit(spark, points, lengths, FitOptions(2, 15, iter_max=1, max_gap=0.2), given={1: p0})
    rows = [(i, k + 1, s[k], p[k]) for i, (p, s) in p0.items() for k in range(2)]
    held = spark.createDataFrame(rows, "curve_id long, k int, s int, p double")
    heads = spark.createDataFrame([(1, 15), (2, 15)], "k int, length int")
    center, header = motif.trimmed(motif.centroid(points, held, heads))
    heads = header.select("k", "length", F.greatest(F.lit(15), F.floor(F.col("length") * 0.8)).cast("int").alias("c_k"))
    want = membership.rescued(membership.fuzzy(align.align(points, lengths, heads, center)))
    want = {(x.curve_id, x.k): (x.d, x.p) for x in want.collect()}
    for x in got.membership.collect():
        assert (x.d, x.p) == pytest.approx(want[x.curve_id, x.k])
    assert got.iterations.first().j == pytest.approx(sum(d * p * p for d, p in want.values()))


@pytest.mark.filterwarnings("ignore:run 1 reached iter_max")
def test_ids_and_lengths_of_other_types(spark):
    """Ids may be ints, lengths longs; points without an id are of no curve."""
    points, lengths = frames(spark, planted(n=6, length=40, size=10))
    key = lambda x: (x.curve_id, x.k)
    made = []
    for id_type, len_type in (("long", "int"), ("int", "long")):
        p = points.select(F.col("curve_id").cast(id_type).alias("curve_id"), "x", "y")
        n = lengths.select(F.col("curve_id").cast(id_type).alias("curve_id"), F.col("len").cast(len_type).alias("len"))
        if made:
            p = p.unionByName(p.where("curve_id = 0").withColumn("curve_id", F.lit(None).cast(id_type)))
            n = n.unionByName(n.where("curve_id = 0").withColumn("curve_id", F.lit(None).cast(id_type)))
        got = fit(spark, p, n, FitOptions(2, 10, c_max=10, max_gap=0, iter_max=1)).membership.collect()
        made.append([(*key(x), x.s, pytest.approx(x.d), pytest.approx(x.p)) for x in sorted(got, key=key)])
    assert len(made[0]) == 12 and made[0] == [(*x[:3], x[3].expected, x[4].expected) for x in made[1]]


@pytest.mark.filterwarnings("ignore:.* reached iter_max", "ignore:.*no room for a motif")
def test_curves_without_room_overlap(spark):
    """Curves without c points in a row are an error, or lie where they overlap most; one without a point stops nothing."""
    curves = planted(n=8, length=40, size=10)
    points, lengths = frames(spark, curves)
    points = points.where("curve_id <> 5 and not (curve_id = 2 and x % 10 = 0) and not (curve_id = 6 and x > 7)")
    lengths = lengths.withColumn("len", F.when(F.col("curve_id") == 6, 7).otherwise(F.col("len")))
    with pytest.raises(ValueError, match="room"):
        fit(spark, points, lengths, FitOptions(2, 10, c_max=14, iter_max=1))
    result = fit(spark, points, lengths, FitOptions(2, 10, c_max=14, iter_max=6, tol=1e-3, iter4elong=2, tol4elong=1e3, deltaJk_elong=10, iter4clean=1000, short_curves="overlap"))
    rows = {(x.curve_id, x.k): x for x in result.membership.collect()}
    assert len(rows) == 16 and all((x.d is None) == (x.curve_id == 5) for x in rows.values())
    assert all(sum(rows[i, k].p for k in (1, 2)) == pytest.approx(0.0 if i == 5 else 1.0) for i in range(8))
    assert math.isfinite(result.iterations.agg(F.max("bc_dist")).first()[0])
    # The nine points in a row don't hold back the motifs, which grow as far as the others allow.
    assert result.motif_points.where("not cleaned").agg(F.max("pos")).first()[0] > 10


def test_settings_of_folders_from_before_short_curves():
    kept = discovery._settings(FitOptions(2, 10, short_curves="overlap"), ["y"], [], False)
    assert "short_curves" in kept and "short_curves" not in discovery._settings(FitOptions(2, 10), ["y"], [], False)


def test_longest_run_and_short_curves():
    y = np.array([np.nan, 1, 2, np.nan, 3, 4, 5, np.nan])[:, None]
    assert [kernels.longest_run(v) for v in (y, y[:3], y[:1], y[:0], y[4:7])] == [3, 2, 0, 0, 3]
    # Three points within a motif of five: the best of its three places.
    assert kernels.best_shift(np.array([[3.0], [4], [5]]), np.arange(1.0, 6)[:, None], 5, np.ones(1)) == (-1, 0.0)


@pytest.mark.filterwarnings("ignore:.* reached iter_max", "ignore:.*no room for a motif", "ignore:c_max is over")
@pytest.mark.parametrize("name", ["fixpoint_fit", "motif_discovery_pipeline"])
def test_users_without_five_days_in_a_row(spark, tmp_path, name):
    """Larger tables have users without room for a motif of the query: all users stay in."""
    from wavelens import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("not (user_id = 3 and dayofmonth(ts) % 5 = 0)").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()[name](spark, str(tmp_path))
    if name == "fixpoint_fit":
        assert got.count() == 2 * events.select("user_id").distinct().count() and got.where("d is null").count() == 0
    else:
        assert got.count() >= 1


def test_planted_motifs_are_found(spark):
    curves = planted()
    points, lengths = frames(spark, curves)
    options = [FitOptions(2, 15, c_max=15, max_gap=0, iter_max=30, tol=1e-4, iter4clean=1000, seed=s) for s in (1, 2)]
    near = {i: ([0.8, 0.2] if i < 6 else [0.2, 0.8], [max(1, at - i % 3)] * 2) for i, at, _ in curves}
    result = fit(spark, points, lengths, options, given={1: near})  # the other run starts from hashes
    last = {}
    for x in result.iterations.orderBy("run_id", "iter").collect():
        if x.run_id in last:
            assert x.j <= last[x.run_id] * (1 + 1e-9)  # falls as long as nothing is cleaned or grown
        last[x.run_id] = x.j
    best = min(last, key=last.get)
    rows = result.membership.where(f"run_id = {best}").collect()
    label = {i: max((x for x in rows if x.curve_id == i), key=lambda x: x.p) for i, _, _ in curves}
    first = label[0].k
    assert all((label[i].k == first) == (i < 6) for i in label)
    assert sum(abs(label[i].s - at) <= 1 for i, at, _ in curves) >= 10
    assert all(sum(x.p for x in rows if x.curve_id == i) == pytest.approx(1) for i in label)


def test_wrong_starts_are_replaced():
    many = [FitOptions(2, 5), FitOptions(2, 5)]
    with pytest.warns(UserWarning):
        got = checked_start({1: {1: ([0.9, 0.3], [1, 1])}, 2: {1: ([0.5, 0.5], [1, 1])}}, many)
    assert got == {1: {1: (None, [1, 1])}, 2: {1: ([0.5, 0.5], [1, 1])}}
    with pytest.warns(UserWarning):
        assert checked_start({1: {1: ([1.0, 0.0], [1, 1]), 2: ([1.0, 0.0], [1, 1])}}, many)[1][1][0] is None


def test_motifs_grow(spark):
    curves = planted(n=8, size=20, seed=5)
    points, lengths = frames(spark, curves)
    given = {1: {i: ([1.0, 0.0] if i < 4 else [0.0, 1.0], [at + 4, at + 4]) for i, at, _ in curves}}
    result = fit(spark, points, lengths, FitOptions(2, 10, c_max=20, max_gap=0, iter_max=6, tol=1e-12, iter4elong=2, tol4elong=1.0, deltaJk_elong=0.5), given=given)
    assert result.motif_points.where("not cleaned").groupBy("k").agg(F.max("pos").alias("n")).agg(F.max("n")).first()[0] > 10


def test_discovery_end_to_end(spark, tmp_path):
    curves = planted()
    points, lengths = frames(spark, curves)
    options = FitOptions(2, 15, c_max=15, max_gap=0, iter_max=15, tol=1e-3, iter4clean=1000)
    grid = discovery.find_candidates(spark, points, lengths, [2], [15], 3, f"file://{tmp_path}/grid", options, max_restarts=0)
    assert grid.table("runs").count() == 3
    before = grid.table("runs").agg(F.sum("seconds")).first()[0]
    again = discovery.find_candidates(spark, points, lengths, [2], [15], 3, f"file://{tmp_path}/grid", options)
    assert again.table("runs").agg(F.sum("seconds")).first()[0] == before  # nothing was run again
    with pytest.warns(UserWarning, match="all are used"):
        found = discovery.filter_candidates(grid, -1.0, 1, K=[7], converged=False)
    found.save(f"file://{tmp_path}/found")
    found = discovery.Candidates.load(spark, f"file://{tmp_path}/found")
    grouped = discovery.group_candidates(spark, found, r_all=3.0)  # weights of the grid
    grouped.save(f"file://{tmp_path}/grouped")
    grouped = discovery.Groups.load(spark, f"file://{tmp_path}/grouped")
    assert grouped.r_all == 3.0
    with pytest.raises(ValueError, match="other options"):
        discovery.find_candidates(spark, points, lengths, [2], [15], 3, f"file://{tmp_path}/grid", FitOptions(2, 15, c_max=15, max_gap=0.1))
    opened = discovery.open_grid(spark, f"file://{tmp_path}/grid")
    assert (opened.K, opened.c, opened.weights, opened.options.max_gap, opened.options.tol) == ([2], [15], [1.0], 0, 1e-3)
    assert grouped.groups.agg(F.max("grp")).first()[0] >= 1
    for real in (False, True):
        result = discovery.search(spark, grouped, points, lengths, ["y"], use_real_occurrences=real)
        ranks = [x["rank"] for x in result.motifs.orderBy("rank").collect()]
        assert ranks == list(range(1, len(ranks) + 1))
        top = result.motifs.where("rank = 1").first()
        assert top.frequency == result.occurrences.where(F.col("motif_id") == top.motif_id).count()
    result.save(f"file://{tmp_path}/result")
    assert discovery.Found.load(spark, f"file://{tmp_path}/result").motifs.count() == result.motifs.count()
    assert plotdata.found_segments(result, points).count() > 0
    assert plotdata.run_silhouettes(grid).count() == 3 and plotdata.run_lengths(grid).count() == 6
    assert plotdata.dendrogram(grouped).columns[-1] == "cut" and plotdata.group_alignment(grouped).count() == found.motifs.count()
    assert plotdata.frequency_scatter(grouped).count() > 0 and plotdata.distance_bins(grouped, 1.0).count() > 0
    with pytest.raises(ValueError):
        discovery.filter_candidates(grid, 1.0, 1000)
    with pytest.raises(ValueError):
        plotdata.found_motifs(result, 10_000)


def test_interrupted_grid(spark, tmp_path, monkeypatch):
    """A write that fails after any table leaves nothing double behind; runs at
    iter_max start again, and then give no candidates."""
    curves = planted(n=6, length=40, size=10)
    points, lengths = frames(spark, curves)
    options = FitOptions(2, 10, c_max=10, max_gap=0, iter_max=2, tol=1e-12, iter4clean=1000)
    real, calls = discovery.source.write_run, []

    def failing(df, path):
        real(df, path)
        calls.append(path)
        if len(calls) in stops:
            raise OSError("stopped")

    monkeypatch.setattr(discovery.source, "write_run", failing)
    again = lambda: discovery.find_candidates(spark, points, lengths, [2], [10], 1, f"file://{tmp_path}/my grid", options, max_restarts=1)
    stops = {2, 7}  # after the second table, then after the fifth
    for _ in stops:
        with pytest.raises(OSError):
            again()
    grid = again()
    assert grid.folder.endswith("/my_grid") and len(calls) == 2 + 5 + 6
    assert grid.table("runs").first().restarts == 1 and grid.table("membership").count() == 12
    assert grid.table("motifs").count() == 2 and grid.table("motif_points").where("cleaned").count() <= 20
    assert grid.table("silhouettes").groupBy("k", "curve_id").count().where("count > 1").count() == 0
    with pytest.raises(ValueError, match="no motif"):
        discovery.filter_candidates(grid, -1.0, 1)
    assert discovery.filter_candidates(grid, -1.0, 1, converged=False).motifs.count() >= 1
    with pytest.raises(ValueError):
        discovery.find_candidates(spark, points, lengths, [2], [10], 0, f"file://{tmp_path}/x", options)


def test_silhouettes_of_many_pieces_make_no_pairs(spark, monkeypatch):
    """Means of blocks are those of the pairs, with gaps, copies, motifs of two lengths and empty blocks."""
    rng = np.random.default_rng(4)
    rows = []
    for run_id, k, length, n in ((1, 1, 9, 23), (1, 2, 6, 17), (2, 1, 7, 1), (2, 2, 7, 12)):
        for i in range(n):
            y = 1e5 + rng.normal(0, 1 + k, (length, 2))
            y[rng.random(length) < (0.4 if i % 3 == 0 else 0)] = np.nan
            y[:] = np.nan if i == 5 else y
            rows += [(run_id, k, 2 * i + c, y.tobytes()) for c in ((0, 1) if i % 4 == 0 else (0,))]
    parts = spark.createDataFrame(rows, "run_id long, k int, curve_id long, y binary")
    result = Fit(None, None, None, spark.createDataFrame([(1, 5), (2, 6)], "run_id long, c int"), None, 2, [0.75, 0.25])
    key = lambda x: (x.run_id, x.ka, x.a, x.kb)
    for contained in (False, True):
        pairs = discovery.piece_distances(parts, result, contained).groupBy("run_id", "ka", "a", "kb").agg(F.avg("d").alias("mean")).where("mean is not null")
        want = {key(x): x["mean"] for x in pairs.collect()}
        for block in (8192, 5, 1):
            monkeypatch.setattr(discovery, "_BLOCK", block)
            monkeypatch.setattr(kernels, "_TILE", 7)
            got = {key(x): x["mean"] for x in discovery.mean_piece_distances(parts, result, contained).collect()}
            assert want and got == pytest.approx(want, rel=1e-9)
    # Twenty thousand pieces of a motif are two hundred million pairs.
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("run_id"), (F.col("id") % 2 + 1).cast("int").alias("k"), F.col("id").alias("curve_id"), F.lit(np.arange(12.0).tobytes()).alias("y"))
    monkeypatch.undo()
    met = discovery.mean_piece_distances(many, result)
    assert met.agg(F.count("*"), F.sum("mean")).first() == (40_000, 0.0)


def test_derivative_fit_has_level_centers(spark):
    """A fit by derivatives gives the centers of the levels under the same shifts and memberships."""
    curves = planted(n=8, length=40, size=10)
    points, lengths = frames(spark, curves)
    points = algebra.domain(algebra.derivative(points), ["dy"]).cache()
    result = fit(spark, points, lengths, FitOptions(2, 10, c_max=10, max_gap=0, iter_max=3, distance="d1_L2", iter4clean=1000), derivatives=["dy"])
    assert result.weights == [1.0, 0.0]
    held = result.membership.select("curve_id", "k", "s", "p")
    heads = result.motif_points.where("not cleaned").groupBy("k").agg(F.max("pos").alias("length"))
    for channel, value in ((0, "dy"), (1, "y")):
        want = {(x.k, x.pos): x.v for x in motif.centroid(points, held, heads, values=[value]).withColumnRenamed(value, "v").collect()}
        got = {(x.k, x.pos): x.ch[channel] for x in result.motif_points.where("not cleaned and ch is not null").collect()}
        assert got and all(v == pytest.approx(want[at]) for at, v in got.items())


def test_pooled_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {1: rng.normal(0, 1, 3001), 2: np.repeat([1.0, 2.0, 5.0], [5, 1, 7]), 3: np.array([4.0]), 4: rng.pareto(1, 500) ** 3}
    rows = [(r, float(v)) for r, vs in values.items() for v in vs] + [(1, None)]
    df = spark.createDataFrame(rows, "run_id long, d double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = pooled_quantiles(df, {r: q for r in values})
        assert all(got[r] == pytest.approx(np.quantile(values[r], q)) for r in values)


def test_many_motif_points_take_blocks(spark, monkeypatch):
    """Beyond the broadcast limit the alignment goes by blocks, with equal results."""
    points, lengths = frames(spark, planted(n=6))
    heads = spark.createDataFrame([(k, 12, 9) for k in range(1, 6)], "k int, length int, c_k int")
    own = spark.createDataFrame([(k, i, float(k * i % 7)) for k in range(1, 6) for i in range(1, 13)], "k int, pos int, y double")
    key = lambda x: (x.curve_id, x.k)
    want = sorted(align.align(points, lengths, heads, own).collect(), key=key)
    monkeypatch.setattr(align, "BROADCAST_ROWS", 7)
    met = align.align(points, lengths, heads, own)
    assert "CartesianProduct" not in met._jdf.queryExecution().toString()
    assert [tuple(x)[:3] + (pytest.approx(x.d), x.overlap) for x in want] == [tuple(x) for x in sorted(met.collect(), key=key)]


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    from wavelens.operators import discovery as ops
    from wavelens.streaming.matcher import match

    curves = planted(n=4)
    points, lengths = frames(spark, curves)
    points = points.where("x % 17 <> 0")
    v = [float(x) for x in curves[0][2][curves[0][1] - 1 : curves[0][1] + 14]]
    for part in range(3):
        points.where(f"x > {part * 20} and x <= {part * 20 + 20}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = match(stream, [(1, v, 12, 20.0)]).writeStream.format("memory").queryName("hits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    heads = spark.createDataFrame([(1, 15, 12)], "motif_id long, length int, c_k int")
    own = spark.createDataFrame([(1, i, x) for i, x in enumerate(v, 1)], "motif_id long, pos int, y double")
    d = align.shift_distances(points, lengths, heads, own, contained=True, keys=["motif_id"])
    want = {(x.curve_id, x.shift) for x in ops.occurrences(d, 20.0).collect()}
    got = {(x.curve_id, x["shift"]) for x in spark.table("hits").collect()}
    assert got <= want and (0, curves[0][1]) in want
    assert all(not math.isnan(x.diss) for x in spark.table("hits").collect())
