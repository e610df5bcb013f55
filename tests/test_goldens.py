"""Hand-checkable results (FIXTURES.md, section 4) of kernels and relational operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelens.functions import kernels
from wavelens.operators import align, curves, discovery, membership, metrics, motif, silhouette
from wavelens.options import FitOptions

N = None
ONE = np.ones(1)


def col(values):
    return np.array([[math.nan if v is N else float(v)] for v in values])


ALIGN = {  # curve, motif, least overlap -> shift, distance
    "G1": ([0, 1, 2, 3, 4], [1, 2], 2, 2, 0),
    "G2": ([5, 1, 2, 9], [0, 5, 1], 2, 0, 0),
    "G3": ([1, 2, N, 4, 1, 2, 3], [1, N, 3], 2, 5, 0),
    "G15": ([N, 4, N, 6, N], [4, 5, 7], 3, 2, 0.5),
    "G16": ([N, 4, N, N, 6, N], [4, 5, 7], 3, 2, 0),
}


def frames(spark, y, v, c_k):
    points = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(y, 1) if a is not N], "curve_id long, x int, y double")
    lengths = spark.createDataFrame([(1, len(y))], "curve_id long, len int")
    heads = spark.createDataFrame([(1, len(v), c_k)], "k int, length int, c_k int")
    own = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(v, 1) if a is not N], "k int, pos int, y double")
    return points, lengths, heads, own


@pytest.mark.parametrize("name", ALIGN)
def test_alignment_both_ways(spark, name):
    y, v, c_k, s, d = ALIGN[name]
    assert kernels.best_shift(col(y), col(v), c_k, ONE) == (s, d)
    row = align.align(*frames(spark, y, v, c_k)).first()
    assert (row.s, row.d) == (s, d)


def test_no_overlap_gives_null(spark):
    points, lengths, heads, own = frames(spark, [N, N, 1, N, N, N, N, N, N], [1, N, N, N, N, 2], 6)
    lone = points.where("x > 100")
    row = align.align(lone, lengths, heads, own).first()
    assert (row.s, row.d) == (None, None)
    assert math.isnan(kernels.best_shift(col([N, N, N]), col([1, 2]), 2, ONE)[1])


def test_centroid_and_trim(spark):
    points = spark.createDataFrame([(1, i, float(i)) for i in range(1, 5)] + [(2, i, 2.0 * i) for i in range(1, 4)], "curve_id long, x int, y double")
    heads = spark.createDataFrame([(1, 3)], "k int, length int")
    held = spark.createDataFrame([(1, 1, 1, 0.75), (2, 1, 2, 0.25)], "curve_id long, k int, s int, p double")
    got = [x.y for x in motif.centroid(points, held, heads).orderBy("pos").collect()]
    assert got == pytest.approx([1.428571, 2.571429, 3.0], abs=1e-6)
    center, header = motif.trimmed(motif.centroid(points, held.withColumn("s", F.lit(0)).withColumn("p", F.lit(0.5)), heads))
    assert [(x.pos, x.y) for x in center.orderBy("pos").collect()] == [(1, 1.5), (2, 3.0)]
    assert header.first().trim_left == 1


def test_membership(spark):
    d = spark.createDataFrame([(i, k, float(v)) for i, r in enumerate([(1, 3), (2, 2), (0, 5), (4, 1)], 1) for k, v in enumerate(r, 1)], "curve_id long, k int, d double")
    for m, want, j in ((2.0, [0.75, 0.25, 0.5, 0.5, 1, 0, 0.2, 0.8], 2.55), (3.0, [0.633975, 0.366025, 0.5, 0.5, 1, 0, 0.333333, 0.666667], 1.346368)):
        p = membership.fuzzy(d, m)
        assert [x.p for x in p.orderBy("curve_id", "k").collect()] == pytest.approx(want, abs=1e-6)
        assert membership.total_objective(p, m).first().j == pytest.approx(j, abs=1e-6)
    clean = membership.cleaned(membership.fuzzy(d), 0.5)
    assert [x.p_clean for x in clean.orderBy("curve_id", "k").collect()] == [1, 0, 0, 0, 1, 0, 0, 1]


def test_degenerate_motif_is_rescued(spark):
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (2, 1, 0.0), (2, 2, 2.0)], "curve_id long, k int, d double")
    p = {(x.curve_id, x.k): x.p for x in membership.rescued(membership.fuzzy(d)).collect()}
    assert p == {(1, 1): 1, (1, 2): 0, (2, 1): 1, (2, 2): 1}


def test_bhattacharyya(spark):
    old = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.1), (3, 1, 1.0), (3, 2, 0.0)], "curve_id long, k int, p double")
    new = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 0.5), (3, 1, 0.0), (3, 2, 1.0)], "curve_id long, k int, p double")
    assert [x.bc for x in membership.bhattacharyya(old, new).orderBy("curve_id").collect()] == pytest.approx([0, 0.11157178, math.inf], abs=1e-8)


def test_islands(spark):
    d = spark.createDataFrame([(1, 1, i, 5, 5, v) for i, v in enumerate([0.9, 0.2, 0.1, 0.3, 0.8, 0.1, 0.9, 0.2], 1)], "motif_id long, curve_id long, s int, c_k int, overlap long, diss double")
    got = [(x.shift, x.diss) for x in discovery.occurrences(d, 0.3).orderBy("shift").collect()]
    assert got == [(3, 0.1), (6, 0.1), (8, 0.2)]


def test_silhouette_means_without_pairs(spark):
    """Means from sums are those over all pairs, with gaps, lone pieces and two columns."""
    rng = random.Random(4)
    rows = [(r, k, c, pos, rng.uniform(-5, 5), rng.uniform(-5, 5)) for r in (1, 2) for k in (1, 2, 3) for c in range(1 if k == 3 else 12) for pos in range(1, 7) if rng.random() < 0.7]
    parts = spark.createDataFrame(rows, "run long, k int, curve_id long, pos int, y double, z double")
    for values in (("y",), ("y", "z")):
        pairs = silhouette.pair_distances(parts, values, ["run"]).groupBy("run", "ka", "a", "kb").agg(F.avg("d").alias("mean"))
        want = {tuple(x)[:4]: x.mean for x in pairs.collect()}
        got = {tuple(x)[:4]: x.mean for x in silhouette.mean_distances(parts, values, ["run"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_compat_forms(spark):
    """Q2: sums to other motifs by the size of the next one; Q4: zeros around a lone member."""
    place = {(1, 1): 0.0, (1, 2): 1.0, (2, 3): 10.0, (2, 4): 12.0, (2, 5): 11.0, (3, 6): 30.0}
    parts = spark.createDataFrame([(k, c, 1, y) for (k, c), y in place.items()], "k int, curve_id long, pos int, y double")
    got = {(x.k, x.curve_id): x.sil for x in silhouette.silhouette(silhouette.pair_distances(parts), parts.select("k", "curve_id"), compat=True).collect()}
    size = {1: 2, 2: 3, 3: 1}
    for (k, c), y in place.items():
        far = {o: sum((y - z) ** 2 for (m, i), z in place.items() if m == o and (m, i) != (k, c)) for o in size}
        b = min(far[o] for o in size if o != k) / size[k % 3 + 1]
        a = far[k] / (size[k] - 1) if size[k] > 1 else None
        assert got[k, c] == pytest.approx(0 if a is None else (b - a) / max(a, b))
    points = spark.createDataFrame([(1, x, float(x)) for x in range(1, 5)] + [(2, 1, 5.0)], "curve_id long, x int, y double")
    held = spark.createDataFrame([(1, 1, -1, 1.0), (1, 2, 1, 0.5), (2, 2, 1, 0.5)], "curve_id long, k int, s int, p double")
    heads = spark.createDataFrame([(1, 5), (2, 5)], "k int, length int")
    by = {(x.k, x.pos): x.y for x in motif.centroid(points, held, heads, compat=True).collect()}
    assert [by[1, i] for i in range(1, 6)] == [0.0, 0.0, 1.0, 2.0, 3.0] and (2, 5) not in by
    assert motif.centroid(points, held, heads).where("k = 1").count() == 3


def test_silhouette(spark):
    parts = spark.createDataFrame([(1, 1, 1, 0.0), (1, 2, 1, 1.0), (2, 3, 1, 10.0), (2, 4, 1, 12.0)], "k int, curve_id long, pos int, y double")
    d = silhouette.pair_distances(parts).withColumn("d", F.sqrt("d"))
    got = [x.sil for x in silhouette.silhouette(d, parts.select("k", "curve_id")).orderBy("curve_id").collect()]
    assert got == pytest.approx([0.909091, 0.9, 0.789474, 0.826087], abs=1e-6)
    lone = parts.where("k = 1")
    assert [x.sil for x in silhouette.silhouette(silhouette.pair_distances(lone), lone.select("k", "curve_id")).collect()] == [0, 0]


def test_radius(spark):
    train = spark.createDataFrame(list(zip([0.1, 0.2, 0.5, 0.4, 0.9, 1.0], [1, 1, 1, 0, 0, 0])), "d double, p_clean int")
    r = discovery.radius(train).first().r
    # on the grid between the extreme training distances
    grid = 0.1 + 0.9 / 9999 * np.arange(10000)
    d, p = np.array([0.1, 0.2, 0.5, 0.4, 0.9, 1.0]), np.array([1, 1, 1, 0, 0, 0])
    share = [p[np.abs(d - g) <= np.sort(np.abs(d - g))[2]].mean() for g in grid]
    assert r == pytest.approx(grid[np.flatnonzero(np.array(share) <= 0.5)[0]])
    apart = spark.createDataFrame([(0.1, 1), (0.3, 1), (0.5, 0)], "d double, p_clean int")
    assert discovery.radius(apart).first().r == 0.3


def test_standardize_and_cer(spark):
    p = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "curve_id long, x int, y double")
    assert sorted(x.y for x in curves.standardize(p, ["y"]).collect()) == [-100, 0, 100]
    a = spark.createDataFrame(list(enumerate([1, 1, 2, 2])), "curve_id long, label long")
    b = spark.createDataFrame(list(enumerate([1, 2, 2, 2])), "curve_id long, truth long")
    assert metrics.cer(a, b).first().cer == 0.5


def test_elongation_sizes(spark):
    heads = spark.createDataFrame([(1, 40, 60)], "k int, length int, c_max int")
    got = motif.elongations(heads, 0.5, 10).where("add_left = 0").orderBy("add_right").collect()
    assert [x.add_right for x in got] == [1, 3, 5, 7, 9, 12, 14, 16, 18, 20]


def test_intervals_and_repair(spark):
    p = spark.createDataFrame([(1, 1, 1.0, N), (1, 2, 2.0, 1.0), (1, 3, N, N), (1, 5, 1.0, 2.0), (1, 6, 1.0, 2.0)], "curve_id long, x int, a double, b double")
    fixed = curves.repair(p, ["a", "b"])
    assert [x.a for x in fixed.orderBy("x").collect()] == [N, 2.0, N, 1.0, 1.0]
    assert sorted((x.start, x.end, x.length) for x in curves.intervals(fixed, ["a", "b"]).collect()) == [(2, 2, 1), (5, 6, 2)]


def test_average_linkage():
    d = np.array([[0, 1, 6, 8], [1, 0, 4, 8], [6, 4, 0, 3], [8, 8, 3, 0]], float)
    merges = discovery.average_linkage([1, 2, 3, 4], d)
    assert merges == [(1, -1, -2, 1.0), (2, -3, -4, 3.0), (3, 1, 2, 6.5)]
    assert discovery.cut(4, merges, 4.0) == [1, 1, 2, 2]
    assert discovery.cut(1, [], 4.0) == [1]


def test_diverse(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 10), (2, 1, 2, 11), (3, 1, 3, 20), (4, 2, 1, 5)], "motif_id long, grp int, rank int, length int")
    assert sorted(x.motif_id for x in discovery.diverse(ranked).collect()) == [1, 4]
    assert sorted(x.motif_id for x in discovery.diverse(ranked, 0.5).collect()) == [1, 3, 4]


@pytest.mark.parametrize("wrong", [dict(K=0, c=5), dict(K=2, c=1), dict(K=2, c=[5, 5, 5]), dict(K=2, c=5, m=1), dict(K=2, c=5, distance="x"), dict(K=2, c=5, stop_criterion="x"), dict(K=2, c=5, w=-1), dict(K=2, c=5, quantile4clean=2), dict(K=2, c=5, stop_criterion="quantile")])
def test_wrong_options(wrong):
    with pytest.raises(ValueError):
        FitOptions(**wrong).checked(10)


def test_repaired_options():
    with pytest.warns(UserWarning):
        assert FitOptions(2, 5, distance="d0_d1_L2", alpha=7).checked(10).alpha == 0.5
    assert FitOptions(2, 5, distance="d0_d1_L2", alpha=0).checked(10).distance == "d0_L2"
    assert FitOptions(2, 5, distance="d0_d1_L2", alpha=0.25).checked(10).channel_weights(1) == [0.75, 0.25]
