"""Registered queries of the curve operators on the driver's tables; their SQL
is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .operators import align, curves, discovery, membership, metrics, motif, silhouette
from .options import FitOptions
from .plans import discovery as plan
from .plans import plotdata
from .plans.fit import Fit, fit, run_folder
from .sources import curves as source

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The motifs of these queries: users and first days, 7 days each, at least 5 of which overlap.
USERS, DAYS, LENGTH, LEAST = (0, 1, 2), (10, 5, 15), 7, 5


def query(f):
    _QUERIES[f.__name__] = f
    return f


class EvDay:
    """The daily curves, three motifs cut out of them, and what follows from both."""

    def __init__(self, spark: SparkSession, sf: str, least: int = LEAST):
        self.spark = spark
        self.points = source.ev_day(spark, sf)
        self.lengths = self.points.select("curve_id").distinct().withColumn("len", F.lit(30))
        self.motifs = spark.createDataFrame([(k, LENGTH, least) for k in (1, 2, 3)], "k int, length int, c_k int")
        cuts = F.broadcast(spark.createDataFrame([(k, u, d) for k, (u, d) in enumerate(zip(USERS, DAYS, strict=True), 1)], "k int, curve_id long, d int"))
        pos = (F.col("x") - F.col("d") + 1).alias("pos")
        self.motif_points = self.points.join(cuts, "curve_id").where((F.col("x") >= F.col("d")) & (F.col("x") < F.col("d") + LENGTH)).select("k", pos, "y")

    def with_derivative(self) -> EvDay:
        cuts = F.broadcast(self.spark.createDataFrame([(k, u, d) for k, (u, d) in enumerate(zip(USERS, DAYS, strict=True), 1)], "k int, curve_id long, d int"))
        self.points = curves.domain(curves.derivative(self.points), ["dy"])
        self.motif_points = self.points.join(cuts, "curve_id").where((F.col("x") >= F.col("d")) & (F.col("x") < F.col("d") + LENGTH)).select("k", (F.col("x") - F.col("d") + 1).alias("pos"), "y", "dy")
        return self

    def aligned(self, **options) -> DataFrame:
        return align.align(self.points, self.lengths, self.motifs, self.motif_points, rows=3 * LENGTH, **options)

    def fuzzy(self, m: float = 2.0) -> DataFrame:
        return membership.rescued(membership.fuzzy(self.aligned(), m))

    def cleaned(self, q: float = 0.25) -> DataFrame:
        return membership.cleaned(self.fuzzy(), q)

    def initial(self) -> DataFrame:
        """Hash-made memberships and shifts of two motifs."""
        ids = self.lengths.select("curve_id")
        return membership.initial_membership(ids, 2).join(membership.initial_shift(curves.intervals(self.points), (LENGTH, LENGTH)), ["curve_id", "k"])

    def two(self) -> DataFrame:
        return self.motifs.where("k <= 2")

    def pieces(self) -> DataFrame:
        held = self.cleaned().where("p_clean = 1").select("curve_id", "k", "s")
        pos = (F.col("x") - F.col("s") + 1).cast("int")
        return self.points.join(held, "curve_id").withColumn("pos", pos).where(f"pos between 1 and {LENGTH}").select("k", "curve_id", "pos", "y")


# -- curve algebra -----------------------------------------------------------
@query
def curve_intervals(spark, sf):
    return curves.intervals(source.ev_day(spark, sf))


@query
def curve_feasible_length(spark, sf):
    ints = curves.intervals(source.ev_day(spark, sf))
    return curves.shortest_longest(ints).crossJoin(curves.feasible(ints, LENGTH).agg(F.count("*").alias("n")))


@query
def curve_na_repair(spark, sf):
    p = source.li_month(spark, sf).withColumn("y", F.when(F.col("y") % 7 != 0, F.col("y"))).withColumn("n", F.when(F.col("n") % 5 != 0, F.col("n")))
    return curves.repair(p, ["y", "n"])


@query
def curve_standardize(spark, sf):
    return curves.standardize(source.ev_day(spark, sf), ["y"]).select("curve_id", "x", F.round("y", 6).alias("y"))


@query
def curve_derivative(spark, sf):
    return curves.derivative(source.ev_day(spark, sf))


@query
def curve_rescale(spark, sf):
    return curves.rescale(source.ev_day(spark, sf), ["y"], 100000)


@query
def curve_packed(spark, sf):
    ev = EvDay(spark, sf)
    return source.packed(ev.points, ev.lengths).select("curve_id", "len", F.concat_ws(",", F.transform("y", lambda v: F.coalesce(v.cast("string"), F.lit("-")))).alias("y"))


@query
def curve_unpacked(spark, sf):
    return source.emb(spark, sf).select("curve_id", F.col("x").cast("int").alias("x"), F.col("y").cast("double").alias("y"))


@query
def curve_wide_to_long(spark, sf):
    """Daily counts of each event type, as one column a type and back."""
    types = ["click", "error", "purchase", "signup", "view"]
    x = (F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    days = source.table(spark, sf, "events").groupBy(F.col("event_type").alias("curve_id"), x.alias("x")).agg(F.count("*").alias("y"))
    return source.from_wide(source.to_wide(days, types), "x", types).where("y is not null")


@query
def curve_joined_tables(spark, sf):
    return source.ord_month(spark, sf)


# -- alignment -----------------------------------------------------------------
@query
def shift_window_padded(spark, sf):
    ev = EvDay(spark, sf)
    return align.windows(ev.points, ev.lengths.select("curve_id", (F.col("curve_id") % 30 - 3).cast("int").alias("s")), LENGTH)


@query
def shift_window_cropped(spark, sf):
    ev = EvDay(spark, sf)
    return align.crop(ev.points, ev.lengths.select("curve_id", (F.col("curve_id") % 30 - 3).cast("int").alias("s")), LENGTH)


@query
def align_min_shift_d0(spark, sf):
    return EvDay(spark, sf).aligned().select("curve_id", "k", "s", "d", "overlap")


@query
def align_min_shift_d1(spark, sf):
    return EvDay(spark, sf).with_derivative().aligned(values=["dy"]).select("curve_id", "k", "s", "d", "overlap")


@query
def align_sobolev(spark, sf):
    return EvDay(spark, sf).with_derivative().aligned(values=["y", "dy"], weights=[0.5, 0.5]).select("curve_id", "k", "s", "d", "overlap")


@query
def align_weighted_d2(spark, sf):
    p = source.li_month(spark, sf)
    lengths = p.select("curve_id").distinct().withColumn("len", F.lit(83))
    heads = spark.createDataFrame([(1, 12, 10)], "k int, length int, c_k int")
    own = p.where("curve_id = 1 and x between 20 and 31").select(F.lit(1).alias("k"), (F.col("x") - 19).alias("pos"), "y", "n")
    return align.align(p, lengths, heads, own, values=["y", "n"], weights=[0.5, 1.0], rows=12).select("curve_id", "k", "s", "d", "overlap")


@query
def align_fallback_overlap(spark, sf):
    """No shift overlaps in more points than the motif has: the most overlap counts."""
    ev = EvDay(spark, sf, least=LENGTH + 1)
    return ev.aligned().select("curve_id", "k", "s", "d", "overlap")


@query
def contained_min_shift(spark, sf):
    return EvDay(spark, sf).aligned(contained=True).select("curve_id", "k", "s", "d", "overlap")


@query
def fixed_shift_diss(spark, sf):
    ev = EvDay(spark, sf)
    shifts = ev.lengths.crossJoin(F.broadcast(ev.motifs.select("k"))).select("curve_id", "k", (F.col("curve_id") % 10 + F.col("k")).cast("int").alias("s"))
    return align.fixed_shift(ev.points, ev.motif_points, shifts)


@query
def cross_dissimilarity_matrix(spark, sf):
    return EvDay(spark, sf).aligned().groupBy("curve_id").pivot("k", [1, 2, 3]).agg(F.first("d")).toDF("curve_id", "d1", "d2", "d3")


# -- centers -----------------------------------------------------------------
@query
def motif_centroid(spark, sf):
    ev = EvDay(spark, sf)
    return motif.centroid(ev.points, ev.initial(), ev.two()).select("k", "pos", F.round("y", 3).alias("y"))


@query
def motif_centroid_trim(spark, sf):
    ev = EvDay(spark, sf)
    # Every member starts two or more places before its curve does.
    late = ev.initial().withColumn("s", (-1 - F.col("s") % 3).cast("int"))
    center, header = motif.trimmed(motif.centroid(ev.points, late, ev.two()))
    return center.join(header, "k").select("k", "pos", F.round("y", 3).alias("y"), "length", "trim_left")


@query
def motif_objective_jk(spark, sf):
    ev = EvDay(spark, sf)
    out = motif.objective(ev.points, ev.initial(), ev.motif_points.where("k <= 2"))
    return out.select("k", F.round(F.col("j") / 1e6, 3).alias("j"), "least_kept")


@query
def elongation_grid(spark, sf):
    heads = spark.createDataFrame([(1, 7, 10), (2, 20, 50), (3, 7, 7), (4, 30, 71)], "k int, length int, c_max int")
    return motif.elongations(heads, 0.5, 4)


@query
def elongation_choice(spark, sf):
    """Elongations of one motif of the months' curves, judged on one pass over all candidates."""
    p = source.li_month(spark, sf).select("curve_id", "x", "y")
    heads = spark.createDataFrame([(1, 8, 14)], "k int, length int, c_max int")
    tried = motif.elongations(heads, 1.0, 3)
    before = p.select("curve_id").distinct().select("curve_id", F.lit(1).alias("k"), F.lit(20).alias("s"), F.lit(1.0).alias("p"))

    def judged(members, heads, keys):
        center = motif.centroid(p, members, heads, keys=keys)
        return motif.objective(p, members, center, keys=keys)

    j0 = judged(before, heads, ["k"]).select("k", F.col("j").alias("j_before"))
    cand = tried.withColumnRenamed("new_length", "length")
    keys = ["k", "add_left", "add_right"]
    members = before.join(F.broadcast(cand), "k").withColumn("s", F.col("s") - F.col("add_left"))
    after = judged(members, cand, keys).withColumnRenamed("j", "j_after").join(j0, "k").join(cand, keys)
    best = motif.best_elongation(after.withColumn("feasible", F.col("least_kept") >= F.floor(F.col("length") * 0.8)), 10.0)
    return best.select("k", F.round("rel", 6).alias("rel"), "add_left", "add_right")


# -- memberships ----------------------------------------------------------------
@query
def membership_fuzzy_m2(spark, sf):
    return EvDay(spark, sf).fuzzy().select("curve_id", "k", F.round("p", 6).alias("p"))


@query
def membership_fuzzy_m3(spark, sf):
    return EvDay(spark, sf).fuzzy(3.0).select("curve_id", "k", F.round("p", 6).alias("p"))


@query
def membership_zero_distance(spark, sf):
    return membership.fuzzy(EvDay(spark, sf).aligned()).where("p = 1.0").select("curve_id", "k", "d", "p")


@query
def bhattacharyya_distance(spark, sf):
    ev = EvDay(spark, sf)
    old = membership.initial_membership(ev.lengths.select("curve_id"), 3)
    return membership.bhattacharyya(old, ev.fuzzy()).select("curve_id", F.round("bc", 6).alias("bc"))


@query
def convergence_statistics(spark, sf):
    ev = EvDay(spark, sf)
    bc = membership.bhattacharyya(membership.initial_membership(ev.lengths.select("curve_id"), 3), ev.fuzzy())
    stats = [membership.convergence(bc, how, 0.5).select(F.lit(how).alias("how"), F.round("bc_dist", 6).alias("bc_dist")) for how in ("max", "mean", "quantile")]
    return stats[0].unionByName(stats[1]).unionByName(stats[2])


@query
def objective_j(spark, sf):
    return membership.total_objective(EvDay(spark, sf).fuzzy()).select(F.round(F.col("j") / 1e6, 3).alias("j"))


@query
def clean_by_quantile(spark, sf):
    return EvDay(spark, sf).cleaned().select("curve_id", "k", "p_clean")


@query
def init_membership(spark, sf):
    return membership.initial_membership(EvDay(spark, sf).lengths.select("curve_id"), 3).select("curve_id", "k", F.round("p", 9).alias("p"))


@query
def init_shift(spark, sf):
    return membership.initial_shift(curves.intervals(source.ev_day(spark, sf)), (7, 5))


@query
def one_iteration(spark, sf):
    """Centers of the initial memberships, trimmed; alignment with them; new memberships."""
    ev = EvDay(spark, sf)
    center, header = motif.trimmed(motif.centroid(ev.points, ev.initial(), ev.two()))
    heads = header.select("k", "length", F.lit(LEAST).alias("c_k"))
    d = align.align(ev.points, ev.lengths, heads, center, rows=2 * LENGTH)
    out = membership.rescued(membership.fuzzy(d))
    return out.select("curve_id", "k", "s", F.round("d", 2).alias("d"), F.round("p", 6).alias("p"))


# -- labels and agreement -------------------------------------------------------
@query
def hard_labels(spark, sf):
    return metrics.hard_labels(EvDay(spark, sf).fuzzy()).select("curve_id", F.col("label").cast("long").alias("label"))


@query
def clean_labels(spark, sf):
    return metrics.clean_labels(EvDay(spark, sf).cleaned()).select("curve_id", F.col("label").cast("long").alias("label"))


@query
def crisp_memberships(spark, sf):
    return metrics.crisp(EvDay(spark, sf).fuzzy()).select("curve_id", "k", "p_clean")


@query
def label_bands(spark, sf):
    return metrics.bands(EvDay(spark, sf).fuzzy())


@query
def assigned_shift(spark, sf):
    m = EvDay(spark, sf).fuzzy()
    return metrics.assigned_shift(m, metrics.hard_labels(m)).select("curve_id", F.col("label").cast("long").alias("label"), "s")


def _labels(spark, sf):
    e = source.table(spark, sf, "embeddings")
    made = e.select(F.col("vec_id").alias("curve_id"), (F.when(F.col("embedding")[0] > 0, 1).otherwise(0) + F.when(F.col("embedding")[1] > 0, 2).otherwise(0)).cast("long").alias("label"))
    return made, e.select(F.col("vec_id").alias("curve_id"), F.col("label").cast("long").alias("truth"))


@query
def contingency(spark, sf):
    return metrics.contingency(*_labels(spark, sf))


@query
def cer(spark, sf):
    return metrics.cer(*_labels(spark, sf)).select(F.round("cer", 9).alias("cer"))


@query
def cluster_mean_curve(spark, sf):
    ev = EvDay(spark, sf)
    m = ev.fuzzy()
    shifts = metrics.assigned_shift(m, metrics.hard_labels(m))
    return metrics.mean_curve(align.windows(ev.points, shifts.select("curve_id", "s"), LENGTH), shifts.select("curve_id", "label")).select(F.col("label").cast("long").alias("label"), "pos", F.round("mean_y", 3).alias("mean_y"), "n")


@query
def median_shift(spark, sf):
    m = EvDay(spark, sf).fuzzy()
    return metrics.median_shift(metrics.assigned_shift(m, metrics.hard_labels(m))).select(F.col("label").cast("long").alias("label"), "median_shift")


@query
def distance_histogram(spark, sf):
    return metrics.histogram(EvDay(spark, sf).aligned(), "d", 5e6, ("k",))


@query
def distance_density(spark, sf):
    grid = spark.range(0, 21).select((F.col("id") * 2e6).alias("g"))
    return metrics.density(EvDay(spark, sf).aligned(), "d", grid, 1.5e6).select("g", F.round(F.col("density") * 1e9, 6).alias("density"))


@query
def distance_quantiles(spark, sf):
    return metrics.five_numbers(EvDay(spark, sf).aligned(), "d", ("k",)).select("k", *(F.round(c, 3).alias(c) for c in ("low", "q1", "mid", "q3", "high")), "n")


# -- silhouette ------------------------------------------------------------------
def _sil(spark, sf):
    ev = EvDay(spark, sf)
    pieces = ev.pieces()
    return silhouette.from_means(silhouette.mean_distances(pieces), pieces.select("k", "curve_id").distinct())


@query
def silhouette_pieces(spark, sf):
    return _sil(spark, sf).select("k", "curve_id", F.round("sil", 6).alias("sil"))


@query
def silhouette_average(spark, sf):
    return silhouette.average(_sil(spark, sf)).select("k", F.round("avg_sil", 6).alias("avg_sil"), "size")


# -- runs and candidates ---------------------------------------------------------
def _runs(spark, sf):
    """Made-up results of runs: one motif per (region, nation, supplier) group."""
    s = source.table(spark, sf, "supplier")
    K, c, init = (F.col("s_nationkey") % 2 + 2).cast("int"), F.element_at(F.array(F.lit(61), F.lit(51), F.lit(41)), (F.col("s_suppkey") % 3 + 1).cast("int")), (F.floor(F.col("s_suppkey") / 6) % 10 + 1).cast("int")
    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    out = s.select(K.alias("clusters"), c.alias("c"), init.alias("init"), F.col("s_suppkey").alias("k"), (c + F.pmod(cents, F.lit(20)).cast("int")).alias("length"), (F.pmod(cents, F.lit(2000)) / 1000.0 - 1).alias("avg_sil"), F.pmod(cents, F.lit(9)).alias("size"), F.pmod(cents, F.lit(97)).cast("int").alias("iter"))
    return out


@query
def run_grid(spark, sf):
    return source.run_grid(spark, (2, 3), (61, 51, 41), 10)


@query
def run_resume_antijoin(spark, sf):
    return source.pending(source.run_grid(spark, (2, 3), (61, 51, 41), 10), _runs(spark, sf))


@query
def candidate_filter(spark, sf):
    return discovery.candidates(_runs(spark, sf), 0.5, 2).select("motif_id", "clusters", "c", "init", F.col("k").alias("motif"), "length", "avg_sil", "size")


@query
def candidate_subset(spark, sf):
    return discovery.candidates(_runs(spark, sf), 0.0, 2, K=[2], c=[61, 41]).select("motif_id", "clusters", "c", "init", F.col("k").alias("motif"), "length")


@query
def run_summary(spark, sf):
    out = silhouette.run_summary(_runs(spark, sf), ["clusters", "c", "init"])
    return metrics.ordered_runs(out, "mean_sil").select("clusters", "c", "init", F.round("mean_sil", 9).alias("mean_sil"), F.round("sd_sil", 9).alias("sd_sil"), "ord")


@query
def best_restart(spark, sf):
    its = _runs(spark, sf).select("clusters", "c", "init", "iter", F.col("avg_sil").alias("j"))
    return metrics.best_restart(its)


@query
def motif_length_summary(spark, sf):
    r = _runs(spark, sf).withColumn("pct", metrics.percent_of_least(F.col("length"), F.col("c")))
    return r.groupBy("clusters", "c", "init").agg(F.min("length").alias("low"), F.max("length").alias("high"), F.round(F.avg("pct"), 6).alias("pct"), F.count("*").alias("n"))


# -- groups, radii, search ---------------------------------------------------------
def _many(spark, sf, n=12):
    """Motifs of different lengths, cut out of the first curves."""
    p = source.ev_day(spark, sf)
    cuts = spark.range(n).select(F.col("id").alias("curve_id"), (F.col("id") + 1).alias("motif_id"), (F.col("id") * 5 % 17 + 1).cast("int").alias("d"), (F.lit(6) + F.col("id") % 4).cast("int").alias("length"))
    own = p.join(F.broadcast(cuts), "curve_id").where("x >= d and x < d + length").select("motif_id", (F.col("x") - F.col("d") + 1).alias("pos"), "y")
    return p, cuts.select("motif_id", "length"), own


@query
def motif_pair_distance(spark, sf):
    _, heads, own = _many(spark, sf)
    return discovery.motif_pairs(heads, own)


@query
def radius_separable(spark, sf):
    d = EvDay(spark, sf).aligned().withColumn("p_clean", (F.col("d") < 2e6).cast("int"))
    return discovery.radius(d.select("d", "p_clean"))


@query
def radius_knn(spark, sf):
    d = EvDay(spark, sf).aligned().withColumn("p_clean", ((F.col("d") < 4e6) & (F.col("curve_id") % 4 != 0)).cast("int"))
    return discovery.radius(d.select("d", "p_clean"), grid=400).select(F.round("r", 4).alias("r"))


@query
def group_radius_join(spark, sf):
    """A radius for each motif, from its own training pairs."""
    d = EvDay(spark, sf).aligned().withColumn("p_clean", ((F.col("d") < 4e6) & ((F.col("curve_id") % 4 != 0) | (F.col("k") == 1))).cast("int"))
    r = discovery.radius(d.select("k", "d", "p_clean"), grid=200, groups=["k"])
    return d.join(r, "k").groupBy("k").agg(F.round(F.max("r"), 4).alias("r"), F.count_if(F.col("d") <= F.col("r")).alias("n"))


def _found(spark, sf):
    p, heads, own = _many(spark, sf)
    lengths = p.select("curve_id").distinct().withColumn("len", F.lit(30))
    sized = heads.withColumn("c_k", F.floor(F.col("length") * 0.8).cast("int"))
    d = align.shift_distances(p, lengths, sized, own, contained=True, keys=["motif_id"], rows=200)
    return d, discovery.occurrences(d, 6e6)


@query
def occurrence_search(spark, sf):
    return _found(spark, sf)[1]


@query
def occurrence_frequency(spark, sf):
    return discovery.frequencies(_found(spark, sf)[1]).select("motif_id", "frequency", F.round("mean_diss", 3).alias("mean_diss"))


@query
def approximate_frequency(spark, sf):
    d = align.best_shift(_found(spark, sf)[0], ["motif_id"]).withColumn("r", F.lit(3e6))
    return discovery.approximate_frequencies(d).select("motif_id", "frequency", F.round("mean_diss", 3).alias("mean_diss"))


def _ranked(spark, sf):
    f = discovery.frequencies(_found(spark, sf)[1]).withColumn("mean_diss", F.round("mean_diss", 3))
    return discovery.rank_sum(f)


@query
def rank_sum_select(spark, sf):
    return _ranked(spark, sf).select("motif_id", "frequency", "score", "rank")


@query
def rank_sum_per_group(spark, sf):
    f = discovery.frequencies(_found(spark, sf)[1]).withColumn("mean_diss", F.round("mean_diss", 3)).withColumn("grp", (F.col("motif_id") % 3).cast("int"))
    return discovery.diverse(discovery.rank_sum(f.withColumn("length", F.lit(7)), ["grp"])).select("grp", "motif_id", "frequency")


@query
def top_n_motifs(spark, sf):
    return discovery.top(_ranked(spark, sf), 2, 3).select("rank", "motif_id", "frequency")


@query
def occurrence_segments(spark, sf):
    p, heads, _ = _many(spark, sf)
    found = _found(spark, sf)[1].join(F.broadcast(heads), "motif_id")
    pos = (F.col("x") - F.col("shift") + 1).cast("int")
    return p.join(found, "curve_id").withColumn("pos", pos).where("pos between 1 and length").select("motif_id", "curve_id", "shift", "pos", "y")


# -- tables behind figures -------------------------------------------------------
def _result(ev: EvDay) -> Fit:
    """The curves' fuzzy and cleaned memberships as a fit's result."""
    m = ev.cleaned().select(F.lit(1).cast("long").alias("run_id"), "curve_id", "k", "s", "d", F.round("p", 6).alias("p"), F.col("s").alias("s_clean"), F.col("d").alias("d_clean"), "p_clean")
    centers = ev.motif_points.select(F.lit(1).cast("long").alias("run_id"), "k", F.lit(False).alias("cleaned"), "pos", F.array(F.col("y").cast("double")).alias("ch"))
    return Fit(centers, m, None, None, None, 1, [1.0])


def _groups(spark, sf) -> plan.Groups:
    """The motifs of _many in three groups, with training distances of EvDay's."""
    _, heads, own = _many(spark, sf)
    d = EvDay(spark, sf).aligned().select(F.col("k").cast("long").alias("motif_id"), "curve_id", "d", (F.col("d") < 4e6).cast("int").alias("p_clean"))
    found = plan.Candidates(heads, own, d.where("d is not null"), None)
    groups = heads.select("motif_id", (F.col("motif_id") % 3 + 1).cast("int").alias("grp"))
    radii = spark.createDataFrame([(g, 1e6 * g) for g in (1, 2, 3)], "grp int, r double")
    return plan.Groups(found, discovery.motif_pairs(heads, own), None, groups, radii, spark.createDataFrame([(3e6,)], "r_all double"))


@query
def aligned_plot_data(spark, sf):
    ev = EvDay(spark, sf)
    return plotdata.aligned_curves(_result(ev), ev.points).drop("run_id")


@query
def plot_centers(spark, sf):
    return plotdata.centers(_result(EvDay(spark, sf))).select("run_id", "k", "pos", F.col("ch")[0].alias("y"))


@query
def plot_memberships(spark, sf):
    ev = EvDay(spark, sf)
    labels = metrics.hard_labels(ev.fuzzy()).select("curve_id", F.col("label").cast("long").alias("label"))
    return plotdata.memberships(_result(ev), labels)


@query
def plot_run_times(spark, sf):
    """Runs in the order of their seconds, from made-up results."""

    class Made(plan.Grid):
        def table(self, name, K=None, c=None):
            runs = _runs(spark, sf).groupBy("clusters", "c", "init").agg(F.max("iter").alias("iter"), F.max("avg_sil").alias("seconds"))
            return runs.withColumn("status", F.when(F.col("iter") > 50, "iter_max").otherwise("converged"))

    return plotdata.run_times(Made(spark, "", FitOptions(2, 5), [1.0], [2, 3], [61, 51, 41]))


@query
def plot_group_alignment(spark, sf):
    return plotdata.group_alignment(_groups(spark, sf))


@query
def plot_distance_bins(spark, sf):
    return plotdata.distance_bins(_groups(spark, sf), 5e6)


@query
def plot_distance_bins_per_group(spark, sf):
    return plotdata.distance_bins(_groups(spark, sf), 5e6, per_group=True)


@query
def plot_frequencies(spark, sf):
    return plotdata.frequency_scatter(_groups(spark, sf)).select("grp", "motif_id", "frequency", F.round("mean_diss", 3).alias("mean_diss"))


# -- whole procedures (no SQL form: tests hold them against other ways) -------------
#: Among many users some have no 5 days in a row; they stay in the fit.
_FIT = dict(c_max=9, iter_max=60, tol=1e-2, iter4elong=2, tol4elong=10.0, iter4clean=3, short_curves="overlap")


@query
def fixpoint_fit(spark, sf):
    ev = EvDay(spark, sf)
    return fit(spark, ev.points, ev.lengths, FitOptions(2, 5, **{**_FIT, "tol": 1e-3})).membership


@query
def average_linkage_groups(spark, sf):
    _, heads, own = _many(spark, sf)
    return discovery.linkage(spark, heads, discovery.motif_pairs(heads, own), 8e6)[1]


@query
def motif_discovery_pipeline(spark, sf):
    """Grid of runs, filter, groups, search: motifs in order with their frequencies."""
    ev = EvDay(spark, sf)
    grid = plan.find_candidates(spark, ev.points, ev.lengths, [2, 3], [5], 2, run_folder(spark), FitOptions(2, 5, **_FIT))
    grouped = plan.group_candidates(spark, plan.filter_candidates(grid, -1.0, 1))
    return plan.search(spark, grouped, ev.points, ev.lengths, ["y"]).motifs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
