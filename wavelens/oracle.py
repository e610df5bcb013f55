"""The catalog's queries as DuckDB SQL, put together from shared parts."""

from __future__ import annotations

_CUTS = "(VALUES (1, 0, 10), (2, 1, 5), (3, 2, 15)) c(k, u, d)"

#: Named parts; each may use those before it.
_PARTS = {
    "ev": "SELECT user_id AS curve_id, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INTEGER AS x, sum(round(value * 100)::BIGINT)::BIGINT AS y FROM events GROUP BY ALL",
    "li": "SELECT l_suppkey AS curve_id, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate))::INTEGER AS x, sum(l_quantity::BIGINT)::BIGINT AS y, count(*) AS n FROM lineitem GROUP BY ALL",
    "ln": "SELECT DISTINCT curve_id, 30 AS len FROM ev",
    "dv": """SELECT curve_id, x, y, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (b - a) / 2.0 WHEN b IS NOT NULL THEN (b - y)::DOUBLE WHEN a IS NOT NULL THEN (y - a)::DOUBLE END::DOUBLE AS dy
        FROM (SELECT *, CASE WHEN lag(x) OVER w = x - 1 THEN lag(y) OVER w END AS a, CASE WHEN lead(x) OVER w = x + 1 THEN lead(y) OVER w END AS b FROM ev WINDOW w AS (PARTITION BY curve_id ORDER BY x))""",
    "mp": f"SELECT c.k, ev.x - c.d + 1 AS pos, y FROM ev JOIN {_CUTS} ON curve_id = u AND x >= d AND x < d + 7",
    "sd": "SELECT e.curve_id, m.k, e.x - m.pos + 1 AS s, sum((e.y - m.y) * (e.y - m.y))::DOUBLE / count(*) AS diss, count(*) AS overlap FROM ev e JOIN ln USING (curve_id) JOIN mp m ON e.x - m.pos + 1 BETWEEN 1 - (7 - 5) AND len - 5 + 1 GROUP BY ALL",
    "bs": "SELECT curve_id, k, s, diss AS d, overlap FROM (SELECT *, row_number() OVER (PARTITION BY curve_id, k ORDER BY diss, s) AS rn FROM (SELECT *, max(overlap) OVER (PARTITION BY curve_id, k) AS most FROM sd) WHERE overlap >= least(5, most)) WHERE rn = 1",
    "al": "SELECT ln.curve_id, g.k, bs.s, bs.d, bs.overlap FROM ln CROSS JOIN (VALUES (1), (2), (3)) g(k) LEFT JOIN bs ON bs.curve_id = ln.curve_id AND bs.k = g.k",
    "fz": """SELECT curve_id, k, s, d, overlap, CASE WHEN z IS NOT NULL THEN (k = z)::INTEGER::DOUBLE ELSE coalesce(w / sum(w) OVER (PARTITION BY curve_id), 0) END AS p
        FROM (SELECT *, min(CASE WHEN d = 0 THEN k END) OVER (PARTITION BY curve_id) AS z, CASE WHEN d > 0 THEN pow(d, -1.0 / ({m} - 1)) END AS w FROM al)""",
    "cl": """SELECT curve_id, k, s, d, p, CASE WHEN any_k = 0 AND curve_id = near THEN 1 ELSE c END AS p_clean FROM
        (SELECT *, max(c) OVER (PARTITION BY k) AS any_k, first_value(curve_id) OVER (PARTITION BY k ORDER BY d NULLS LAST, curve_id) AS near
         FROM (SELECT *, coalesce((d < (SELECT quantile_cont(d, 0.25) FROM fz))::INTEGER, 0) AS c FROM fz))""",
    "iv": "SELECT curve_id, min(x) AS \"start\", max(x) AS \"end\", (max(x) - min(x) + 1)::INTEGER AS length FROM (SELECT *, x - row_number() OVER (PARTITION BY curve_id ORDER BY x) AS i FROM ev) GROUP BY curve_id, i",
    "ip": """SELECT curve_id, u.k, CASE WHEN u.k = {K} THEN 1.0::DOUBLE ELSE e[u.k] END - CASE WHEN u.k = 1 THEN 0.0::DOUBLE ELSE e[u.k - 1] END AS p FROM
        (SELECT curve_id, list_sort([((curve_id * 7919 + j * 104729 + 1299709) % 1000003) / 1000003.0::DOUBLE FOR j IN range(1, {K})]) AS e FROM ln) CROSS JOIN (SELECT unnest(range(1, {K} + 1))::INTEGER AS k) u""",
    "ish": """SELECT curve_id, k, s FROM (SELECT *, row_number() OVER (PARTITION BY curve_id, k ORDER BY ((curve_id * 7919 + k * 104729 + s * 15485863 + 1299709) % 1000003) / 1000003.0::DOUBLE, s) AS rn FROM
        (SELECT curve_id, k, unnest(range("start", "end" - c + 2))::INTEGER AS s FROM iv CROSS JOIN (VALUES (1, 7), (2, {c2})) g(k, c) WHERE length >= c)) WHERE rn = 1""",
    "st": "SELECT curve_id, k, s, p FROM ip JOIN ish USING (curve_id, k)",
    "mb": "SELECT *, count(*) OVER (PARTITION BY curve_id, k) AS overlap FROM (SELECT st.curve_id, k, p, x - s + 1 AS pos, y FROM st JOIN ev USING (curve_id) WHERE p > 0 AND x - s + 1 BETWEEN 1 AND 7)",
    "ce": "SELECT k, pos, sum(p * p / overlap * y) / sum(p * p / overlap) AS y FROM mb GROUP BY k, pos",
    "hl": "SELECT curve_id, sum(CASE WHEN p > 0.5 THEN k END)::BIGINT AS label FROM fz GROUP BY curve_id",
    "as_": "SELECT hl.curve_id, label, s FROM hl JOIN fz ON fz.curve_id = hl.curve_id AND label = k",
    "pc": "SELECT k, curve_id, (x - s + 1)::INTEGER AS pos, y FROM cl JOIN ev USING (curve_id) WHERE p_clean = 1 AND x - s + 1 BETWEEN 1 AND 7",
    "pd": "SELECT a.k AS ka, a.curve_id AS a, b.k AS kb, b.curve_id AS b, sum((a.y - b.y) * (a.y - b.y))::DOUBLE / count(*) AS d FROM pc a JOIN pc b ON a.pos = b.pos AND (a.k <> b.k OR a.curve_id <> b.curve_id) GROUP BY ALL",
    "sl": """SELECT m.k, m.curve_id, coalesce((other - own) / greatest(own, other), 0) AS sil FROM (SELECT DISTINCT k, curve_id FROM pc) m LEFT JOIN
        (SELECT ka, a, max(CASE WHEN ka = kb THEN mean END) AS own, min(CASE WHEN ka <> kb THEN mean END) AS other FROM (SELECT ka, a, kb, avg(d) AS mean FROM pd GROUP BY ALL) GROUP BY ka, a) x ON x.ka = m.k AND x.a = m.curve_id""",
    "rn": """SELECT (s_nationkey % 2 + 2)::INTEGER AS K, ([61, 51, 41][s_suppkey % 3 + 1])::INTEGER AS c, (s_suppkey // 6 % 10 + 1)::INTEGER AS init, s_suppkey AS k_, cents % 20 AS r20, (((cents % 2000) + 2000) % 2000) / 1000.0::DOUBLE - 1 AS avg_sil,
        ((cents % 9) + 9) % 9 AS size, (((cents % 97) + 97) % 97)::INTEGER AS iter, (([61, 51, 41][s_suppkey % 3 + 1]) + ((cents % 20) + 20) % 20)::INTEGER AS length FROM (SELECT *, round(s_acctbal * 100)::BIGINT AS cents FROM supplier)""",
    "gr": "SELECT K.K::INTEGER AS K, c.c::INTEGER AS c, i::INTEGER AS init, row_number() OVER (ORDER BY K.K, -c.c, i) AS run_id FROM (VALUES (2), (3)) K(K), (VALUES (61), (51), (41)) c(c), range(1, 11) t(i)",
    "mh": "SELECT i + 1 AS motif_id, i AS u, (i * 5 % 17 + 1)::INTEGER AS d, (6 + i % 4)::INTEGER AS length FROM range(12) t(i)",
    "mm": "SELECT motif_id, length, x - d + 1 AS pos, y FROM mh JOIN ev ON curve_id = u AND x >= d AND x < d + length",
    "mr": """SELECT m1, m2, (a.x - b.pos + 1)::INTEGER AS shift, sum((a.y - b.y) * (a.y - b.y))::DOUBLE / count(*) AS d, count(*) AS overlap, any_value(c_k) AS c_k FROM
        (SELECT a.motif_id AS m1, b.motif_id AS m2, a.length AS l1, b.length AS l2, floor(b.length * 0.6 + 1e-9)::INTEGER AS c_k FROM mh a JOIN mh b ON a.length > b.length OR (a.length = b.length AND a.motif_id < b.motif_id)) p
        JOIN (SELECT motif_id, pos AS x, y FROM mm) a ON a.motif_id = m1 JOIN mm b ON b.motif_id = m2 AND a.x - b.pos + 1 BETWEEN 1 - (l2 - c_k) AND l1 - c_k + 1 GROUP BY m1, m2, a.x - b.pos + 1""",
    "od": "SELECT e.curve_id, m.motif_id, e.x - m.pos + 1 AS s, sum((e.y - m.y) * (e.y - m.y))::DOUBLE / count(*) AS diss, count(*) AS overlap, any_value(floor(m.length * 0.8)::INTEGER) AS c_k FROM ev e JOIN ln USING (curve_id) JOIN mm m ON e.x - m.pos + 1 BETWEEN 1 AND len - m.length + 1 GROUP BY e.curve_id, m.motif_id, e.x - m.pos + 1",
    "oc": """SELECT motif_id, curve_id, s::INTEGER AS shift, diss FROM (SELECT *, row_number() OVER (PARTITION BY motif_id, curve_id, i ORDER BY diss, s) AS f FROM
        (SELECT *, n - row_number() OVER (PARTITION BY motif_id, curve_id ORDER BY s) AS i FROM (SELECT *, row_number() OVER (PARTITION BY motif_id, curve_id ORDER BY s) AS n FROM od WHERE overlap >= c_k) WHERE diss <= 6e6)) WHERE f = 1""",
    "fq": "SELECT motif_id, count(*) AS frequency, round(avg(diss), 3) AS mean_diss FROM oc GROUP BY motif_id",
    "rk": "SELECT *, row_number() OVER (ORDER BY score, motif_id) AS rank FROM (SELECT *, rank() OVER (ORDER BY -frequency) + (count(*) OVER (PARTITION BY frequency) - 1) / 2.0::DOUBLE + rank() OVER (ORDER BY mean_diss) + (count(*) OVER (PARTITION BY mean_diss) - 1) / 2.0::DOUBLE AS score FROM fq)",
    "tk": "SELECT curve_id, k, d, CASE WHEN {clean} THEN 1 ELSE 0 END AS p_clean FROM al",
    "lb": "SELECT vec_id AS curve_id, (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END)::BIGINT AS label, label::BIGINT AS truth FROM embeddings",
}


def _with(names: str, body: str, **values) -> str:
    parts = []
    for n in names.split():
        text = _PARTS[n]
        for key, v in values.items():
            text = text.replace("{" + key + "}", str(v))
        parts.append(f"{n} AS ({text})")
    return f"WITH {', '.join(parts)} {body}"


def _radius(groups: str, grid: int) -> str:
    """The least grid value at which at most half of the 3 nearest are members', where members are not apart."""
    by = f"GROUP BY {groups}" if groups else ""
    cols = f"{groups}, " if groups else ""
    part = f"PARTITION BY {cols}i"
    on = f"USING ({groups})" if groups else "ON true"
    return f"""SELECT {cols}CASE WHEN top <= low OR low IS NULL THEN top ELSE r END AS r FROM
        (SELECT {cols}max(CASE WHEN p_clean = 1 THEN d END) AS top, min(CASE WHEN p_clean = 0 THEN d END) AS low, min(d) AS least, (max(d) - min(d)) / ({grid} - 1) AS step FROM tk {by}) t
        LEFT JOIN (SELECT {cols}min(g) AS r FROM (SELECT {cols}g, i, avg(p_clean) AS share FROM (SELECT {cols}i, least + step * i AS g, p_clean, rank() OVER ({part} ORDER BY abs(d - (least + step * i))) AS n FROM tk
            JOIN (SELECT {cols}min(d) AS least, (max(d) - min(d)) / ({grid} - 1) AS step FROM tk {by}) q {on} CROSS JOIN range({grid}) t(i)) WHERE n <= 3 GROUP BY ALL) WHERE share <= 0.5 {by}) z {on}"""


_AL = "ev ln mp sd bs al"
_FZ = f"{_AL} fz"


def _aligned(points: str, motif: str, square: str, low: str, high: str, least: str, heads: str = "(VALUES (1), (2), (3)) g(k)", columns: str = "") -> str:
    """Best shifts for other points, motifs, distances and ranges."""
    return f"""pt AS ({points}), mq AS ({motif}), l2 AS (SELECT DISTINCT curve_id FROM pt),
        s2 AS (SELECT e.curve_id, m.k, e.x - m.pos + 1 AS s, sum({square})::DOUBLE / count(*) AS diss, count(*) AS overlap FROM pt e JOIN mq m ON e.x - m.pos + 1 BETWEEN {low} AND {high} GROUP BY e.curve_id, m.k, e.x - m.pos + 1),
        b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY curve_id, k ORDER BY diss, s) AS rn FROM (SELECT *, max(overlap) OVER (PARTITION BY curve_id, k) AS most FROM s2) WHERE overlap >= least({least}, most)) WHERE rn = 1)
        SELECT l2.curve_id, g.k, s::INTEGER AS s, diss AS d, overlap FROM l2 CROSS JOIN {heads} LEFT JOIN b2 ON b2.curve_id = l2.curve_id AND b2.k = g.k"""


def sql() -> dict[str, str]:
    ev = lambda body, more="", **v: _with(f"ev {more}", body, **v)
    fz = lambda body, more="", m="2.0": _with(f"{_FZ} {more}", body, m=m)
    cuts = f"SELECT c.k, dv.x - c.d + 1 AS pos, y, dy FROM dvn dv JOIN {_CUTS} ON curve_id = u AND x >= d AND x < d + 7"
    dvn = ", dvn AS (SELECT * FROM dv WHERE dy IS NOT NULL), "
    search = lambda body, more="": _with(f"ev ln mh mm od oc {more}", body)
    old = {"K": 3}
    return {
        "curve_intervals": ev("SELECT * FROM iv", "iv"),
        "curve_feasible_length": ev("SELECT (SELECT min(m) FROM (SELECT max(length) AS m FROM iv GROUP BY curve_id)) AS c_most, (SELECT count(*) FROM iv WHERE length >= 7) AS n", "iv"),
        "curve_na_repair": _with("li", "SELECT curve_id, x, CASE WHEN y % 7 <> 0 AND n % 5 <> 0 THEN y END AS y, CASE WHEN y % 7 <> 0 AND n % 5 <> 0 THEN n END AS n FROM li"),
        "curve_standardize": ev("SELECT curve_id, x, round((y - (SELECT avg(y) FROM ev)) / (SELECT stddev_samp(y) FROM ev) * 100, 6) AS y FROM ev"),
        "curve_derivative": ev("SELECT curve_id, x, y, dy FROM dv", "dv"),
        "curve_rescale": ev("SELECT curve_id, x, y * 100000 AS y FROM ev"),
        "curve_packed": ev("SELECT curve_id, len, string_agg(coalesce(y::VARCHAR, '-'), ',' ORDER BY g.x) AS y FROM ln CROSS JOIN range(1, 31) g(x) LEFT JOIN ev USING (curve_id, x) GROUP BY curve_id, len", "ln"),
        "curve_unpacked": "SELECT vec_id AS curve_id, x::INTEGER AS x, y::DOUBLE AS y FROM (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS x FROM embeddings)",
        "curve_wide_to_long": "SELECT event_type AS curve_id, (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INTEGER AS x, count(*) AS y FROM events GROUP BY ALL",
        "curve_joined_tables": "SELECT c_nationkey::BIGINT AS curve_id, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS x, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
        "shift_window_padded": ev("SELECT l.curve_id, s, pos::INTEGER AS pos, y FROM (SELECT curve_id, (curve_id % 30 - 3)::INTEGER AS s FROM ln) l CROSS JOIN range(1, 8) t(pos) LEFT JOIN ev ON ev.curve_id = l.curve_id AND ev.x = s + pos - 1", "ln"),
        "shift_window_cropped": ev("SELECT curve_id, (curve_id % 30 - 3)::INTEGER AS s, (x - (curve_id % 30 - 3) + 1)::INTEGER AS pos, y FROM ev WHERE x - (curve_id % 30 - 3) + 1 BETWEEN 1 AND 7"),
        "align_min_shift_d0": _with(_AL, "SELECT curve_id, k, s::INTEGER AS s, d, overlap FROM al"),
        "align_min_shift_d1": _with("ev dv", dvn + _aligned("SELECT curve_id, x, dy FROM dvn", cuts, "(e.dy - m.dy) * (e.dy - m.dy)", "-1", "26", "5")),
        "align_sobolev": _with("ev dv", dvn + _aligned("SELECT * FROM dvn", cuts, "0.5::DOUBLE * ((e.y - m.y) * (e.y - m.y)) + 0.5::DOUBLE * ((e.dy - m.dy) * (e.dy - m.dy))", "-1", "26", "5")),
        "align_weighted_d2": _with("li", ", " + _aligned("SELECT * FROM li", "SELECT 1 AS k, x - 19 AS pos, y, n FROM li WHERE curve_id = 1 AND x BETWEEN 20 AND 31", "0.5::DOUBLE * ((e.y - m.y) * (e.y - m.y)) + 1.0::DOUBLE * ((e.n - m.n) * (e.n - m.n))", "-1", "74", "10", "(VALUES (1)) g(k)")),
        "align_fallback_overlap": ev(", " + _aligned("SELECT * FROM ev", "SELECT * FROM mp", "(e.y - m.y) * (e.y - m.y)", "2", "23", "8"), "mp"),
        "contained_min_shift": ev(", " + _aligned("SELECT * FROM ev", "SELECT * FROM mp", "(e.y - m.y) * (e.y - m.y)", "1", "24", "5"), "mp"),
        "fixed_shift_diss": ev("SELECT l.curve_id, m.k, l.s::INTEGER AS s, count(*) AS overlap, sum((e.y - m.y) * (e.y - m.y))::DOUBLE / count(*) AS d FROM (SELECT curve_id, g.k, curve_id % 10 + g.k AS s FROM ln CROSS JOIN (VALUES (1), (2), (3)) g(k)) l JOIN ev e ON e.curve_id = l.curve_id JOIN mp m ON m.k = l.k AND m.pos = e.x - l.s + 1 GROUP BY ALL", "ln mp"),
        "cross_dissimilarity_matrix": _with(_AL, "SELECT curve_id, max(CASE WHEN k = 1 THEN d END) AS d1, max(CASE WHEN k = 2 THEN d END) AS d2, max(CASE WHEN k = 3 THEN d END) AS d3 FROM al GROUP BY curve_id"),
        "motif_centroid": ev("SELECT k, pos, round(y, 3) AS y FROM ce", "ln iv ip ish st mb ce", K=2, c2=7),
        "motif_centroid_trim": ev("SELECT k, (pos - lo + 1)::INTEGER AS pos, round(y, 3) AS y, (hi - lo + 1)::INTEGER AS length, (lo - 1)::INTEGER AS trim_left FROM (SELECT *, min(pos) OVER (PARTITION BY k) AS lo, max(pos) OVER (PARTITION BY k) AS hi FROM ce)", "ln iv ip ish st mb ce", K=2, c2=7).replace("st AS (SELECT curve_id, k, s, p FROM ip JOIN ish USING (curve_id, k))", "st AS (SELECT curve_id, k, -1 - s % 3 AS s, p FROM ip JOIN ish USING (curve_id, k))"),
        "motif_objective_jk": ev("SELECT k, round(sum(d * p * p) / 1e6, 3) AS j, min(coalesce(o, 0)) AS least_kept FROM (SELECT st.curve_id, st.k, any_value(p) AS p, count(m.pos) AS o, sum((e.y - m.y) * (e.y - m.y))::DOUBLE / nullif(count(m.pos), 0) AS d FROM st LEFT JOIN ev e ON e.curve_id = st.curve_id LEFT JOIN mp m ON m.k = st.k AND m.pos = e.x - s + 1 WHERE p > 0 GROUP BY st.curve_id, st.k) GROUP BY k", "ln mp iv ip ish st", K=2, c2=7),
        "elongation_grid": "SELECT * FROM (VALUES (1, 0, 1, 8), (1, 0, 2, 9), (1, 0, 3, 10), (1, 1, 0, 8), (1, 1, 1, 9), (1, 1, 2, 10), (1, 2, 0, 9), (1, 2, 1, 10), (1, 3, 0, 10), (2, 0, 1, 21), (2, 0, 4, 24), (2, 0, 7, 27), (2, 0, 10, 30), (2, 1, 0, 21), (2, 1, 1, 22), (2, 1, 4, 25), (2, 1, 7, 28), (2, 4, 0, 24), (2, 4, 1, 25), (2, 4, 4, 28), (2, 7, 0, 27), (2, 7, 1, 28), (2, 10, 0, 30), (4, 0, 1, 31), (4, 0, 6, 36), (4, 0, 10, 40), (4, 0, 15, 45), (4, 1, 0, 31), (4, 1, 1, 32), (4, 1, 6, 37), (4, 1, 10, 41), (4, 6, 0, 36), (4, 6, 1, 37), (4, 6, 6, 42), (4, 10, 0, 40), (4, 10, 1, 41), (4, 15, 0, 45)) t(k, add_left, add_right, new_length)",
        "elongation_choice": _with("li", """, g AS (SELECT a, b FROM (VALUES (0), (1), (4), (6)) t(a), (VALUES (0), (1), (4), (6)) u(b) WHERE a + b <= 6),
            p AS (SELECT a, b, curve_id, x, y, count(*) OVER (PARTITION BY a, b, curve_id) AS o FROM g JOIN li ON x BETWEEN 20 - a AND 27 + b),
            c AS (SELECT a, b, x, sum(y / o::DOUBLE) / sum(1.0::DOUBLE / o) AS c FROM p GROUP BY ALL),
            j AS (SELECT a, b, sum(d) AS j, min(o) AS least FROM (SELECT a, b, curve_id, sum((y - c) * (y - c)) / count(*) AS d, count(*) AS o FROM p JOIN c USING (a, b, x) GROUP BY ALL) GROUP BY ALL)
            SELECT 1 AS k, round((j - z) / z, 6) AS rel, a AS add_left, b AS add_right FROM j, (SELECT j AS z FROM j WHERE a + b = 0) WHERE a + b > 0 AND least >= floor((8 + a + b) * 0.8) AND (j - z) / z < 10 ORDER BY (j - z) / z, a, b LIMIT 1"""),
        "membership_fuzzy_m2": fz("SELECT curve_id, k, round(p, 6) AS p FROM fz"),
        "membership_fuzzy_m3": fz("SELECT curve_id, k, round(p, 6) AS p FROM fz", m="3.0"),
        "membership_zero_distance": fz("SELECT curve_id, k, d, p FROM fz WHERE p = 1.0"),
        "bhattacharyya_distance": _with(f"{_FZ} ip", "SELECT curve_id, round(CASE WHEN sum(sqrt(ip.p * fz.p)) = 0 THEN 'inf'::DOUBLE ELSE -ln(sum(sqrt(ip.p * fz.p))) END, 6) AS bc FROM fz JOIN ip USING (curve_id, k) GROUP BY curve_id", m="2.0", **old),
        "convergence_statistics": _with(f"{_FZ} ip", ", b AS (SELECT curve_id, CASE WHEN sum(sqrt(ip.p * fz.p)) = 0 THEN 'inf'::DOUBLE ELSE -ln(sum(sqrt(ip.p * fz.p))) END AS bc FROM fz JOIN ip USING (curve_id, k) GROUP BY curve_id) SELECT 'max' AS how, round(max(bc), 6) AS bc_dist FROM b UNION ALL SELECT 'mean', round(avg(bc), 6) FROM b UNION ALL SELECT 'quantile', round(quantile_disc(bc, 0.5), 6) FROM b", m="2.0", **old),
        "objective_j": fz("SELECT round(sum(d * p * p) / 1e6, 3) AS j FROM fz"),
        "clean_by_quantile": fz("SELECT curve_id, k, p_clean FROM cl", "cl"),
        "init_membership": ev("SELECT curve_id, k, round(p, 9) AS p FROM ip", "ln ip", **old),
        "init_shift": ev("SELECT curve_id, k, s FROM ish", "iv ish", c2=5),
        "one_iteration": ev("""SELECT curve_id, k, s::INTEGER AS s, round(d, 2) AS d, round(p, 6) AS p FROM fz""", "ln iv ip ish st mb ce mp sd bs al fz", K=2, c2=7, m="2.0").replace(_PARTS["mp"], "SELECT k, pos - min(pos) OVER (PARTITION BY k) + 1 AS pos, y FROM ce").replace("(VALUES (1), (2), (3)) g(k)", "(VALUES (1), (2)) g(k)"),
        "hard_labels": fz("SELECT * FROM hl", "hl"),
        "clean_labels": fz("SELECT curve_id, sum(p_clean * k)::BIGINT AS label FROM cl GROUP BY curve_id", "cl"),
        "crisp_memberships": fz("SELECT curve_id, k, (p > 0.5)::INTEGER AS p_clean FROM fz"),
        "label_bands": fz("SELECT curve_id, CASE WHEN p >= 0.6 THEN 'high' WHEN p <= 0.4 THEN 'low' ELSE 'between' END AS band FROM fz WHERE k = 1"),
        "assigned_shift": fz("SELECT curve_id, label, s::INTEGER AS s FROM as_", "hl as_"),
        "contingency": _with("lb", "SELECT label, truth, count(*) AS n FROM lb GROUP BY ALL"),
        "cer": _with("lb", "SELECT round(avg(((a.label = b.label) <> (a.truth = b.truth))::INTEGER), 9) AS cer FROM lb a JOIN lb b ON a.curve_id < b.curve_id"),
        "cluster_mean_curve": fz("SELECT label, pos::INTEGER AS pos, round(avg(y), 3) AS mean_y, count(y) AS n FROM as_ CROSS JOIN range(1, 8) t(pos) LEFT JOIN ev ON ev.curve_id = as_.curve_id AND ev.x = s + pos - 1 GROUP BY label, pos", "hl as_"),
        "median_shift": fz("SELECT label, median(s)::DOUBLE AS median_shift FROM as_ GROUP BY label", "hl as_"),
        "distance_histogram": _with(_AL, "SELECT k, floor(d / 5e6)::BIGINT AS bin, count(*) AS n FROM al WHERE d IS NOT NULL GROUP BY ALL"),
        "distance_density": _with(_AL, "SELECT g, round(avg(exp(((g - d) / 1.5e6::DOUBLE) * ((g - d) / 1.5e6::DOUBLE) * -0.5) / (1.5e6::DOUBLE * 2.5066282746310002)) * 1e9, 6) AS density FROM al CROSS JOIN (SELECT i * 2e6::DOUBLE AS g FROM range(21) t(i)) GROUP BY g"),
        "distance_quantiles": _with(_AL, "SELECT k, round(min(d), 3) AS low, round(quantile_cont(d, 0.25), 3) AS q1, round(quantile_cont(d, 0.5), 3) AS mid, round(quantile_cont(d, 0.75), 3) AS q3, round(max(d), 3) AS high, count(d) AS n FROM al GROUP BY k"),
        "silhouette_pieces": fz("SELECT k, curve_id, round(sil, 6) AS sil FROM sl", "cl pc pd sl"),
        "silhouette_average": fz("SELECT k, round(avg(sil), 6) AS avg_sil, count(*) AS size FROM sl GROUP BY k", "cl pc pd sl"),
        "run_grid": _with("gr", "SELECT run_id, K AS clusters, c, init FROM gr"),
        "run_resume_antijoin": _with("rn gr", "SELECT run_id, K AS clusters, c, init FROM gr ANTI JOIN rn USING (K, c, init)"),
        "candidate_filter": _with("rn", "SELECT row_number() OVER (ORDER BY length DESC, K, c, init, k_) AS motif_id, K AS clusters, c, init, k_ AS motif, length, avg_sil, size FROM rn WHERE avg_sil >= 0.5 AND size >= 2"),
        "candidate_subset": _with("rn", "SELECT row_number() OVER (ORDER BY length DESC, K, c, init, k_) AS motif_id, K AS clusters, c, init, k_ AS motif, length FROM rn WHERE avg_sil >= 0 AND size >= 2 AND K = 2 AND c IN (61, 41)"),
        "run_summary": _with("rn", "SELECT K AS clusters, c, init, round(m, 9) AS mean_sil, round(v, 9) AS sd_sil, row_number() OVER (PARTITION BY K, c ORDER BY m DESC, init)::INTEGER AS ord FROM (SELECT K, c, init, avg(avg_sil) AS m, stddev_samp(avg_sil) AS v FROM rn GROUP BY ALL)"),
        "best_restart": _with("rn", "SELECT K AS clusters, c, init, iter, j FROM (SELECT *, row_number() OVER (PARTITION BY K, c ORDER BY j, init) AS f FROM (SELECT K, c, init, max(iter) AS iter, max_by(avg_sil, iter * 10 + avg_sil) AS j FROM rn GROUP BY ALL)) WHERE f = 1"),
        "motif_length_summary": _with("rn", "SELECT K AS clusters, c, init, min(length) AS low, max(length) AS high, round(avg(length * 100.0::DOUBLE / c), 6) AS pct, count(*) AS n FROM rn GROUP BY ALL"),
        "motif_pair_distance": ev("SELECT m1, m2, shift, d FROM (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY d, shift) AS f FROM (SELECT *, max(overlap) OVER (PARTITION BY m1, m2) AS most FROM mr) WHERE overlap >= least(c_k, most)) WHERE f = 1", "mh mm mr"),
        "radius_separable": _with(f"{_AL} tk", "SELECT max(d) AS r FROM tk WHERE p_clean = 1", clean="d < 2e6"),
        "radius_knn": _with(f"{_AL} tk", f"SELECT round(r, 4) AS r FROM ({_radius('', 400)})", clean="d < 4e6 AND curve_id % 4 <> 0"),
        "group_radius_join": _with(f"{_AL} tk", f"SELECT k, round(max(r), 4) AS r, count(*) FILTER (d <= r) AS n FROM tk JOIN ({_radius('k', 200)}) USING (k) GROUP BY k", clean="d < 4e6 AND (curve_id % 4 <> 0 OR k = 1)"),
        "occurrence_search": search("SELECT * FROM oc"),
        "occurrence_frequency": search("SELECT * FROM fq", "fq"),
        "approximate_frequency": search("SELECT motif_id, count(*) FILTER (d <= 3e6) AS frequency, round(avg(d) FILTER (d <= 3e6), 3) AS mean_diss FROM (SELECT motif_id, curve_id, min(diss) AS d FROM (SELECT *, max(overlap) OVER (PARTITION BY motif_id, curve_id) AS most FROM od) WHERE overlap >= least(c_k, most) GROUP BY ALL) GROUP BY motif_id"),
        "rank_sum_select": search("SELECT motif_id, frequency, score, rank::INTEGER AS rank FROM rk", "fq rk"),
        "rank_sum_per_group": search("""SELECT grp, motif_id, frequency FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, motif_id) AS f FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY -frequency) + (count(*) OVER (PARTITION BY grp, frequency) - 1) / 2.0
            + rank() OVER (PARTITION BY grp ORDER BY mean_diss) + (count(*) OVER (PARTITION BY grp, mean_diss) - 1) / 2.0 AS score FROM (SELECT *, (motif_id % 3)::INTEGER AS grp FROM fq))) WHERE f = 1""", "fq"),
        "top_n_motifs": search("SELECT rank::INTEGER AS rank, motif_id, frequency FROM rk WHERE frequency >= 2 ORDER BY rank LIMIT 3", "fq rk"),
        "occurrence_segments": search("SELECT motif_id, curve_id, shift, (x - shift + 1)::INTEGER AS pos, y FROM oc JOIN mh USING (motif_id) JOIN ev USING (curve_id) WHERE x - shift + 1 BETWEEN 1 AND length"),
        "aligned_plot_data": fz("SELECT k, curve_id, (x - s + 1)::INTEGER AS pos, y, round_even(round(p, 6) * 5, 2) AS width FROM cl JOIN ev USING (curve_id) WHERE round(p, 6) > 0 AND x - s + 1 BETWEEN 1 AND 7", "cl"),
        "plot_centers": ev("SELECT 1::BIGINT AS run_id, k, pos, y::DOUBLE AS y FROM mp", "mp"),
        "plot_memberships": fz("SELECT 1::BIGINT AS run_id, k, cl.curve_id, round(p, 6) AS p, p_clean, label FROM cl LEFT JOIN hl USING (curve_id)", "cl hl"),
        "plot_run_times": _with("rn", "SELECT *, CASE WHEN iter > 50 THEN 'iter_max' ELSE 'converged' END AS status, row_number() OVER (PARTITION BY clusters, c ORDER BY seconds DESC, init)::INTEGER AS ord FROM (SELECT K AS clusters, c, init, max(avg_sil) AS seconds, max(iter) AS iter FROM rn GROUP BY ALL)"),
        "plot_group_alignment": ev(
            "SELECT grp, motif_id, coalesce(shift, 1)::INTEGER AS start, (coalesce(shift, 1) + length - 1)::INTEGER AS \"end\" FROM (SELECT motif_id, length, (motif_id % 3 + 1)::INTEGER AS grp, min(motif_id) OVER (PARTITION BY motif_id % 3) AS first FROM mh) "
            "LEFT JOIN (SELECT m1, m2, shift FROM (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY d, shift) AS f FROM (SELECT *, max(overlap) OVER (PARTITION BY m1, m2) AS most FROM mr) WHERE overlap >= least(c_k, most)) WHERE f = 1) ON m1 = first AND m2 = motif_id",
            "mh mm mr",
        ),
        "plot_distance_bins": _with(_AL, "SELECT (d < 4e6)::INTEGER AS p_clean, floor(d / 5e6)::BIGINT AS bin, count(*) AS n, 3e6::DOUBLE AS r FROM al WHERE d IS NOT NULL GROUP BY ALL"),
        "plot_distance_bins_per_group": _with(_AL, "SELECT (k % 3 + 1)::INTEGER AS grp, (d < 4e6)::INTEGER AS p_clean, floor(d / 5e6)::BIGINT AS bin, count(*) AS n, 1e6::DOUBLE * (k % 3 + 1) AS r FROM al WHERE d IS NOT NULL GROUP BY ALL"),
        "plot_frequencies": _with(_AL, "SELECT (k % 3 + 1)::INTEGER AS grp, k::BIGINT AS motif_id, count(*) FILTER (d <= 1e6 * (k % 3 + 1)) AS frequency, round(avg(d) FILTER (d <= 1e6 * (k % 3 + 1)), 3) AS mean_diss FROM al WHERE d IS NOT NULL GROUP BY k"),
    }
