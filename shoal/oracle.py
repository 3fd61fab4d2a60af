"""The registered queries as SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

DIM = 64


def unit(f: str) -> str:
    """A vector centred and scaled to length 1."""
    c = f"list_transform({f}, lambda x: x - list_avg({f}))"
    return f"list_transform({c}, lambda y: y / sqrt(list_sum(list_transform({c}, lambda z: z * z))))"


def pearson_units(a: str, b: str) -> str:
    return f"(1.0::DOUBLE - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product({a}, {b}))))"


EMB = "emb AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS f, label AS l FROM embeddings)"
POS = f"pos AS (SELECT unnest(range(1, {DIM + 1})) AS i)"
CEN = f"{POS}, cen AS (SELECT l, list(m ORDER BY i) AS mean, any_value(n) AS n FROM (SELECT l, i, avg(f[i]) AS m, count(*) AS n FROM emb, pos GROUP BY l, i) GROUP BY l)"
GLOBAL = f"{POS}, gmean AS (SELECT list(m ORDER BY i) AS mean, any_value(n) AS n FROM (SELECT i, avg(f[i]) AS m, count(*) AS n FROM emb, pos GROUP BY i))"
PART = "pt AS (SELECT p_partkey AS point_id, p_size::DOUBLE AS a, p_retailprice AS b FROM part), pm AS (SELECT avg(a) AS ma, avg(b) AS mb FROM pt)"
RFM = """rfm AS (SELECT o_custkey AS point_id, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate) FROM orders)::DATE)::DOUBLE AS recency,
  count(*)::DOUBLE AS frequency, sum(o_totalprice) AS monetary FROM orders GROUP BY o_custkey)"""
REPS = """near AS (SELECT l, point_id, f, round(list_distance(f, mean), 9) AS d FROM emb JOIN cen USING (l)),
reps AS (SELECT l, f AS rep FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, point_id) AS r FROM near) WHERE r <= 2)"""
ASSIGN = """asg AS (SELECT point_id, l, f, label FROM (SELECT e.point_id, e.l, e.f, c.l AS label, row_number() OVER (PARTITION BY e.point_id ORDER BY list_distance(e.f, c.mean), c.l) AS r
  FROM emb e, cen c) WHERE r = 1)"""
ASSIGN_P = f"""asg AS (SELECT point_id, l, z, label FROM (SELECT e.point_id, e.l, e.z, c.l AS label, row_number() OVER (PARTITION BY e.point_id ORDER BY {pearson_units('e.z', 'c.z')}, c.l) AS r
  FROM (SELECT *, {unit('f')} AS z FROM emb) e, (SELECT l, {unit('mean')} AS z FROM cen) c) WHERE r = 1)"""
CONT = "ct AS (SELECT l, label, count(*) AS n FROM asg GROUP BY l, label)"


def per_part(x: str, y: str) -> str:
    return f"WITH {PART} SELECT point_id, round({x}, 6) AS x, round({y}, 6) AS y FROM pt, pm"


def feature_rows(sql: dict[str, str]) -> str:
    """A row per RFM feature from expressions with {c} as the column."""
    out = []
    for name in ("recency", "frequency", "monetary"):
        cols = ", ".join(f"{e.format(c=name)} AS {k}" for k, e in sql.items())
        out.append(f"SELECT '{name}' AS feature, {cols} FROM rfm")
    return " UNION ALL ".join(out)


M1, M2, M3 = "avg({c})", "avg({c}*{c})", "avg({c}*{c}*{c})"
VAR = f"({M2} - {M1}*{M1})"
SEPARABLE = """SELECT {id} AS point_id, (dense_rank() OVER (ORDER BY first) - 1)::INT AS label FROM (SELECT *, min({id}) OVER (PARTITION BY {nation}) AS first FROM {table})"""
TRIM = """parts AS (SELECT point_id % 4 AS part, point_id, f FROM emb), pmean AS (SELECT part, list(m ORDER BY i) AS mean, any_value(n) AS n FROM (SELECT part, i, avg(f[i]) AS m, count(*) AS n FROM parts, pos GROUP BY part, i) GROUP BY part),
pd AS (SELECT part, point_id, n, list_distance(f, mean) AS d FROM parts JOIN pmean USING (part))"""
FAR = """p AS (SELECT p_brand, p_partkey AS point_id, [p_size::DOUBLE, p_retailprice] AS f FROM part),
m AS (SELECT p_brand, [avg(f[1]), avg(f[2])] AS mean FROM p GROUP BY p_brand),
a AS (SELECT p_brand, arg_min(point_id, k) AS id1, arg_min(f, k) AS f1 FROM (SELECT *, (-round(list_distance(f, mean), 6), point_id) AS k FROM p JOIN m USING (p_brand)) GROUP BY p_brand),
d1 AS (SELECT p.*, f1, list_distance(f, f1) AS x1 FROM p JOIN a USING (p_brand)),
b AS (SELECT p_brand, arg_min(point_id, k) AS id2, arg_min(f, k) AS f2 FROM (SELECT *, (-round(x1, 6), point_id) AS k FROM d1) GROUP BY p_brand),
c AS (SELECT p_brand, arg_min(point_id, k) AS id3 FROM (SELECT d1.*, (-round(least(x1, list_distance(f, f2)), 6), point_id) AS k FROM d1 JOIN b USING (p_brand)) GROUP BY p_brand)"""

SQL: dict[str, str] = {
    "dist_euclidean": f"WITH {EMB}, {CEN} SELECT point_id, round(list_distance(f, mean), 6) AS dist FROM emb JOIN cen USING (l)",
    "dist_sq_euclidean": f"WITH {EMB}, {CEN} SELECT point_id, round(list_distance(f, mean) * list_distance(f, mean), 6) AS dist FROM emb JOIN cen USING (l)",
    "dist_pearson": f"WITH {EMB}, {CEN} SELECT point_id, round({pearson_units(unit('f'), unit('mean'))}, 6) AS dist FROM emb JOIN cen USING (l)",
    "dist_pearson_lowdim": "WITH m AS (SELECT avg(c_acctbal) AS m FROM customer) SELECT c_custkey, round(least(abs(c_acctbal - m) / greatest(abs(c_acctbal), abs(m), 1e-10::DOUBLE), 2.0::DOUBLE), 6) AS dist FROM customer, m",
    "vec_add": per_part("a + ma", "b + mb"),
    "vec_sub": per_part("a - ma", "b - mb"),
    "vec_scale": per_part("a * 2.5::DOUBLE", "b * 2.5::DOUBLE"),
    "vec_shrink": per_part("a + 0.3::DOUBLE * (ma - a)", "b + 0.3::DOUBLE * (mb - b)"),
    "vec_unshrink": per_part("(a - 0.3::DOUBLE * ma) / 0.7::DOUBLE", "(b - 0.3::DOUBLE * mb) / 0.7::DOUBLE"),
    "vec_norm": f"WITH {PART} SELECT point_id, round(sqrt(a * a + b * b), 6) AS norm FROM pt",
    "vec_center_normalize": f"WITH {EMB}, z AS (SELECT point_id, {unit('f')} AS z FROM emb) SELECT point_id, unnest(range({DIM})) AS i, round(unnest(z), 6) AS x FROM z",
    "dist_point_to_set": f"WITH {EMB}, {CEN}, {REPS}, u AS (SELECT {unit('rep')} AS z FROM reps), e AS (SELECT point_id, {unit('f')} AS z FROM emb) SELECT point_id, round(min({pearson_units('e.z', 'u.z')}), 6) AS dist FROM e, u GROUP BY point_id",
    "centroid_global": f"WITH {EMB}, {POS} SELECT count(*) AS n, i - 1 AS i, round(avg(f[i]), 6) AS x FROM emb, pos GROUP BY i",
    "centroid_by_label": f"WITH {EMB}, {POS} SELECT l AS true_label, count(*) AS n, i - 1 AS i, round(avg(f[i]), 6) AS x FROM emb, pos GROUP BY l, i",
    "centroid_weighted_merge": f"WITH {EMB}, {POS} SELECT (l % 2)::INT AS half, count(*) AS n, i - 1 AS i, round(avg(f[i]), 6) AS x FROM emb, pos GROUP BY l % 2, i",
    "merge_summaries": f"WITH {EMB}, {POS} SELECT (l // 4)::INT AS four, count(*) AS n, i - 1 AS i, round(avg(f[i]), 6) AS x FROM emb, pos GROUP BY l // 4, i",
    "merge_two_clusters": f"WITH {EMB}, {POS} SELECT pair, any_value(n) AS n, round(sum(m), 6) AS mean_sum FROM (SELECT (l // 2)::INT AS pair, i, count(*) AS n, avg(f[i]) AS m FROM emb, pos GROUP BY l // 2, i) GROUP BY pair",
    "medoid_by_label": f"""WITH {EMB}, e AS (SELECT l, point_id, {unit('f')} AS z FROM emb), t AS (SELECT a.l, a.point_id, sum({pearson_units('a.z', 'b.z')}) AS total FROM e a JOIN e b USING (l) GROUP BY a.l, a.point_id)
SELECT true_label, medoid_id, total FROM (SELECT l AS true_label, point_id AS medoid_id, round(total, 6) AS total, row_number() OVER (PARTITION BY l ORDER BY round(total, 9), point_id) AS r FROM t) WHERE r = 1""",
    "standardize_features": f"WITH {PART}, s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM pt) SELECT point_id, round((a - ma) / sa, 6) AS x, round((b - mb) / sb, 6) AS y FROM pt, pm, s",
    "cluster_sizes": f"WITH {EMB}, {CEN}, {ASSIGN} SELECT label, count(*) AS size FROM asg GROUP BY label",
    "cluster_sizes_sorted": f"WITH {EMB}, {CEN}, {ASSIGN} SELECT row_number() OVER (ORDER BY size DESC, label) AS rank, size FROM (SELECT label, count(*) AS size FROM asg GROUP BY label)",
    "cluster_statistics": f"WITH {EMB}, {CEN}, {ASSIGN} SELECT label, size, round(size * 100.0::DOUBLE / sum(size) OVER (), 6) AS pct, size = 1 AS singleton FROM (SELECT label, count(*) AS size FROM asg GROUP BY label)",
    "contingency_table": f"WITH {EMB}, {CEN}, {ASSIGN} SELECT l AS true_label, label, count(*) AS n FROM asg GROUP BY l, label",
    "labels_from_membership": SEPARABLE.format(id="c_custkey", nation="c_mktsegment", table="customer"),
    "rfm_orders": f"WITH {RFM} SELECT point_id, recency, frequency, round(monetary, 2) AS monetary FROM rfm",
    "rfm_events": "SELECT user_id AS point_id, round(date_diff('microsecond', max(ts), (SELECT max(ts) FROM events)) / 1000000.0::DOUBLE, 3) AS recency, count(*)::DOUBLE AS frequency, round(sum(value), 4) AS monetary FROM events GROUP BY user_id",
    "rfm_log_transform": f"WITH {RFM} SELECT point_id, recency, frequency, round(ln(1 + monetary), 6) AS log_m, round(ln(1 + frequency), 6) AS log_f FROM rfm",
    "rfm_feature_stats": f"WITH {RFM} " + feature_rows({
        "mean": f"round({M1}, 3)", "std": f"round(sqrt{VAR}, 3)", "skew": f"round(({M3} - 3*{M1}*{M2} + 2*{M1}*{M1}*{M1}) / pow({VAR}, 1.5), 3)",
        "min": "round(min({c}), 3)", "max": "round(max({c}), 3)", "n": "count({c})",
    }),
    "feature_dominance_range": f"WITH {RFM}, w AS (SELECT sum(r * r) AS w FROM ({feature_rows({'r': 'max({c}) - min({c})'})})) SELECT feature, round(r * r / w, 6) AS share, r * r / w > 0.99 AS dominant FROM ({feature_rows({'r': 'max({c}) - min({c})'})}), w",
    "feature_variance_share": f"WITH {RFM}, v AS ({feature_rows({'v': 'var_pop({c})', 'g': 'var_pop(ln(1 + {c}))'})}) SELECT feature, round(v / sum(v) OVER (), 6) AS raw_share, round(g / sum(g) OVER (), 6) AS log_share FROM v",
    "knn": f"WITH {EMB}, {CEN} SELECT qid, rank, point_id, dist FROM (SELECT c.l::BIGINT AS qid, row_number() OVER (PARTITION BY c.l ORDER BY list_distance(f, mean), point_id) AS rank, point_id, round(list_distance(f, mean), 6) AS dist FROM emb, cen c) WHERE rank <= 5",
    "knn_bounded": f"WITH {EMB}, {CEN} SELECT qid, rank, point_id, dist FROM (SELECT c.l::BIGINT AS qid, row_number() OVER (PARTITION BY c.l ORDER BY list_distance(f, mean), point_id) AS rank, point_id, round(list_distance(f, mean), 6) AS dist FROM emb, cen c WHERE list_distance(f, mean) < 0.97) WHERE rank <= 20",
    "knn_pearson": f"WITH {EMB}, {CEN}, e AS (SELECT point_id, {unit('f')} AS z FROM emb), c AS (SELECT l, {unit('mean')} AS y FROM cen), s AS (SELECT l::BIGINT AS qid, point_id, {pearson_units('z', 'y')} AS d FROM e, c) SELECT qid, rank, point_id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, point_id) AS rank FROM s) WHERE rank <= 5",
    "nn1": f"WITH {EMB}, {CEN} SELECT qid, point_id, dist FROM (SELECT c.l::BIGINT AS qid, row_number() OVER (PARTITION BY c.l ORDER BY list_distance(f, mean), point_id) AS rank, point_id, round(list_distance(f, mean), 6) AS dist FROM emb, cen c) WHERE rank = 1",
    "ball_query": f"WITH {EMB}, {CEN} SELECT c.l::BIGINT AS qid, point_id, round(list_distance(f, mean), 6) AS dist FROM emb, cen c WHERE list_distance(f, mean) <= 0.95",
    "ball_query_grid": f"WITH {PART}, q AS (SELECT s_suppkey AS qid, (s_suppkey % 50)::DOUBLE AS qa, 900.0::DOUBLE + abs(s_acctbal) / 10 AS qb FROM supplier), s AS (SELECT qid, point_id, sqrt((a - qa) * (a - qa) + (b - qb) * (b - qb)) AS d FROM pt, q) SELECT qid, point_id, round(d, 6) AS dist FROM s WHERE d <= 5",
    "initial_nn": f"WITH {EMB}, {CEN} SELECT cluster_id, closest, dist FROM (SELECT a.l::BIGINT AS cluster_id, b.l::BIGINT AS closest, round(list_distance(a.mean, b.mean), 6) AS dist, row_number() OVER (PARTITION BY a.l ORDER BY list_distance(a.mean, b.mean), b.l) AS r FROM cen a, cen b WHERE a.l <> b.l) WHERE r = 1",
    "cluster_distance_matrix": f"WITH {EMB}, {CEN}, {REPS} SELECT x.l AS a, y.l AS b, round(min(list_distance(x.rep, y.rep)), 6) AS dist FROM reps x, reps y WHERE x.l <> y.l GROUP BY x.l, y.l",
    "centroid_sample_fraction": f"WITH {EMB}, {GLOBAL} SELECT point_id, round(list_distance(f, mean), 6) AS dist FROM emb, gmean ORDER BY list_distance(f, mean), point_id LIMIT (SELECT greatest(10, floor(count(*) * 0.4::DOUBLE))::BIGINT FROM embeddings)",
    "centroid_sample_n": f"WITH {EMB}, {GLOBAL} SELECT point_id, round(list_distance(f, mean), 6) AS dist FROM emb, gmean ORDER BY list_distance(f, mean), point_id LIMIT 100",
    "sample_size_auto": "SELECT n, least(n, least(15000, greatest(500, floor(50 * pow(n, 0.33) + 0.5))))::BIGINT AS sampled FROM (SELECT count(*) AS n FROM lineitem)",
    "sample_size_modes": """WITH o AS (SELECT count(*) AS n FROM orders) SELECT 'fraction' AS mode, n, least(n, 15000, greatest(50, 500, floor(n * 0.1::DOUBLE)))::BIGINT AS sampled FROM o
UNION ALL SELECT 'small_fraction', n, least(n, 15000, greatest(50, 500, floor(n * 0.001::DOUBLE)))::BIGINT FROM o UNION ALL SELECT 'number', n, least(n, 700) FROM o UNION ALL SELECT 'small_number', n, least(n, 500) FROM o""",
    "random_sample_n": f"WITH {EMB} SELECT point_id FROM emb ORDER BY md5(point_id || ':42'), point_id LIMIT 100",
    "stratified_sample": f"""WITH {EMB} SELECT point_id, l AS true_label FROM (SELECT point_id, l, row_number() OVER (PARTITION BY l ORDER BY md5(point_id || ':42'), point_id) AS r,
        count(*) OVER (PARTITION BY l) AS n, count(*) OVER () AS whole FROM emb) WHERE r <= greatest(1, ceil(n * 100.0::DOUBLE / whole))""",
    "accuracy_greedy": f"""WITH RECURSIVE {EMB}, {CEN}, {ASSIGN}, {CONT}, g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS ul, []::BIGINT[] AS ub UNION ALL
        (SELECT c.n, list_append(ul, c.l::BIGINT), list_append(ub, c.label::BIGINT) FROM g, ct c WHERE NOT list_contains(ul, c.l::BIGINT) AND NOT list_contains(ub, c.label::BIGINT) ORDER BY c.n DESC, c.l, c.label LIMIT 1))
        SELECT sum(n)::DOUBLE / (SELECT sum(n) FROM ct)::DOUBLE AS accuracy FROM g""",
    "accuracy_majority": f"""WITH RECURSIVE {EMB}, {CEN}, {ASSIGN}, {CONT}, grid AS (SELECT b.label::BIGINT AS label, coalesce(ct.n, 0)::BIGINT AS n, dense_rank() OVER (ORDER BY t.l) AS i
            FROM (SELECT DISTINCT l FROM ct) t CROSS JOIN (SELECT DISTINCT label FROM ct) b LEFT JOIN ct ON ct.l = t.l AND ct.label = b.label),
        g AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, []::BIGINT[] AS used UNION ALL
        (SELECT grid.i, grid.n, list_append(used, grid.label) FROM g, grid WHERE grid.i = g.i + 1 AND NOT list_contains(used, grid.label) ORDER BY grid.n DESC, grid.label LIMIT 1))
        SELECT sum(n)::DOUBLE / (SELECT sum(n) FROM ct)::DOUBLE AS accuracy FROM g""",
    "partition_sample": f"WITH {EMB}, {GLOBAL} SELECT point_id, least((r - 1) // 40, 4)::INT AS part FROM (SELECT point_id, row_number() OVER (ORDER BY list_distance(f, mean), point_id) AS r FROM emb, gmean) WHERE r <= 203",
    "partition_trim": f"WITH {EMB}, {POS}, {TRIM} SELECT part::INT AS part, point_id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, point_id) AS r FROM pd) WHERE r <= 30",
    "partition_trim_fraction": f"WITH {EMB}, {POS}, {TRIM} SELECT part::INT AS part, point_id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, point_id) AS r FROM pd) WHERE r <= greatest(5, floor(n * 0.3::DOUBLE))",
    "eliminate_outlier_clusters": "SELECT cluster_id, size FROM (SELECT *, row_number() OVER (ORDER BY (size > 18) DESC, size DESC, cluster_id) AS r FROM (SELECT o_custkey AS cluster_id, count(*) AS size FROM orders GROUP BY o_custkey)) WHERE size > 18 OR r <= 20",
    "agglo_separable": SEPARABLE.format(id="s_suppkey", nation="s_nationkey", table="supplier"),
    "scalable_separable": SEPARABLE.format(id="c_custkey", nation="c_nationkey", table="customer"),
    "distributed_separable": SEPARABLE.format(id="c_custkey", nation="c_nationkey", table="customer"),
    "scattered_points": f"WITH {FAR} SELECT p_brand, 0::BIGINT AS place, id1 AS point_id FROM a UNION ALL SELECT p_brand, 1, id2 FROM b UNION ALL SELECT p_brand, 2, id3 FROM c",
    "majority_vote": "SELECT partial_id, label FROM (SELECT o_custkey AS partial_id, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY o_custkey, o_orderpriority) WHERE r = 1",
    "predict_nearest_rep": f"WITH {EMB}, {CEN}, {REPS} SELECT point_id, label, dist FROM (SELECT e.point_id, r.l AS label, round(list_distance(e.f, r.rep), 6) AS dist, row_number() OVER (PARTITION BY e.point_id ORDER BY list_distance(e.f, r.rep), r.l) AS k FROM emb e, reps r) WHERE k = 1",
    "predict_pearson": f"WITH {EMB}, {CEN}, {REPS}, u AS (SELECT l, {unit('rep')} AS y FROM reps), e AS (SELECT point_id, {unit('f')} AS z FROM emb), s AS (SELECT point_id, l AS label, {pearson_units('z', 'y')} AS d FROM e, u) SELECT point_id, label, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, label) AS k FROM s) WHERE k = 1",
    "predict_lineitem": """WITH p AS (SELECT l_extendedprice, [l_quantity, l_extendedprice / 1000.0::DOUBLE, l_discount * 100, l_tax * 100]::DOUBLE[] AS f FROM lineitem),
s AS (SELECT l_extendedprice, [list_distance(f, [10.5, 10.1, 2.3, 2.1]::DOUBLE[]), list_distance(f, [40.2, 60.3, 2.2, 2.4]::DOUBLE[]), list_distance(f, [10.7, 10.3, 7.9, 6.2]::DOUBLE[]), list_distance(f, [40.4, 60.1, 8.3, 6.1]::DOUBLE[])] AS d FROM p)
SELECT (list_position(d, list_min(d)) - 1)::INT AS label, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, round(avg(list_min(d)), 6) AS mean_dist FROM s GROUP BY 1""",
    "cluster_serde_roundtrip": f"WITH {EMB}, {CEN}, {REPS} SELECT l AS cluster_id, n AS n_points, round(list_sum(mean), 6) AS mean_sum, round(s, 6) AS reps_sum FROM cen JOIN (SELECT l, sum(list_sum(rep)) AS s FROM reps GROUP BY l) USING (l)",
    "ari": f"""WITH {EMB}, {CEN}, {ASSIGN}, {CONT}, t AS (SELECT (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM ct) AS both_, (SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS n FROM ct GROUP BY l)) AS a,
(SELECT sum(n * (n - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS n FROM ct GROUP BY label)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2.0::DOUBLE FROM ct) AS whole) SELECT round((both_ - a * b / whole) / ((a + b) / 2 - a * b / whole), 6) AS ari FROM t""",
    "nmi": f"""WITH {EMB}, {CEN}, {ASSIGN}, {CONT}, ra AS (SELECT l, sum(n)::DOUBLE AS na FROM ct GROUP BY l), rb AS (SELECT label, sum(n)::DOUBLE AS nb FROM ct GROUP BY label), w AS (SELECT sum(n)::DOUBLE AS w FROM ct),
mi AS (SELECT sum(n / w * ln(n * w / (na * nb))) AS mi FROM ct JOIN ra USING (l) JOIN rb USING (label), w), ha AS (SELECT -sum(na / w * ln(na / w)) AS ha FROM ra, w), hb AS (SELECT -sum(nb / w * ln(nb / w)) AS hb FROM rb, w)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM mi, ha, hb""",
    "tau_concentration": f"WITH {EMB}, {CEN}, {ASSIGN}, s AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS r FROM asg GROUP BY label), t AS (SELECT sum(n) FILTER (r <= 2)::DOUBLE / sum(n) AS tau FROM s) SELECT round(tau, 6) AS tau, tau >= 0.9 AS monopolised FROM t",
    "silhouette_pearson": f"""WITH {EMB}, {CEN}, {ASSIGN_P}, d AS (SELECT a.point_id, a.label AS own, b.label AS other, sum(CASE WHEN a.point_id = b.point_id THEN 0 ELSE {pearson_units('a.z', 'b.z')} END) AS s, count(*) AS n FROM asg a, asg b GROUP BY ALL),
t AS (SELECT point_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY point_id)
SELECT point_id, round(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM t""",
    "silhouette_euclidean": f"""WITH {EMB}, {CEN}, {ASSIGN}, d AS (SELECT a.point_id, a.label AS own, b.label AS other, sum(list_distance(a.f, b.f)) AS s, count(*) AS n FROM asg a, asg b GROUP BY ALL),
t AS (SELECT point_id, max(CASE WHEN own = other THEN n END) AS n, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY point_id)
SELECT point_id, round(CASE WHEN n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM t""",
    "davies_bouldin": f"""WITH {EMB}, {CEN}, {ASSIGN_P}, g AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(f[i]) AS m FROM asg JOIN emb USING (point_id), pos GROUP BY label, i) GROUP BY label), gz AS (SELECT label, {unit('c')} AS y FROM g),
sg AS (SELECT label, avg({pearson_units('z', 'y')}) AS s FROM asg JOIN gz USING (label) GROUP BY label),
w AS (SELECT a.label, max((sa.s + sb.s) / {pearson_units('a.y', 'b.y')}) AS r FROM gz a JOIN sg sa USING (label), gz b JOIN sg sb USING (label) WHERE a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS db FROM w""",
    "calinski_harabasz": f"""WITH {EMB}, {CEN}, {ASSIGN}, g AS (SELECT label, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT label, i, avg(f[i]) AS m, count(*) AS n FROM asg, pos GROUP BY label, i) GROUP BY label),
t AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(f[i]) AS m FROM emb, pos GROUP BY i)), b AS (SELECT sum(n * pow(list_distance(c, mean), 2)) AS b, count(*) AS k, sum(n) AS n FROM g, t), w AS (SELECT sum(pow(list_distance(f, c), 2)) AS w FROM asg JOIN g USING (label))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS ch FROM b, w""",
    "size_diff": f"""WITH {EMB}, {CEN}, {ASSIGN}, x AS (SELECT count(*) AS x, row_number() OVER (ORDER BY count(*) DESC) AS r FROM asg GROUP BY l), y AS (SELECT count(*) AS y, row_number() OVER (ORDER BY count(*) DESC) AS r FROM asg GROUP BY label)
SELECT sum(abs(coalesce(x, 0) - coalesce(y, 0)))::BIGINT AS diff, sum(x)::BIGINT AS n, sum(abs(coalesce(x, 0) - coalesce(y, 0))) <= 0.2 * sum(x) AS close FROM x FULL JOIN y USING (r)""",
    "metric_tau_corr": """WITH b AS (SELECT max(p_size) / 50.0::DOUBLE * 0.5::DOUBLE + avg(p_size) / 100.0::DOUBLE + 0.15::DOUBLE AS tau, (avg(p_retailprice) % 7) / 20.0::DOUBLE AS sc, stddev_pop(p_retailprice) / 100.0::DOUBLE AS db FROM part GROUP BY p_brand)
SELECT round(corr(sc, tau), 6) AS corr_sc, round(corr(db, tau), 6) AS corr_db, round(count(*) FILTER (tau >= 0.9 AND sc < 0.2)::DOUBLE / nullif(count(*) FILTER (tau >= 0.9), 0), 6) AS sensitivity,
round(count(*) FILTER (NOT tau >= 0.9 AND NOT sc < 0.2)::DOUBLE / nullif(count(*) FILTER (NOT tau >= 0.9), 0), 6) AS specificity FROM b""",
}
CLOSEST = f"""WITH {EMB}, {CEN}, {REPS}, u AS (SELECT l, rep, {unit('rep')} AS z FROM reps), s AS (SELECT x.l AS a, y.l AS b, min(%s) AS d FROM u x, u y WHERE x.l <> y.l GROUP BY x.l, y.l)
SELECT a AS cluster_id, b AS closest, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM s WHERE d < %s) WHERE r = 1"""
SQL["closest_cluster"] = CLOSEST % ("list_distance(x.rep, y.rep)", "1.25")
SQL["closest_cluster_brute"] = CLOSEST % ("list_distance(x.rep, y.rep)", "1e300")
SQL["closest_cluster_pearson"] = CLOSEST % (pearson_units("x.z", "y.z"), "1e300")
