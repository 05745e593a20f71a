"""Queries of selection methods, samples and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from corepick.functions import scores
from corepick.operators import compare, graph, metrics, sweep
from corepick.operators import greedy as g
from corepick.operators.methods import METHODS, _as_columns, _nodes, normalized_graph, register_method, select
from corepick.operators.runtime import cut
from corepick.plans import fixtures as x
from corepick.plans.registry import query

B = 2
K = 10
_TOP = "SELECT id, label, CAST(rn AS INTEGER) AS rank FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {order}, id) AS rn FROM {table}) WHERE rn <= {b}"


def _scored(s, sf):
    from corepick.operators import dynamics as d

    m = cut(x.metrics(s, sf))
    out = x.scored(s, sf)
    for name, df in (("eva", d.eva_scores(m, 1, 20)), ("aum", d.aum_scores(m)), ("forgetting", d.forgetting_scores(m))):
        out = out.join(df.select("id", F.col("score").alias(name)), "id")
    return out


_SCORES = x.SCORED + ", eva AS (SELECT id, label, var_pop(l2) FILTER (epoch BETWEEN 1 AND 10) + var_pop(l2) FILTER (epoch BETWEEN 20 AND 29) AS s FROM metrics GROUP BY id, label), aum AS (SELECT id, label, avg(margin) AS s FROM metrics GROUP BY id, label), forgetting AS (SELECT id, label, count(*) FILTER (was AND NOT correct) AS s FROM (SELECT *, lag(correct) OVER (PARTITION BY id ORDER BY epoch) AS was FROM metrics) GROUP BY id, label)"
for _id, _method, _order, _table in (
    ("m3", "eva", "s DESC", "eva"),
    ("m4", "aum", "s", "aum"),
    ("m5", "forgetting", "s DESC", "forgetting"),
    ("m6", "el2n_top", "el2n DESC", "scored"),
    ("m7", "el2n_bottom", "el2n", "scored"),
    ("m9", "easy_samples", "conf_mean - conf_var DESC", "scored"),
    ("m10", "high_variance", "conf_var DESC", "scored"),
):

    @query(f"{_id}_{_method}", f"WITH {_SCORES} " + _TOP.format(order=_order, table=_table, b=5))
    def _(s, sf, method=_method):
        return select(_scored(s, sf) if method in ("eva", "aum", "forgetting") else x.scored(s, sf), method, 5)


@query("m8_el2n_mid", f"WITH {_SCORES}, r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY el2n, id) AS rn, greatest(0, (count(*) OVER (PARTITION BY label) - 5) // 2) AS o FROM scored) SELECT id, label, CAST(rn - o AS INTEGER) AS rank FROM r WHERE rn > o AND rn <= o + 5")
def _(s, sf):
    return select(x.scored(s, sf), "el2n_mid", 5)


_HASH = "md5(concat_ws('|', '42', CAST(id AS VARCHAR)))"


@query("m1_random", f"WITH {x.SAMPLES} " + _TOP.format(order=_HASH, table="samples", b=5))
def _(s, sf):
    return select(x.samples(s, sf), "random", 5)


@query("m2_random_proportional", f"WITH {x.SAMPLES} SELECT id, label, CAST(row_number() OVER (ORDER BY {_HASH}, id) AS INTEGER) AS rank FROM samples ORDER BY {_HASH}, id LIMIT (SELECT 5 * count(DISTINCT label) FROM samples)")
def _(s, sf):
    return select(x.samples(s, sf), "random_proportional", 5)


_CENTROID = f"{x.SAMPLES}, c AS (SELECT label, list(e ORDER BY p) AS c FROM (SELECT label, p, avg(e) AS e FROM (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM samples) GROUP BY label, p) GROUP BY label), d AS MATERIALIZED (SELECT id, label, list_distance(v, c) AS s FROM samples JOIN c USING (label))"
for _id, _method, _order in (("m11", "prototype", "s"), ("m12", "anti_prototype", "s DESC")):

    @query(f"{_id}_{_method}", f"WITH {_CENTROID} " + _TOP.format(order=_order, table="d", b=5))
    def _(s, sf, method=_method):
        return select(x.samples(s, sf), method, 5)


@query("m13_graph_density", f"WITH {x.knn_sql(K, True)}, d AS (SELECT src AS id, label, 1 / (avg(dist) + 1e-8) AS s FROM knn JOIN samples ON id = src GROUP BY src, label) " + _TOP.format(order="s DESC", table="d", b=5))
def _(s, sf):
    return select(x.samples(s, sf), "graph_density", 5)


@query("m19_greedy_importance", f"WITH {x.IMPORTANCE} " + _TOP.format(order="importance DESC", table="importance", b=5))
def _(s, sf):
    return select(x.importance(s, sf), "greedy_importance", 5, "importance")


# ------------------------------------------------------------------------------------------------------------ greedy

_COSINE = "1 - list_dot_product(a.u, b.u)"
_UNIT_JOIN = "LEFT JOIN units a ON a.id = st.id LEFT JOIN units b ON b.id = p.id"
_IMP = "SELECT id, label, importance AS imp FROM importance"


@query("m14_fps", x.fps_sql(x.UNITS, 4, _COSINE, _UNIT_JOIN))
def _(s, sf):
    return select(x.samples(s, sf), "fps", 4)


@query(
    "m14_fps_weighted",
    f"""WITH RECURSIVE {x.UNITS}, {x.IMPORTANCE}, sc AS MATERIALIZED (SELECT id, label, importance, (importance - min(importance) OVER w) / (max(importance) OVER w - min(importance) OVER w) AS scaled FROM importance WINDOW w AS (PARTITION BY label)),
    walk(it, id, label, scaled, d, rk) AS (
      SELECT 1, id, label, scaled, CAST('inf' AS DOUBLE), CASE WHEN row_number() OVER (PARTITION BY label ORDER BY importance DESC, id) = 1 THEN 1 ELSE 0 END FROM sc
      UNION ALL
      (WITH st0 AS (SELECT * FROM walk), p AS (SELECT id, label FROM st0 WHERE rk = it),
       st AS (SELECT st.it, st.id, st.label, st.scaled, st.rk, least(st.d, {_COSINE}) AS d FROM st0 st LEFT JOIN p ON p.label = st.label {_UNIT_JOIN}),
       m AS (SELECT label, max(d) AS m FROM st GROUP BY label),
       n AS (SELECT st.id FROM st JOIN m USING (label) WHERE rk = 0 QUALIFY row_number() OVER (PARTITION BY st.label ORDER BY 0.5 * d / m + 0.5 * scaled DESC, st.id) = 1)
       SELECT st.it + 1, st.id, st.label, st.scaled, st.d, CASE WHEN st.id IN (SELECT id FROM n) THEN st.it + 1 ELSE st.rk END FROM st WHERE st.it < 3)
    ) SELECT id, label, CAST(rk AS INTEGER) AS rank FROM walk WHERE rk > 0 AND it = 3""",
)
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "fps", 3, "importance")


def _cosines(by_label: bool) -> str:
    return f"{x.UNITS}, kern AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, list_dot_product(a.u, b.u) AS w FROM units a, units b{' WHERE a.label = b.label' if by_label else ''})"


@query("m15_facility", x.greedy_sql(_cosines(True), 3, True))
def _(s, sf):
    return select(x.samples(s, sf), "facility", 3)


@query("m15_facility_global", x.greedy_sql(_cosines(False), 1, False))
def _(s, sf):
    return select(x.samples(s, sf), "facility", 1, global_selection=True)


def _herding(b: int) -> str:
    return f"""WITH RECURSIVE {x.UNITS}, mu AS MATERIALIZED (SELECT label, list(e ORDER BY p) AS mu FROM (SELECT label, p, avg(e) AS e FROM (SELECT label, unnest(u) AS e, generate_subscripts(u, 1) AS p FROM units) GROUP BY label, p) GROUP BY label),
    aim AS MATERIALIZED (SELECT id, label, list_dot_product(u, mu) AS a FROM units JOIN mu USING (label)),
    walk(it, id, label, a, t, rk) AS (SELECT 0, id, label, a, 0.0::DOUBLE, 0 FROM aim
      UNION ALL (WITH st AS (SELECT * FROM walk), n AS (SELECT id, label FROM st WHERE rk = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY (it + 1) * a - t DESC, id) = 1)
      SELECT st.it + 1, st.id, st.label, st.a, st.t + list_dot_product(x.u, y.u), CASE WHEN st.id = n.id THEN st.it + 1 ELSE st.rk END FROM st JOIN n ON n.label = st.label JOIN units x ON x.id = st.id JOIN units y ON y.id = n.id WHERE st.it < {b}))
    SELECT id, label, CAST(rk AS INTEGER) AS rank FROM walk WHERE rk > 0 AND it = {b}"""


@query("m16_herding", _herding(4))
def _(s, sf):
    return select(x.samples(s, sf), "herding", 4)


_HOPS = x.knn_sql(K, True) + x.hops_sql(2) + ", hc AS MATERIALIZED (SELECT src, dst, list_dot_product(a.u, b.u) AS w FROM hop JOIN units a ON a.id = src JOIN units b ON b.id = dst)"


@query("m17_graph_fps", x.fps_sql(_HOPS, 4, "CASE WHEN p.id IS NULL THEN NULL ELSE coalesce(1 - hc.w, 2) END", "LEFT JOIN hc ON hc.src = p.id AND hc.dst = st.id"))
def _(s, sf):
    return select(x.samples(s, sf), "graph_fps", 4)


@query("m18_graph_facility", x.greedy_sql(_HOPS, 3, True, kernel="hc"))
def _(s, sf):
    return select(x.samples(s, sf), "graph_facility", 3)


_IMPORTANCE_JOIN = ", " + x.IMPORTANCE


@query("m20_graph_coverage", x.greedy_sql(x.knn_sql(K, True) + x.reach_sql(3) + _IMPORTANCE_JOIN, 3, True, gain="k.w * (1 - s.cov)", kernel="reach", imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "graph_coverage", 3, "importance", walk=3)


@query("m20_graph_coverage_walk5", x.greedy_sql(x.knn_sql(K, True) + x.reach_sql(5) + _IMPORTANCE_JOIN, B, True, gain="k.w * (1 - s.cov)", kernel="reach", imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "graph_coverage", B, "importance")


for _n in range(1, 6):

    @query(f"m{20 + _n}_graph_a{_n}" if _n != 2 else "m22_graph_a2_per_class", x.greedy_sql(x.knn_sql(K, True) + x.power_sum_sql(_n), B, True))
    def _(s, sf, n=_n):
        return select(x.samples(s, sf), f"graph_a{n}", B)


@query("m22_graph_a2", x.greedy_sql(x.knn_sql(K) + x.power_sum_sql(2), B, False))
def _(s, sf):
    return select(x.samples(s, sf), "graph_a2", B, global_selection=True)


@query("m22_graph_a2_importance", x.greedy_sql(x.knn_sql(K) + x.power_sum_sql(2) + _IMPORTANCE_JOIN, B, False, imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "graph_a2", B, "importance", global_selection=True)


@query("k1_greedy_facility", x.greedy_sql(x.knn_sql(K) + x.power_sum_sql(1), 3, False))
def _(s, sf):
    v = x.samples(s, sf)
    return g.greedy(g.EdgeKernel(_as_columns(normalized_graph(v, K, True))), _nodes(v, None), 3, per_class=False, width=16)


@query("m26_heat_kernel", x.greedy_sql(x.knn_sql(K, True) + x.heat_sql(1.0, 12), B, True))
def _(s, sf):
    return select(x.samples(s, sf), "heat_kernel", B)


_INFLUENCE = x.knn_sql(K) + x.reach_sql(2) + ", infl AS MATERIALIZED (SELECT src, dst, w / max(w) OVER (PARTITION BY src) AS w FROM reach)" + _IMPORTANCE_JOIN


@query("m27_global_influence_prob", x.greedy_sql(_INFLUENCE, B, False, gain="k.w * s.cov", after="st.cov * (1 - coalesce(k.w, 0))", start=1.0, kernel="infl", imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "global_influence", B, "importance", walk=2)


@query("m27_global_influence_max", x.greedy_sql(_INFLUENCE, B, False, kernel="infl", imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "global_influence", B, "importance", walk=2, mode="max")


@query("m27_global_influence_walk5", x.greedy_sql(_INFLUENCE.replace(x.reach_sql(2), x.reach_sql(5)), 1, False, gain="k.w * s.cov", after="st.cov * (1 - coalesce(k.w, 0))", start=1.0, kernel="infl", imp=_IMP))
def _(s, sf):
    v = x.samples(s, sf).join(x.importance(s, sf).drop("label"), "id")
    return select(v, "global_influence", 1, "importance")


def _then(base: str, table: str, order: str) -> str:
    head = f"{base}, head AS MATERIALIZED ({_TOP.format(order=order, table=table, b=2)})"
    return x.fps_sql(head, 2, _COSINE, _UNIT_JOIN, pool="SELECT id, label FROM samples WHERE id NOT IN (SELECT id FROM head)", offset=2, head="SELECT * FROM head UNION ALL ")


@query("m28_easy_then_diverse", _then(x.UNITS + ", " + x.SCORED, "scored", "conf_mean - conf_var DESC"))
def _(s, sf):
    return select(x.samples(s, sf).join(x.scored(s, sf).drop("label"), "id"), "easy_then_diverse", 4)


@query("m29_proto_then_diverse", _then(x.UNITS + _CENTROID[len(x.SAMPLES) :], "d", "s"))
def _(s, sf):
    return select(x.samples(s, sf), "proto_then_diverse", 4)


# ------------------------------------------------------------------------------------------------------- comparisons

_AB = f"WITH {x.SELECTIONS}, a AS (SELECT * FROM selections WHERE config = 'a'), b AS (SELECT * FROM selections WHERE config = 'b')"


def _ab(s, sf):
    v = x.selections(s, sf)
    return v.filter("config = 'a'"), v.filter("config = 'b'")


@query("x1_x2_overlap", f"{_AB} SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(a.id) * 100 AS overlap_pct, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.id = b.id", "overlap_pct jaccard")
def _(s, sf):
    return compare.overlap(*_ab(s, sf))


_MATRIX = "n AS (SELECT config, count(*) AS n FROM {0} GROUP BY config) SELECT x.config AS a, y.config AS b, (SELECT count(*) FROM {0} p JOIN {0} q USING (id) WHERE p.config = x.config AND q.config = y.config) / x.n * 100 AS overlap_pct FROM n x, n y"


@query("x3_overlap_matrix", f"WITH {x.SELECTIONS}, " + _MATRIX.format("selections"), "overlap_pct")
def _(s, sf):
    return compare.overlap_matrix(x.selections(s, sf))


@query("x4_unique_per_config", f"WITH {x.SELECTIONS}, o AS (SELECT id, any_value(config) AS config FROM selections GROUP BY id HAVING count(*) = 1) SELECT s.config, count(o.id) AS n_unique, count(o.id) / count(*) AS share FROM selections s LEFT JOIN o ON o.id = s.id GROUP BY s.config", "share")
def _(s, sf):
    return compare.unique_per_config(x.selections(s, sf))


@query("x5_selection_diff", f"{_AB} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'shared' END AS side FROM a FULL JOIN b ON a.id = b.id")
def _(s, sf):
    return compare.selection_diff(*_ab(s, sf))


@query("x6_selection_class_counts", f"{_AB}, c AS (SELECT l.label, count(a.id) AS n FROM (SELECT DISTINCT label FROM samples) l LEFT JOIN a ON a.label = l.label GROUP BY l.label) SELECT label, n, min(n) OVER () AS min_n, max(n) OVER () AS max_n FROM c")
def _(s, sf):
    return compare.selection_class_counts(_ab(s, sf)[0], x.samples(s, sf))


@query("a19_coverage_score", f"{_AB.replace(x.SAMPLES, x.knn_sql(K) + x.power_sum_sql(2), 1)}, {x.IMPORTANCE}, m AS (SELECT k.src AS id, max(w) AS c FROM kern k JOIN a ON a.id = k.dst GROUP BY k.src) SELECT sum(importance * coalesce(c, 0)) / sum(importance) AS coverage FROM importance LEFT JOIN m USING (id)", "coverage")
def _(s, sf):
    kernel = graph.power_sum_kernel(normalized_graph(x.samples(s, sf), K, True), 2)
    return metrics.coverage_score(kernel, _ab(s, sf)[0], x.importance(s, sf))


def _mean_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT label, list(e ORDER BY p) AS m FROM (SELECT label, p, avg(e) AS e FROM (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) AS p FROM samples {where}) GROUP BY label, p) GROUP BY label)"


@query("a20_selection_quality", f"{_AB}, {x.IMPORTANCE}, {_mean_sql('f', '')}, {_mean_sql('g', 'WHERE id IN (SELECT id FROM a)')}, i AS (SELECT a.label, avg(importance) AS imp_mean, stddev_pop(importance) AS imp_std FROM a JOIN importance USING (id) GROUP BY a.label) SELECT label, list_cosine_similarity(f.m, g.m) AS mean_cosine, imp_mean, imp_std FROM f JOIN g USING (label) JOIN i USING (label)", "mean_cosine imp_mean imp_std")
def _(s, sf):
    return metrics.selection_quality(x.samples(s, sf), _ab(s, sf)[0], x.importance(s, sf))


def _rho(a: str, b: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
    return f"SELECT CASE WHEN count(*) > 2 THEN corr(ra, rb) END AS rho FROM (SELECT {rank.format('xa')} AS ra, {rank.format('xb')} AS rb FROM (SELECT x.x AS xa, y.x AS xb FROM {a} x JOIN {b} y USING (id)))"


@query("a22_spearman", f"WITH a AS (SELECT o_orderkey AS id, floor(o_totalprice / 1000) AS x FROM orders), b AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS x FROM lineitem GROUP BY l_orderkey) {_rho('a', 'b')}", "rho")
def _(s, sf):
    a = x.read(s, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))
    b = x.read(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").cast("double").alias("x"))
    return graph.spearman(a, b)


_DOCS = "d AS (SELECT doc_id AS id, lang AS label FROM documents), h AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id) AS rn FROM d)"


def _docs(s, sf):
    return x.read(s, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))


@query("r1_stratified_subsample", f"WITH {_DOCS}, c AS (SELECT label, count(*) AS n FROM d GROUP BY label), q AS (SELECT label, n, least(n, greatest(1, CAST(floor(n * 101 / sum(n) OVER ()) AS BIGINT))) AS q FROM c), o AS (SELECT *, 101 - sum(q) OVER () AS short, row_number() OVER (ORDER BY label) AS p, count(*) OVER () AS k FROM q), z AS (SELECT label, least(n, q + CASE WHEN short > 0 AND p <= short THEN 1 WHEN short < 0 AND k - p < -short THEN -1 ELSE 0 END) AS q FROM o) SELECT id, label, CAST(rn AS INTEGER) AS rank FROM h JOIN z USING (label) WHERE rn <= q")
def _(s, sf):
    return compare.stratified_subsample(_docs(s, sf), 101)


@query("r2_proportional_subsample", f"WITH {_DOCS}, c AS (SELECT label, greatest(1, CAST(floor(count(*) * 50 / (SELECT count(*) FROM d)) AS BIGINT)) AS q FROM d GROUP BY label) SELECT id, label, CAST(rn AS INTEGER) AS rank FROM h JOIN c USING (label) WHERE rn <= q")
def _(s, sf):
    return compare.proportional_subsample(_docs(s, sf), 50)


@query("r3_uniform_subsample", f"WITH {_DOCS} SELECT id, label FROM d ORDER BY md5(concat_ws('|', '42', CAST(id AS VARCHAR))), id LIMIT 60")
def _(s, sf):
    return compare.uniform_subsample(_docs(s, sf), 60)


# ------------------------------------------------------------------------------------------------------------ sweeps


@query(
    "o1_selection_sweep",
    f"WITH {_CENTROID}, b AS (SELECT r AS ratio, CAST(floor(floor(count(*) * r) / count(DISTINCT label)) AS BIGINT) AS b FROM samples, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS r) GROUP BY r), t AS (SELECT CAST(unnest([0, 1]) AS INTEGER) AS trial), "
    "rnd AS (SELECT trial, id, label, row_number() OVER (PARTITION BY trial, label ORDER BY md5(concat_ws('|', CAST(42 + trial AS VARCHAR), CAST(id AS VARCHAR))), id) AS rn FROM samples, t), pro AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY s, id) AS rn FROM d) "
    "SELECT 'random' AS method, 'none' AS embedding, ratio, trial, id, label, CAST(rn AS INTEGER) AS rank FROM rnd, b WHERE rn <= b UNION ALL SELECT 'prototype', 'base', ratio, trial, id, label, CAST(rn AS INTEGER) FROM pro, b, t WHERE rn <= b",
)
def _(s, sf):
    return sweep.selection_sweep({"base": x.samples(s, sf)}, ["random", "prototype", "eva"], [0.05, 0.1], trials=2)[0].drop("importance")


_BUDGET = "(SELECT CAST(floor(floor(count(*) * 0.05::DOUBLE) / count(DISTINCT label)) AS BIGINT) FROM scored)"
_BY_IMPORTANCE = (("uniform", "id"), ("el2n_hard", "el2n DESC"), ("variance_low", "conf_mean - conf_var DESC"))


@query(
    "o1_sweep_importance",
    f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT 'greedy_importance' AS method, 'none' AS embedding, '{n}' AS importance, 0.05::DOUBLE AS ratio, CAST(0 AS INTEGER) AS trial, * FROM ({_TOP.format(order=o, table='scored', b=_BUDGET)})" for n, o in _BY_IMPORTANCE),
)
def _(s, sf):
    sources = {"base": x.samples(s, sf), "trained": x.scored(s, sf)}
    return sweep.selection_sweep(sources, ["greedy_importance"], [0.05], importances=[n for n, _ in _BY_IMPORTANCE])[0]


#: All ten steps are taken, however little the last ones move.
_SPREAD = ", ".join(f"x{i} AS MATERIALIZED (SELECT i.id, i.label, 0.5 * i.importance + 0.5 * coalesce(sum(r.w * x.importance), 0) / {(1 - 0.85**6) / 0.15} AS importance FROM x0 i LEFT JOIN reach r ON r.dst = i.id LEFT JOIN x{i - 1} x ON x.id = r.src GROUP BY i.id, i.label, i.importance)" for i in range(1, 11))


@query(
    "o1_sweep_propagated",
    f"WITH {x.knn_sql(K)}{x.reach_sql(5)}, d AS (SELECT src AS id, 1 / (avg(dist) + 1e-8) AS r FROM knn GROUP BY src), x0 AS MATERIALIZED (SELECT id, label, (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) AS importance FROM d JOIN samples USING (id)), {_SPREAD}, scored AS (SELECT id, label, importance FROM x10) "
    "SELECT 'greedy_importance' AS method, 'none' AS embedding, 'local_density' AS importance, ratio, CAST(0 AS INTEGER) AS trial, id, label, rank FROM (" + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS ratio, * FROM ({_TOP.format(order='importance DESC', table='scored', b=f'(SELECT CAST(floor(floor(count(*) * {q}::DOUBLE) / count(DISTINCT label)) AS BIGINT) FROM scored)')})" for q in (0.05, 0.1)) + ")",
)
def _(s, sf):
    return sweep.selection_sweep({"base": x.samples(s, sf)}, ["greedy_importance"], [0.05, 0.1], importances=["local_density"], propagate=True, tol=0.0)[0]


@query("o2_resolve_dependencies", f"WITH {_SCORES}, {x.SAMPLES} SELECT 'base' AS source, count(*) AS n FROM samples UNION ALL SELECT 'trained', count(*) FROM scored")
def _(s, sf):
    known = {"base": x.samples(s, sf), "trained": x.scored(s, sf)}
    names = sweep.resolve_dependencies(["random"], ["base"], ["el2n_hard"])
    counts = [known[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("source"), "n") for n in names]
    return counts[0].union(counts[1])


_ON_VECTORS = "anti_prototype facility fps global_influence graph_a1 graph_a2 graph_a3 graph_a4 graph_a5 graph_coverage graph_density graph_facility graph_fps heat_kernel herding proto_then_diverse prototype"
_ON_NONE = "easy_samples el2n_bottom el2n_mid el2n_top greedy_importance high_variance random random_proportional"


@query("p14_valid_configs", f"WITH {x.SAMPLES}, c AS (SELECT unnest(string_split('{_ON_VECTORS}', ' ')) AS method, 'base' AS source UNION ALL SELECT unnest(string_split('{_ON_NONE}', ' ')), 'none') SELECT method, source, (SELECT count(*) FROM samples) AS n FROM c")
def _(s, sf):
    sources = {"base": x.samples(s, sf), "trained": x.scored(s, sf)}
    pairs = s.createDataFrame(sweep.valid_configs(sorted(METHODS), sources), "method string, source string")
    return pairs.crossJoin(F.broadcast(sources["base"].agg(F.count("*").alias("n"))))


@query("u1_register_method", f"WITH {x.SAMPLES} " + _TOP.format(order="id DESC", table="samples", b=3))
def _(s, sf):
    @register_method("latest", ("v",))
    def latest(df, budget, importance, seed):
        """Greatest ids of each class."""
        return scores.top_k_per_class(df, "id", budget)

    try:
        return select(x.samples(s, sf), "latest", 3)
    finally:
        del METHODS["latest"]


_OF_K = " UNION ALL ".join(f"SELECT 'k{k:02d}' AS config, id FROM ({x.greedy_sql(x.knn_sql(k) + x.power_sum_sql(2), 1, False)})" for k in (5, 10))


@query("o3_compare_k", f"WITH s AS MATERIALIZED ({_OF_K}), " + _MATRIX.format("s"), "overlap_pct")
def _(s, sf):
    return sweep.compare_k(x.samples(s, sf), [5, 10], 1)


@query(
    "o4_compare_global",
    f"WITH a AS MATERIALIZED (SELECT * FROM ({x.greedy_sql(x.knn_sql(K, True) + x.power_sum_sql(2), B, True)})), b AS MATERIALIZED (SELECT * FROM ({x.greedy_sql(x.knn_sql(K) + x.power_sum_sql(2), B, False)})), "
    "l AS (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings), o AS (SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(a.id) * 100 AS overlap_pct, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.id = b.id) "
    "SELECT label, (SELECT count(*) FROM a WHERE a.label = l.label) AS n_per_class, (SELECT count(*) FROM b WHERE b.label = l.label) AS n_global, overlap_pct, jaccard FROM l, o",
    "overlap_pct jaccard",
)
def _(s, sf):
    return sweep.compare_global(x.samples(s, sf), B)


def _halves(s, sf):
    v = x.samples(s, sf)
    return {"first": v.withColumn("v", F.slice("v", 1, 32)), "last": v.withColumn("v", F.slice("v", 33, 32)), "whole": v}


@query("o5_compare_sources", "WITH " + ", ".join(f"{n}_ AS ({'SELECT * FROM (WITH ' + _CENTROID.replace('CAST(embedding AS DOUBLE[])', e) + ' ' + _TOP.format(order='s', table='d', b=5) + ')'})" for n, e in (("first", "CAST(embedding[1:32] AS DOUBLE[])"), ("last", "CAST(embedding[33:64] AS DOUBLE[])"), ("whole", "CAST(embedding AS DOUBLE[])"))) + ", s AS (SELECT 'first' AS config, id FROM first_ UNION ALL SELECT 'last', id FROM last_ UNION ALL SELECT 'whole', id FROM whole_), " + _MATRIX.format("s"), "overlap_pct")
def _(s, sf):
    return sweep.compare_sources(_halves(s, sf), 5)


_FOUR = {
    "random": f"WITH {x.SAMPLES} " + _TOP.format(order=_HASH, table="samples", b=3),
    "prototype": f"WITH {_CENTROID} " + _TOP.format(order="s", table="d", b=3),
    "graph_density": f"WITH {x.knn_sql(K, True)}, d AS (SELECT src AS id, label, 1 / (avg(dist) + 1e-8) AS s FROM knn JOIN samples ON id = src GROUP BY src, label) " + _TOP.format(order="s DESC", table="d", b=3),
    "herding": _herding(3),
}
_OF_METHODS = "WITH s AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{n}' AS config, id FROM ({q})" for n, q in _FOUR.items()) + "), "


@query("o6_compare_methods", _OF_METHODS + _MATRIX.format("s"), "overlap_pct")
def _(s, sf):
    return sweep.compare_methods(x.samples(s, sf), [*_FOUR], 3)[0]


@query("o6_compare_methods_unique", _OF_METHODS + "o AS (SELECT id FROM s GROUP BY id HAVING count(*) = 1) SELECT s.config, count(o.id) AS n_unique, count(o.id) / count(*) AS share FROM s LEFT JOIN o ON o.id = s.id GROUP BY s.config", "share")
def _(s, sf):
    return sweep.compare_methods(x.samples(s, sf), [*_FOUR], 3)[1]


@query("o7_validate_kernel")
def _(s, sf):
    return sweep.validate_kernel(x.samples(s, sf), 1)
