"""Queries of functions, dynamics, metrics, reports and graph scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from corepick.functions import scores, vectors
from corepick.operators import dynamics, graph, importance, knn, metrics
from corepick.operators import probe
from corepick.operators.runtime import cut
from corepick.plans import fixtures as x
from corepick.plans.registry import query

K = 10

# ---------------------------------------------------------------------------------------------------------- functions


@query("p1_l2_normalize", f"WITH {x.UNITS} SELECT id, list_sum(u) AS total, list_dot_product(u, u) AS square FROM units", "total square")
def _(s, sf):
    u = x.samples(s, sf).withColumn("u", vectors.l2_normalize(F.col("v")))
    return u.select("id", F.aggregate("u", F.lit(0.0), lambda a, v: a + v).alias("total"), vectors.dot(F.col("u"), F.col("u")).alias("square"))


def _pairs(s, sf):
    """Each vector and the next one."""
    u = cut(knn.unit_vectors(x.samples(s, sf)))
    return u.join(u.select((F.col("id") - 1).alias("id"), F.col("u").alias("w")), "id")


_PAIRS = f"WITH {x.UNITS}, pairs AS (SELECT a.id, a.u, b.u AS w FROM units a JOIN units b ON b.id = a.id + 1)"


@query("p2_cosine_similarity", f"{_PAIRS} SELECT id, list_dot_product(u, w) AS cosine FROM pairs", "cosine")
def _(s, sf):
    return _pairs(s, sf).select("id", vectors.cosine_similarity(F.col("u"), F.col("w")).alias("cosine"))


@query("p3_cosine_distance", f"{_PAIRS} SELECT id, 1 - list_dot_product(u, w) AS distance FROM pairs", "distance")
def _(s, sf):
    return _pairs(s, sf).select("id", vectors.cosine_distance(F.col("u"), F.col("w")).alias("distance"))


@query("p4_edge_weight", f"{_PAIRS}, d AS (SELECT id, 2 * (1 - list_dot_product(u, w)) AS dist FROM pairs) SELECT id, dist, greatest(0, least(1, 1 - dist / 2)) AS weight, 1.0::DOUBLE AS flat FROM d", "dist weight")
def _(s, sf):
    d = _pairs(s, sf).select("id", vectors.sq_l2_unit(F.col("u"), F.col("w")).alias("dist"))
    return d.select("id", "dist", vectors.edge_weight(F.col("dist")).alias("weight"), vectors.edge_weight(F.col("dist"), False).alias("flat"))


@query("p5_min_max_normalize", "SELECT event_id AS id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM events", "value")
def _(s, sf):
    return scores.min_max_normalize(x.read(s, sf, "events").select(F.col("event_id").alias("id"), "value"), "value")


@query("p6_min_max_by_class", "SELECT event_id AS id, event_type AS label, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS value FROM events WINDOW w AS (PARTITION BY event_type)", "value")
def _(s, sf):
    rows = x.read(s, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), "value")
    return scores.min_max_normalize_by_class(rows, "value")


@query("p7_is_uniform", f"WITH {x.IMPORTANCE} SELECT bool_and(abs(importance - (SELECT arg_min(importance, id) FROM importance)) <= 1e-8 + 1e-5 * abs((SELECT arg_min(importance, id) FROM importance))) AS is_uniform FROM importance")
def _(s, sf):
    return scores.is_uniform(x.importance(s, sf), "importance")


@query("p8_softmax", f"WITH {x.PREDICTIONS} SELECT id, epoch, list_max(probs) AS top, list_sum(probs) AS total FROM predictions", "top total")
def _(s, sf):
    p = x.predictions(s, sf)
    return p.select("id", "epoch", F.array_max("probs").alias("top"), F.aggregate("probs", F.lit(0.0), lambda a, v: a + v).alias("total"))


for _name, _column, _double in (("p9_l2_error", "l2", "l2"), ("p10_margin", "margin", "margin"), ("p11_correct", "correct", ""), ("p12_confidence", "confidence", "confidence")):

    @query(_name, f"WITH {x.PREDICTIONS} SELECT id, epoch, {_column} FROM metrics", _double)
    def _(s, sf, column=_column):
        return x.metrics(s, sf).select("id", "epoch", column)


@query("p13_budget_per_class", f"WITH {x.SAMPLES}, n AS (SELECT count(*) AS n, count(DISTINCT label) AS c FROM samples) SELECT CAST(floor(floor(n * 0.05::DOUBLE) / c) AS BIGINT) AS budget, greatest(1, CAST(floor(n * 0.05::DOUBLE / c) AS BIGINT)) AS compare_budget FROM n")
def _(s, sf):
    return scores.budget_per_class(x.samples(s, sf), 0.05)


@query("p15_ratio_bp", f"WITH {x.RESULTS} SELECT DISTINCT ratio, printf('r%04dbp', CAST(round(ratio * 10000) AS INTEGER)) AS tag FROM results")
def _(s, sf):
    return x.results(s, sf).select("ratio").distinct().select("ratio", scores.ratio_bp(F.col("ratio")).alias("tag"))


@query("p16_metric_rounding", f"WITH {x.RESULTS} SELECT dataset, method, round(avg(accuracy), 6) AS accuracy, round(avg(seconds), 2) AS seconds FROM results GROUP BY dataset, method", "accuracy seconds")
def _(s, sf):
    means = x.results(s, sf).groupBy("dataset", "method").agg(F.avg("accuracy").alias("accuracy"), F.avg("seconds").alias("seconds"))
    return scores.rounded_metrics(means, rates=("accuracy",), seconds=("seconds",))


_FORMULAS = {"uniform": "1.0::DOUBLE", "el2n_easy": "-el2n", "el2n_hard": "el2n", "el2n_mid": "-abs(el2n - (SELECT quantile_cont(el2n, 0.5) FROM scored))", "variance_low": "conf_mean - conf_var", "variance_high": "conf_var"}
_SCALE = "SELECT id, CASE WHEN max(r) OVER () - min(r) OVER () <= 1e-8 THEN 1.0 ELSE (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) END AS importance FROM raw"
for _name, _sql in _FORMULAS.items():

    @query(f"p17_{_name}", f"WITH {x.SCORED}, raw AS (SELECT id, {_sql} AS r FROM scored) {_SCALE}", "importance")
    def _(s, sf, name=_name):
        return importance.compute_importance(cut(x.scored(s, sf)), name)


# ----------------------------------------------------------------------------------------------------------- dynamics


@query("a3_window_variance", f"WITH {x.PREDICTIONS} SELECT id, var_pop(l2) FILTER (epoch BETWEEN 1 AND 10) AS variance FROM metrics GROUP BY id", "variance")
def _(s, sf):
    return dynamics.window_variance(x.metrics(s, sf), 1, 10)


_EVA = "var_pop(l2) FILTER (epoch BETWEEN 1 AND 10) + var_pop(l2) FILTER (epoch BETWEEN 20 AND 29)"
_FORGET = "(SELECT id, label, CAST(count(*) FILTER (was AND NOT correct) AS DOUBLE) AS score FROM (SELECT *, lag(correct) OVER (PARTITION BY id ORDER BY epoch) AS was FROM metrics) GROUP BY id, label)"


@query("a4_eva_scores", f"WITH {x.PREDICTIONS} SELECT id, label, {_EVA} AS score FROM metrics GROUP BY id, label", "score")
def _(s, sf):
    return dynamics.eva_scores(x.metrics(s, sf), 1, 20)


@query("a5_aum_scores", f"WITH {x.PREDICTIONS} SELECT id, label, avg(margin) AS score FROM metrics GROUP BY id, label", "score")
def _(s, sf):
    return dynamics.aum_scores(x.metrics(s, sf))


@query("a6_forgetting_scores", f"WITH {x.PREDICTIONS} SELECT * FROM {_FORGET}", "score")
def _(s, sf):
    return dynamics.forgetting_scores(x.metrics(s, sf))


@query("a7_el2n_scores", f"WITH {x.PREDICTIONS} SELECT id, label, avg(l2) AS score FROM metrics WHERE epoch <= 20 GROUP BY id, label", "score")
def _(s, sf):
    return dynamics.el2n_scores(x.metrics(s, sf))


@query("a8_confidence_stats", f"WITH {x.SCORED} SELECT id, label, conf_var, conf_mean FROM scored", "conf_var conf_mean")
def _(s, sf):
    return dynamics.confidence_stats(x.metrics(s, sf))


@query("a9_epoch_metrics", f"WITH {x.PREDICTIONS} SELECT * FROM metrics", "l2 margin confidence")
def _(s, sf):
    return x.metrics(s, sf)


@query(
    "a10_describe_scores",
    """WITH b AS (SELECT min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p FROM events)
    SELECT any_value(min) AS min, any_value(max) AS max, any_value(mean) AS mean, any_value(std) AS std, any_value(p[1]) AS p10, any_value(p[2]) AS p25, any_value(p[3]) AS p50, any_value(p[4]) AS p75, any_value(p[5]) AS p90, any_value(p[6]) AS p99,
    avg(pow(value - mean, 3)) / (pow(any_value(std), 3) + 1e-8) AS skewness, avg(pow(value - mean, 4)) / (pow(any_value(std), 4) + 1e-8) - 3 AS kurtosis, count(*) FILTER (value > p[5]) AS above_p90, count(*) FILTER (value < p[1]) AS below_p10 FROM events, b""",
    "min max mean std p10 p25 p50 p75 p90 p99 skewness kurtosis",
)
def _(s, sf):
    return dynamics.describe_scores(x.read(s, sf, "events"), "value")


@query("a11_dynamics_summary", f"WITH {x.PREDICTIONS}, a AS (SELECT id, avg(margin) AS aum FROM metrics GROUP BY id), f AS (SELECT * FROM {_FORGET}) SELECT count(*) FILTER (aum < 0) AS negative_aum, avg(CASE WHEN aum < 0 THEN 1.0::DOUBLE ELSE 0 END) AS negative_share, count(*) FILTER (score = 0) AS never_forgotten, count(*) FILTER (score >= 5) AS forgotten_5 FROM a JOIN f USING (id)", "negative_share")
def _(s, sf):
    m = cut(x.metrics(s, sf))
    return dynamics.dynamics_summary(dynamics.aum_scores(m), dynamics.forgetting_scores(m))


@query(
    "j8_nearest_rate_lookup",
    f"""WITH {x.RESULTS}, t AS (SELECT dataset, ratio AS rate, CAST(min(trial) + 1 AS INTEGER) AS early, CAST(max(step) AS INTEGER) AS late FROM results WHERE method = 'facility' AND dataset <> 'click' GROUP BY dataset, ratio),
    asked AS (SELECT DISTINCT dataset, ratio * 1.7::DOUBLE AS rate FROM results)
    SELECT a.dataset, a.rate, coalesce(arg_min(t.early, [abs(t.rate - a.rate), t.rate]), 1) AS early, coalesce(arg_min(t.late, [abs(t.rate - a.rate), t.rate]), 100) AS late FROM asked a LEFT JOIN t USING (dataset) GROUP BY a.dataset, a.rate""",
    "rate",
)
def _(s, sf):
    r = x.results(s, sf)
    table = r.filter("method = 'facility' AND dataset <> 'click'").groupBy("dataset", F.col("ratio").alias("rate")).agg((F.min("trial") + 1).cast("int").alias("early"), F.max("step").cast("int").alias("late"))
    return dynamics.nearest_window(table, r.select("dataset", (F.col("ratio") * 1.7).alias("rate")).distinct())


# ------------------------------------------------------------------------------------------------------ graph scores


@query("j1_knn_graph", f"WITH {x.knn_sql(K)} SELECT * FROM knn", "dist")
def _(s, sf):
    return knn.knn_graph(x.samples(s, sf), K)


@query("j2_knn_graph_by_class", f"WITH {x.knn_sql(K, True)} SELECT * FROM knn", "dist")
def _(s, sf):
    return knn.knn_graph(x.samples(s, sf), K, by_label=True)


_ATT = f"WITH {x.UNITS}, c AS MATERIALIZED (SELECT q.id AS q, t.id AS t, list_dot_product(q.u, t.u) / 0.1::DOUBLE AS s FROM units q, units t WHERE q.split = 'test' AND t.split = 'train'), z AS (SELECT q, max(s) AS m, sum(exp(s)) AS z FROM c GROUP BY q), att AS MATERIALIZED (SELECT q, t, exp(s) / z AS p FROM c JOIN z USING (q))"


@query("j3_cross_attention", f"{_ATT} SELECT t AS id, sum(p) AS importance FROM att GROUP BY t", "importance")
def _(s, sf):
    v = x.samples(s, sf)
    return knn.cross_attention(v.filter("split = 'train'"), v.filter("split = 'test'"))


@query("a21_attention_stats", f"{_ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC) AS n FROM att), e AS (SELECT q, -sum(p * ln(p)) AS entropy, max(p) AS one, sum(p) FILTER (n <= 10) AS ten FROM r GROUP BY q) SELECT avg(entropy) AS mean_entropy, avg(one) AS top1_mass, avg(ten) AS top10_mass FROM e", "mean_entropy top1_mass top10_mass")
def _(s, sf):
    v = x.samples(s, sf)
    return knn.attention_stats(v.filter("split = 'train'"), v.filter("split = 'test'"))


def _knn(s, sf):
    return cut(knn.knn_graph(x.samples(s, sf), K))


def _adj(s, sf):
    return cut(graph.adjacency(_knn(s, sf)))


def _sym(s, sf):
    return cut(graph.sym_normalize(_adj(s, sf)))


_KNN = x.knn_sql(K)


@query("j4_symmetrize_max", f"WITH {_KNN}{x.ADJ} SELECT * FROM adj", "w")
def _(s, sf):
    return graph.symmetrize_max(_knn(s, sf).select("src", "dst", vectors.edge_weight(F.col("dist")).alias("w")))


@query("g1_adjacency", f"WITH {_KNN} SELECT src, dst, greatest(0, least(1, 1 - dist / 2)) AS w FROM knn WHERE dist < 2", "w")
def _(s, sf):
    return graph.adjacency(_knn(s, sf), symmetric=False)


@query("j5_matmul", f"WITH {_KNN}{x.ADJ} SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM adj a JOIN adj b ON a.dst = b.src GROUP BY a.src, b.dst", "w")
def _(s, sf):
    a = _adj(s, sf)
    return graph.matmul(a, a)


@query("j6_vecmat", f"WITH {_KNN}{x.ADJ}, {x.IMPORTANCE} SELECT dst AS id, sum(w * importance) AS x FROM adj JOIN importance ON id = src GROUP BY dst", "x")
def _(s, sf):
    return graph.vecmat(x.importance(s, sf).select("id", F.col("importance").alias("x")), _adj(s, sf))


@query("j6_matvec", f"WITH {_KNN}{x.TRANSITION}, {x.IMPORTANCE} SELECT src AS id, sum(w * importance) AS x FROM tr JOIN importance ON id = dst GROUP BY src", "x")
def _(s, sf):
    return graph.matvec(graph.transition(_adj(s, sf)), x.importance(s, sf).select("id", F.col("importance").alias("x")))


@query("j7_k_hop_neighbors", f"WITH {_KNN}{x.hops_sql(2)} SELECT * FROM hop")
def _(s, sf):
    return graph.k_hop_neighbors(_knn(s, sf), 2)


@query("g2_sym_normalize", f"WITH {_KNN}{x.SYM} SELECT * FROM sym", "w")
def _(s, sf):
    return _sym(s, sf)


@query("g3_transition", f"WITH {_KNN}{x.TRANSITION} SELECT * FROM tr", "w")
def _(s, sf):
    return graph.transition(_adj(s, sf))


@query("g4_power_sum_kernel", f"WITH {_KNN}{x.power_sum_sql(3)} SELECT * FROM kern", "w")
def _(s, sf):
    return graph.power_sum_kernel(_sym(s, sf), 3)


@query("g5_heat_kernel", f"WITH {_KNN}{x.heat_sql(1.0, 6)} SELECT * FROM kern", "w")
def _(s, sf):
    return graph.heat_kernel(_sym(s, sf), x.samples(s, sf), 1.0, 6)


@query("g5_heat_kernel_terms12", f"WITH {_KNN}{x.heat_sql(1.0, 12)} SELECT * FROM kern", "w")
def _(s, sf):
    return graph.heat_kernel(_sym(s, sf), x.samples(s, sf))


@query("g6_reachability", f"WITH {_KNN}{x.reach_sql(3)} SELECT * FROM reach", "w")
def _(s, sf):
    return graph.reachability(_adj(s, sf), x.samples(s, sf), 3)


@query("g7_row_max_normalize", f"WITH {_KNN}{x.reach_sql(2)} SELECT src, dst, w / max(w) OVER (PARTITION BY src) AS w FROM reach", "w")
def _(s, sf):
    return graph.reachability(_adj(s, sf), x.samples(s, sf), 2, row_max=True)


@query("g6_reachability_walk5", f"WITH {_KNN}{x.reach_sql(5)} SELECT * FROM reach", "w")
def _(s, sf):
    return graph.reachability(_adj(s, sf), x.samples(s, sf))


@query("g7_row_max_normalize_walk5", f"WITH {_KNN}{x.reach_sql(5)} SELECT src, dst, w / max(w) OVER (PARTITION BY src) AS w FROM reach", "w")
def _(s, sf):
    return graph.reachability(_adj(s, sf), x.samples(s, sf), row_max=True)


_GEO = (1 - 0.85**3) / 0.15
_STEP = "SELECT i.id, 0.5 * i.importance + 0.5 * coalesce(sum(r.w * x.importance), 0) / {geo} AS importance FROM importance i LEFT JOIN reach r ON r.dst = i.id LEFT JOIN {prev} x ON x.id = r.src GROUP BY i.id, i.importance"


@query("g8_propagate_importance", f"WITH {_KNN}{x.reach_sql(2)}, {x.IMPORTANCE}, x1 AS MATERIALIZED ({_STEP.format(geo=_GEO, prev='importance')}), x2 AS MATERIALIZED ({_STEP.format(geo=_GEO, prev='x1')}) {_STEP.format(geo=_GEO, prev='x2')}", "importance")
def _(s, sf):
    return graph.propagate_importance(x.importance(s, sf), _adj(s, sf), iterations=3, walk=2, tol=0.0)


_GEO_5 = (1 - 0.85**6) / 0.15
#: All ten steps are taken: the ninth may move values by less than the tolerance, and the tenth still shows in six digits.
_STEPS = ", ".join(f"x{i} AS MATERIALIZED ({_STEP.format(geo=_GEO_5, prev=f'x{i - 1}' if i > 1 else 'importance')})" for i in range(1, 10))


@query("g8_propagate_importance_default", f"WITH {_KNN}{x.reach_sql(5)}, {x.IMPORTANCE}, {_STEPS} {_STEP.format(geo=_GEO_5, prev='x9')}", "importance")
def _(s, sf):
    return graph.propagate_importance(x.importance(s, sf), _adj(s, sf), tol=0.0)


_PR = "WITH RECURSIVE {base}, pr(it, id, x) AS (SELECT 0, id, 1.0::DOUBLE / (SELECT count(*) FROM samples) FROM samples UNION ALL (WITH c AS (SELECT * FROM pr), m AS (SELECT tr.dst AS id, sum(tr.w * c.x) AS y FROM tr JOIN c ON c.id = tr.src GROUP BY tr.dst) SELECT c.it + 1, c.id, 0.15::DOUBLE / (SELECT count(*) FROM samples) + 0.85::DOUBLE * coalesce(y, 0) FROM c LEFT JOIN m USING (id) WHERE c.it < 50)), gap AS (SELECT a.it, max(abs(a.x - b.x)) AS g FROM pr a JOIN pr b ON a.id = b.id AND b.it = a.it - 1 GROUP BY a.it) SELECT id, x AS importance FROM pr WHERE it = coalesce((SELECT min(it) - 1 FROM gap WHERE g < 1e-6), 50)"


@query("g9_pagerank", _PR.format(base=_KNN + x.TRANSITION), "importance")
def _(s, sf):
    return graph.pagerank(_adj(s, sf), x.samples(s, sf))


@query("g10_local_density", f"WITH {_KNN} SELECT src AS id, 1 / (avg(dist) + 1e-8) AS density FROM knn GROUP BY src", "density")
def _(s, sf):
    return knn.local_density(x.samples(s, sf), K)


@query("g11_graph_stats", f"WITH {_KNN}{x.ADJ}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM samples), m AS (SELECT max(c) AS max_degree FROM (SELECT count(*) AS c FROM adj GROUP BY src)) SELECT count(*) AS nnz, 1 - count(*) / (any_value(n) * any_value(n)) AS sparsity, min(w) AS min_w, max(w) AS max_w, avg(w) AS mean_w, count(*) / any_value(n) AS mean_degree, any_value(max_degree) AS max_degree FROM adj, n, m", "sparsity min_w max_w mean_w mean_degree")
def _(s, sf):
    return graph.graph_stats(_adj(s, sf), x.samples(s, sf))


@query("g12_kernel_row_sums", f"WITH {_KNN}{x.power_sum_sql(2)} SELECT src AS id, sum(w) AS row_sum FROM kern GROUP BY src", "row_sum")
def _(s, sf):
    return graph.kernel_row_sums(graph.power_sum_kernel(_sym(s, sf), 2))


for _name, _raw in (("local_density", f"{_KNN}, raw AS (SELECT src AS id, 1 / (avg(dist) + 1e-8) AS r FROM knn GROUP BY src)"), ("test_attention", _ATT[5:] + ", raw AS (SELECT t AS id, sum(p) AS r FROM att GROUP BY t)")):

    @query(f"u3_{_name}", f"WITH {_raw} {_SCALE}", "importance")
    def _(s, sf, name=_name):
        v = x.samples(s, sf)
        return importance.compute_importance(v.filter("split = 'train'") if name == "test_attention" else v, name, queries=v.filter("split = 'test'"))


@query("u3_centrality", _PR.format(base=_KNN + x.TRANSITION).replace("SELECT id, x AS importance FROM pr WHERE", ", raw AS (SELECT id, x AS r FROM pr WHERE") + ") " + _SCALE, "importance")
def _(s, sf):
    return importance.compute_importance(x.samples(s, sf), "centrality")


# ------------------------------------------------------------------------------------------- metrics and reports


@query("a1_class_distribution", "WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang) SELECT label, n, min(n) OVER () AS min_n, max(n) OVER () AS max_n, avg(n) OVER () AS mean_n, stddev_pop(n) OVER () AS std_n, max(n) OVER () / min(n) OVER () AS imbalance FROM c", "mean_n std_n imbalance")
def _(s, sf):
    return metrics.class_distribution(x.read(s, sf, "documents"), "lang")


@query("a2_class_centroids", f"WITH {x.SAMPLES}, l AS (SELECT label, unnest(v) AS e, generate_subscripts(v, 1) - 1 AS p FROM samples) SELECT label, CAST(p AS INTEGER) AS p, avg(e) AS e FROM l GROUP BY label, p", "e")
def _(s, sf):
    return metrics.class_centroids(x.samples(s, sf)).select("label", F.posexplode("centroid").alias("p", "e"))


_PREDICTED = f"{x.PREDICTIONS}, hit AS (SELECT label, list_position(logits, list_max(logits)) - 1 AS pred FROM predictions), pc AS (SELECT label AS class, avg(CASE WHEN label = pred THEN 1.0::DOUBLE ELSE 0 END) AS class_accuracy, count(*) AS class_count FROM hit GROUP BY label)"


def _predicted(s, sf):
    top = F.array_position("logits", F.array_max("logits")) - 1
    return x.predictions(s, sf).select("label", top.alias("pred"))


@query("a12_classification_metrics", f"WITH {_PREDICTED} SELECT sum(class_accuracy * class_count) / sum(class_count) AS accuracy, avg(class_accuracy) AS balanced_accuracy, arg_max(class, [class_accuracy, -class]) AS best_class, arg_min(class, [class_accuracy, class]) AS worst_class FROM pc", "accuracy balanced_accuracy")
def _(s, sf):
    return metrics.classification_metrics(_predicted(s, sf))


@query("a12_per_class_accuracy", f"WITH {_PREDICTED} SELECT * FROM pc", "class_accuracy")
def _(s, sf):
    return metrics.per_class_accuracy(_predicted(s, sf))


_BASE = f"{x.RESULTS}, named AS (SELECT * FROM results WHERE embedding <> 'none'), wide AS (SELECT * FROM named UNION ALL SELECT r.* REPLACE (e.embedding AS embedding) FROM results r JOIN (SELECT DISTINCT dataset, embedding FROM named) e ON r.dataset = e.dataset WHERE r.embedding = 'none')"
_CELLS = "dataset, embedding, method, " + ", ".join(f"round(avg(balanced_accuracy) FILTER (ratio = {r}::DOUBLE) * 100, 6) AS {t}_mean, round(stddev_samp(balanced_accuracy) FILTER (ratio = {r}::DOUBLE) * 100, 6) AS {t}_std" for r, t in ((0.02, "r0200bp"), (0.05, "r0500bp")))
_SUMMARY = "SELECT dataset, embedding, method, " + ", ".join(f"{t}_mean, {t}_std, CASE WHEN {t}_mean IS NOT NULL THEN printf('%.1f±%.1f', round({t}_mean, 1), round(coalesce({t}_std, 0), 1)) END AS {t}_text" for t in ("r0200bp", "r0500bp"))
_SUM_DOUBLES = "r0200bp_mean r0200bp_std r0500bp_mean r0500bp_std"


@query("a13_summary_table", f"WITH {_BASE} {_SUMMARY} FROM (SELECT {_CELLS} FROM wide GROUP BY dataset, embedding, method)", _SUM_DOUBLES)
def _(s, sf):
    return metrics.summary_table(x.results(s, sf), x.RATIOS)


@query("a18_analyze_run", f"WITH {_BASE.replace(' FROM events)', ' FROM events WHERE user_id % 3 = 1)')} {_SUMMARY} FROM (SELECT {_CELLS} FROM wide GROUP BY dataset, embedding, method)", _SUM_DOUBLES)
def _(s, sf):
    return metrics.analyze_run(x.results(s, sf), x.RATIOS, "run1")


@query("j11_with_baselines", f"WITH {_BASE} SELECT dataset, embedding, method, ratio, count(*) AS n, avg(accuracy) AS accuracy FROM wide GROUP BY dataset, embedding, method, ratio", "accuracy")
def _(s, sf):
    return metrics.with_baselines(x.results(s, sf)).groupBy("dataset", "embedding", "method", "ratio").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy"))


@query("a14_trial_summary", f"WITH {x.RESULTS} SELECT dataset, method, ratio, " + ", ".join(f"avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}" for m in ("accuracy", "balanced_accuracy", "seconds")) + " FROM results GROUP BY dataset, method, ratio", "mean_accuracy std_accuracy mean_balanced_accuracy std_balanced_accuracy mean_seconds std_seconds")
def _(s, sf):
    return metrics.trial_summary(x.results(s, sf))


def _history(s, sf):
    return x.results(s, sf).select("method", "trial", "step", F.col("balanced_accuracy").alias("bal_acc"), F.col("accuracy").alias("acc"))


@query("a15_milestone_table", f"WITH {x.RESULTS}, t AS (SELECT method, trial, coalesce(max(balanced_accuracy) FILTER (step <= 50), 0) AS a, coalesce(max(balanced_accuracy) FILTER (step <= 200), 0) AS b FROM results GROUP BY method, trial) SELECT method, avg(a) AS at_50, avg(b) AS at_200 FROM t GROUP BY method", "at_50 at_200")
def _(s, sf):
    return metrics.milestone_table(_history(s, sf), (50, 200))


@query("a16_best_checkpoint", f"WITH {x.RESULTS} SELECT method, trial, step AS best_step, balanced_accuracy AS best_bal_acc, accuracy AS acc_at_best FROM results QUALIFY row_number() OVER (PARTITION BY method, trial ORDER BY balanced_accuracy DESC, step, accuracy DESC) = 1", "best_bal_acc acc_at_best")
def _(s, sf):
    return metrics.best_checkpoint(_history(s, sf))


@query("a17_list_runs", f"WITH {x.RESULTS} SELECT run_id, count(DISTINCT dataset) AS datasets, count(DISTINCT embedding) AS embeddings, count(DISTINCT method) AS methods, count(*) AS n_rows FROM results GROUP BY run_id ORDER BY run_id DESC LIMIT 20")
def _(s, sf):
    return metrics.list_runs(x.results(s, sf))


_EXPECTED = f"{x.RESULTS}, r AS (SELECT dataset, ratio, method, avg(balanced_accuracy) AS balanced_accuracy FROM results WHERE run_id <> 'run1' GROUP BY dataset, ratio, method), e AS (SELECT dataset, ratio, method, avg(balanced_accuracy) * 100 AS mean, stddev_pop(balanced_accuracy) * 10 AS std FROM results WHERE run_id = 'run1' GROUP BY dataset, ratio, method HAVING avg(balanced_accuracy) >= 0.5)"


def _expected(s, sf):
    r = x.results(s, sf)
    keys = ["dataset", "ratio", "method"]
    mine = r.filter("run_id <> 'run1'").groupBy(*keys).agg(F.avg("balanced_accuracy").alias("balanced_accuracy"))
    table = r.filter("run_id = 'run1'").groupBy(*keys).agg((F.avg("balanced_accuracy") * 100).alias("mean"), (F.stddev_pop("balanced_accuracy") * 10).alias("std"), F.avg("balanced_accuracy").alias("a"))
    return mine, table.filter("a >= 0.5").drop("a")


@query("j9_compare_to_expected", f"WITH {_EXPECTED} SELECT dataset, ratio, method, balanced_accuracy * 100 - mean AS delta, abs(balanced_accuracy * 100 - mean) AS abs_delta, (balanced_accuracy * 100 - mean) / nullif(std, 0) AS z, abs(balanced_accuracy * 100 - mean) <= std AS within_std FROM r JOIN e USING (dataset, ratio, method)", "delta abs_delta z")
def _(s, sf):
    return metrics.compare_to_expected(*_expected(s, sf))


@query("j10_config_audit", f"WITH {_EXPECTED}, a AS (SELECT dataset, ratio, method FROM r UNION ALL SELECT dataset, ratio, method FROM r WHERE method = 'facility') SELECT dataset, ratio, method, 'duplicate' AS kind FROM a GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT dataset, ratio, method, 'missing' FROM e WHERE (dataset, ratio, method) NOT IN (SELECT (dataset, ratio, method) FROM a) UNION ALL SELECT DISTINCT dataset, ratio, method, 'unexpected' FROM a WHERE (dataset, ratio, method) NOT IN (SELECT (dataset, ratio, method) FROM e)")
def _(s, sf):
    mine, expected = _expected(s, sf)
    return metrics.config_audit(mine.union(mine.filter("method = 'facility'")), expected)


@query("l1_linear_probe")
def _(s, sf):
    v = x.samples(s, sf)
    return probe.linear_probe(v.filter("split = 'train'"), v.filter("split = 'test'"))


@query("l2_project_2d")
def _(s, sf):
    return probe.project_2d(x.samples(s, sf), x.selections(s, sf))
