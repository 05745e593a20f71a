"""Hand-made cases: known answers, quotas, ties, and independence of how rows are dealt out."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corepick.functions import scores, vectors
from corepick.operators import compare, dynamics, graph, knn, metrics, methods, sweep
from corepick.operators import greedy as g
from corepick.operators.runtime import cut
from corepick.sources import artifacts, samples

PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]


def edges(spark, pairs, w=1.0):
    return graph.symmetrize_max(spark.createDataFrame([(a, b, w) for a, b in pairs], "src long, dst long, w double"))


def nodes(spark, n, label=0):
    return spark.createDataFrame([(i, label) for i in range(n)], "id long, label long")


def as_map(df):
    return {(r.src, r.dst): r.w for r in df.collect()}


def test_vectors_with_zero_and_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0, 0.5], 0)], "v array<double>, z array<double>, y int")
    r = df.select(vectors.l2_normalize(F.col("v")).alias("u"), vectors.correct(F.col("z"), F.col("y")).alias("c"), vectors.margin(F.col("z"), F.col("y")).alias("m"), vectors.softmax(F.col("z"), 1e-3).alias("s")).first()
    assert r.u == [0.0, 0.0] and r.c and r.m == 0.0 and abs(sum(r.s) - 1) < 1e-12


def test_knn_small_tables(spark):
    one = spark.createDataFrame([(1, 0, [1.0, 0.0])], "id long, label long, v array<double>")
    assert knn.knn_graph(one, 3).count() == 0
    same = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(3)] + [(9, 1, [0.0, 0.0])], "id long, label long, v array<double>")
    got = sorted((r.src, r.dst, r["rank"]) for r in knn.knn_graph(same, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (9, 0, 1), (9, 1, 2)]
    assert {r.src for r in knn.knn_graph(same, 2, by_label=True).collect()} == {0, 1, 2}


def test_knn_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=8)]) for i in range(60)], "id long, label long, v array<double>")
    rows = lambda x: sorted((r.src, r.dst, r["rank"]) for r in x.collect())
    for by_label in (False, True):
        assert rows(knn.knn_graph(df, 4, by_label)) == rows(knn.knn_graph(df.repartition(7), 4, by_label, block=9))


def test_graph_on_a_path(spark):
    e = edges(spark, PATH)
    assert {(r.src, r.dst) for r in graph.k_hop_neighbors(e, 2, include_self=False).collect()} == {(a, b) for a in range(5) for b in range(5) if 0 < abs(a - b) <= 2}
    sym = as_map(graph.sym_normalize(e))
    assert sym[0, 1] == pytest.approx(1 / 2**0.5) and sym[1, 2] == pytest.approx(0.5)
    assert as_map(graph.transition(e))[0, 1] == 1.0


def test_heat_series_equals_eigenvalues(spark):
    e = graph.sym_normalize(edges(spark, [*PATH, (0, 4), (1, 3)], 0.7))
    a = np.zeros((5, 5))
    for (i, j), w in as_map(e).items():
        a[i, j] = w
    val, vec = np.linalg.eigh(np.eye(5) - a)
    want = vec @ np.diag(np.exp(-val)) @ vec.T
    got = as_map(graph.heat_kernel(e, nodes(spark, 5)))
    assert max(abs(got.get((i, j), 0.0) - want[i, j]) for i in range(5) for j in range(5)) < 1e-9


def test_reach_sum_equals_the_matrix(spark):
    e, n = edges(spark, [*PATH, (0, 2)]), nodes(spark, 6)
    x = n.select("id", (F.col("id") + 1).cast("double").alias("x"))
    r = graph.reachability(e, n, 3, 0.5)
    p = graph.transition(e)
    for transposed in (False, True):
        full = graph.vecmat(x, r) if transposed else graph.matvec(r, x)
        free = graph.reach_sum(p, x, 3, 0.5, transposed)
        a, b = ({r.id: r.x for r in d.collect()} for d in (full, free))
        assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def plain_greedy(kernel, imp, label, budget, rule):
    n = len(imp)
    s, out, left = np.full(n, rule.start), [], {c: budget for c in label}
    while True:
        free = [j for j in range(n) if j not in out and left[label[j]]]
        if not free:
            return out
        gain = [(imp * rule.gain(kernel[:, j], s)).sum() for j in range(n)]
        best = max(free, key=lambda j: (gain[j], -j))
        out.append(best)
        left[label[best]] -= 1
        s = rule.after(kernel[:, best], s)


@pytest.mark.parametrize("rule", [g.FACILITY, g.COVERAGE, g.REACH])
def test_lazy_rounds_equal_plain_greedy(spark, rule):
    rng = np.random.default_rng(3)
    n = 24
    k = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0.0)
    imp, label = rng.random(n), [i % 3 for i in range(n)]
    e = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(n) if k[i, j]], "i long, j long, w double")
    rows = spark.createDataFrame([(i, label[i], float(imp[i])) for i in range(n)], "id long, label long, imp double")
    want = plain_greedy(k, imp, label, 3, rule)
    for width in (1, 4, 64):
        got = g.greedy(g.EdgeKernel(e), rows, 3, rule, per_class=False, width=width).orderBy("rank").collect()
        assert [r.id for r in got] == want
    within = g.greedy(g.EdgeKernel(e.filter("i % 3 = j % 3")), rows, 3, rule).collect()
    for c in range(3):
        own = [i for i in range(n) if label[i] == c]
        alone = plain_greedy(k[np.ix_(own, own)], imp[own], [0] * len(own), 3, rule)
        assert [r.id for r in sorted(within, key=lambda r: r["rank"]) if r.label == c] == [own[i] for i in alone]


@pytest.mark.parametrize("by_label", [False, True])
def test_cosine_kernel_looks_into_few_candidates(spark, monkeypatch, by_label):
    rng = np.random.default_rng(5)
    n = 300
    v = rng.normal(size=(n, 6)) * 0.3 + rng.normal(size=(30, 6))[np.arange(n) % 30]  # 30 clusters
    v[7] = v[3]  # a tie
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = [i % 2 for i in range(n)]
    df = spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(n)], "id long, label long, v array<double>")
    rows = df.select("id", "label", F.lit(1.0).alias("imp"))
    k = u @ u.T
    if by_label:
        alone = {c: [i for i in range(n) if label[i] == c] for c in (0, 1)}
        want = {c: [own[i] for i in plain_greedy(k[np.ix_(own, own)], np.ones(len(own)), [0] * len(own), 5, g.FACILITY)] for c, own in alone.items()}
    else:
        want = {None: plain_greedy(k, np.ones(n), label, 5, g.FACILITY)}
    monkeypatch.setattr(g, "PENDING", 3)
    for width, fresh in ((8, g.FRESH), (64, 20)):
        monkeypatch.setattr(g, "FRESH", fresh)
        report = []
        got = g.greedy(g.CosineKernel(df, by_label), rows, 5, per_class=by_label, width=width, report=report).orderBy("rank").collect()
        for c, ids in want.items():
            assert [r.id for r in got if c is None or r.label == c] == ids
        if width == 8 and not by_label:
            assert sum(looked for _, looked in report[2:]) < 0.8 * n * len(report[2:])


@pytest.mark.parametrize("by_label", [False, True])
def test_a_round_passes_over_all_pairs_once_at_most(spark, monkeypatch, by_label):
    rng = np.random.default_rng(8)
    n = 120
    v = rng.normal(size=(n, 6))
    v[7] = v[3]  # a tie
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = [None if i % 3 == 0 else i % 2 for i in range(n)]
    df = spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(n)], "id long, label long, v array<double>")
    k = u @ u.T
    monkeypatch.setattr(g, "PASS", 8)
    monkeypatch.setattr(g, "FRESH", 16)
    passes, own = [], g.CosineKernel.bounds
    monkeypatch.setattr(g.CosineKernel, "bounds", lambda self, among=None: (passes.append(among is not None), own(self, among))[1])
    report = []
    got = g.greedy(g.CosineKernel(df, by_label), df.select("id", "label", F.lit(1.0).alias("imp")), 2, per_class=by_label, width=4, report=report).orderBy("rank").collect()
    assert 0 < sum(passes) <= len(report)
    if by_label:
        for c in (None, 0, 1):
            alone = [i for i in range(n) if label[i] == c]
            want = plain_greedy(k[np.ix_(alone, alone)], np.ones(len(alone)), [0] * len(alone), 2, g.FACILITY)
            assert [r.id for r in got if r.label == c] == [alone[i] for i in want]
    else:
        assert [r.id for r in got] == plain_greedy(k, np.ones(n), label, 2, g.FACILITY)


@pytest.mark.parametrize("rule", [g.FACILITY, g.COVERAGE, g.REACH])
def test_walk_kernel_equals_its_matrix(spark, monkeypatch, rule):
    rng = np.random.default_rng(6)
    n = 40
    a = np.where(rng.random((n, n)) < 0.08, rng.random((n, n)), 0.0)
    a[:, 5], a[5, :], a[39] = rng.random(n), 0.0, 0.0  # a hub, a node without ways out
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    scale = [0.85**t for t in range(5)]
    r = sum(c * np.linalg.matrix_power(p, t) for t, c in enumerate(scale))
    row_max = rule is not g.COVERAGE
    r = r / r.max(1, keepdims=True) if row_max else r
    imp, label = rng.random(n), [i % 2 for i in range(n)]
    edges = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n) if p[i, j]], "src long, dst long, w double")
    rows = spark.createDataFrame([(i, label[i], float(imp[i])) for i in range(n)], "id long, label long, imp double")
    want = plain_greedy(r.T, imp, label, 4, rule)
    for width, held, most in ((20, 8, 0), (64, 1024, g.BROADCAST_EDGES)):  # by joins, in tasks
        monkeypatch.setattr(g, "BROADCAST_EDGES", most)
        kernel = g.WalkKernel(edges, scale, row_max, held=held)
        got = g.greedy(kernel, rows, 4, rule, per_class=False, width=width).orderBy("rank").collect()
        assert [x.id for x in got] == want
        assert len(kernel.held) <= max(held, n)


def test_losses_by_pairs_prove_picks():
    rng = np.random.default_rng(7)
    for rule in (g.FACILITY, g.COVERAGE, g.REACH):
        for _ in range(20):
            n, m = 60, 12
            w, imp = np.where(rng.random((n, m)) < 0.15, rng.random((n, m)), 0), rng.random(n)
            s = np.full(n, rule.start) * rng.random(n)
            now = g.Sums([[(i, 0) for i in range(m)]], rule)
            now.add(0, w, s, imp)
            picks = g.certain(list(range(m)), [0] * m, now.gains[0], now.losses[0], {0: m}, None, None, rule.positive)
            left = [*range(m)]
            for p in picks:
                gains = {j: float((imp * rule.gain(w[:, j], s)).sum()) for j in left}
                assert p == min(left, key=lambda j: (-gains[j], j))
                s = rule.after(w[:, p], s)
                left.remove(p)
            assert len(picks) > 1


def test_classes_smaller_than_the_budget(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    for name in ("random", "prototype", "facility", "fps", "herding", "graph_a2", "graph_fps", "graph_facility"):
        assert {r.id for r in methods.select(df, name, 5).collect()} == {0, 1, 2}, name
        assert methods.select(df, name, 0).count() == 0, name


def test_dispatch_errors(spark):
    df = nodes(spark, 3)
    with pytest.raises(ValueError, match="unknown method"):
        methods.select(df, "nothing", 1)
    with pytest.raises(ValueError, match="needs"):
        methods.select(df, "fps", 1)
    with pytest.raises(ValueError, match="importance must be"):
        methods.register_method("x", importance="sometimes")
    with pytest.raises(ValueError, match="rows of"):
        methods.select(df, "random_proportional", 9)
    assert len(methods.METHODS) == 29


def test_sweep_goes_on_after_a_failure(spark):
    df = nodes(spark, 6).withColumn("v", F.array(F.col("id").cast("double"), F.lit(1.0)))
    assert sweep.valid_configs(["random", "fps", "eva"], {"a": df, "b": df.drop("v")}) == [("random", "none"), ("fps", "a")]
    assert sweep.resolve_dependencies(["eva"], ["a"]) == ["a", "trained"]
    out, failures = sweep.selection_sweep({"a": df}, ["random", "random_proportional"], [0.5], trials=2)
    assert failures == [] and out.groupBy("method", "trial").count().count() == 4


def test_sweep_shares_graphs_and_runs_and_records_failures_of_tasks(spark, monkeypatch):
    rows = [(i, i % 2, [float(i % 5) + 0.1, float(i * i % 7), 1.0], float(i % 4)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>, el2n double")
    graphs, runs, real_graph, real_select = [], [], methods.knn_graph, sweep.select
    monkeypatch.setattr(methods, "knn_graph", lambda df, k, by_label=False: graphs.append((k, by_label)) or real_graph(df, k, by_label))
    monkeypatch.setattr(sweep, "select", lambda df, method, *a, **b: runs.append(method) or real_select(df, method, *a, **b))
    names, ratios = ["graph_density", "graph_a1", "graph_a2", "el2n_mid", "fps"], [0.25, 0.5]
    out, failures = sweep.selection_sweep({"a": df}, names, ratios, trials=2)
    assert failures == [] and graphs == [(10, True)]  # one for three methods and two ratios
    assert sorted(runs) == ["el2n_mid", "el2n_mid", "fps", "fps", "graph_a1", "graph_a2", "graph_density"]
    for name in names:
        for ratio, budget in ((0.25, 3), (0.5, 6)):
            for trial in (0, 1):
                got = sorted((r.id, r["rank"]) for r in out.filter((F.col("method") == name) & (F.col("ratio") == ratio) & (F.col("trial") == trial)).collect())
                assert got == sorted((r.id, r["rank"]) for r in real_select(df, name, budget, seed=42 + trial).collect()), (name, ratio, trial)
    assert methods.SHARED.get() is None
    bad = df.withColumn("el2n", F.when(F.col("id") == 3, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("el2n")))
    out, failures = sweep.selection_sweep({"a": bad}, ["el2n_top", "prototype"], [0.25])
    assert [f["method"] for f in failures] == ["el2n_top"] and "broken row" in failures[0]["error"] and {r.method for r in out.collect()} == {"prototype"}


def test_sweep_with_importance(spark):
    from corepick.operators.importance import compute_importance
    from corepick.operators.knn import knn_graph

    rows = [(i, i % 2, [float(i % 5) + 0.1, float(i * i % 7), 1.0], float(i * 5 % 11)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>, el2n double")
    base, trained = df.drop("el2n"), df.drop("v")
    assert sweep.resolve_dependencies(["facility"], ["base"], ["el2n_easy"]) == ["base", "trained"]
    assert sweep.resolve_dependencies(["facility"], ["base"], ["centrality"]) == ["base"]
    picks = lambda out, **where: sorted((r.id, r["rank"]) for r in out.collect() if all(r[c] == v for c, v in where.items()))
    out, failures = sweep.selection_sweep({"base": base, "trained": trained}, ["facility", "prototype"], [0.25], trials=2, importances=["el2n_hard", "variance_low"])
    assert {(f["method"], f["importance"]) for f in failures} == {("facility", "variance_low")}  # no source has what it needs
    joined = base.join(compute_importance(trained, "el2n_hard"), "id")
    want = sorted((r.id, r["rank"]) for r in methods.select(joined, "facility", 3, "importance").collect())
    assert picks(out, method="facility", importance="el2n_hard", trial=1) == want
    assert picks(out, method="prototype", importance="variance_low", trial=0) == picks(out, method="prototype", importance="el2n_hard", trial=1)
    spread = graph.propagate_importance(compute_importance(trained, "el2n_hard"), graph.adjacency(knn_graph(base, 3)), iterations=3)
    want = sorted((r.id, r["rank"]) for r in methods.select(base.join(spread, "id"), "greedy_importance", 3, "importance").collect())
    out, failures = sweep.selection_sweep({"base": base, "trained": trained}, ["greedy_importance"], [0.25], importances=["el2n_hard"], propagate=True, k=3, iterations=3)
    assert failures == [] and picks(out) == want
    with pytest.warns(UserWarning, match="no importance"):
        methods.select(df, "greedy_importance", 1)


def test_loops_move_vectors_and_not_edges(spark, monkeypatch):
    rows = [(0, i, 1.0) for i in range(1, 400)] + [(i, 0, 1.0) for i in range(1, 400)] + [(i, i % 7, 2.0) for i in range(10, 90)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    nodes = spark.range(400)
    start = nodes.select("id", (F.col("id") / 400).alias("importance"))
    whole = [{r.id: r.importance for r in f.collect()} for f in (graph.pagerank(edges, nodes, iterations=5), graph.propagate_importance(start, edges, iterations=3))]
    a = np.zeros((400, 400))
    for s, d, w in ((r.src, r.dst, r.w) for r in edges.collect()):
        a[s, d] = w
    p = a / a.sum(axis=1, keepdims=True)
    x = np.full(400, 1 / 400)
    for _ in range(5):
        x = 0.15 / 400 + 0.85 * x @ p
    assert np.allclose([whole[0][i] for i in range(400)], x)
    reach, y0 = sum(0.85**t * np.linalg.matrix_power(p, t) for t in range(6)), np.arange(400) / 400
    y = y0
    for _ in range(3):
        y = 0.5 * y0 + 0.5 * y @ reach / sum(0.85**t for t in range(6))
    assert np.allclose([whole[1][i] for i in range(400)], y)
    monkeypatch.setattr(graph, "hubs", lambda e, degree=50, hubs=graph.hubs: hubs(e, degree))
    split = [{r.id: r.importance for r in f.collect()} for f in (graph.pagerank(edges, nodes, iterations=5), graph.propagate_importance(start, edges, iterations=3))]
    assert all(np.allclose([w[i] for i in range(400)], [s[i] for i in range(400)]) for w, s in zip(whole, split))
    laid, hubs = graph.laid_out(edges)
    sizes = [r.n for r in laid.groupBy("src", "part").agg(F.count("*").alias("n")).collect()]
    assert hubs is not None and max(sizes) < 120
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.undo()
        laid, hubs = graph.laid_out(edges)
        x = cut(nodes.select("id", F.lit(1.0).alias("x")))
        plan = graph.vecmat(x, laid, hubs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the vector moves to the edges, and sums move to their rows
    assert plan.count("Exchange hashpartitioning(") == 2, plan


def test_dynamics(spark):
    rows = [(1, e, 0, [0.9, 0.1] if e % 2 else [0.2, 0.8], [0.9, 0.1] if e % 2 else [0.2, 0.8]) for e in range(1, 7)]
    m = dynamics.epoch_metrics(spark.createDataFrame(rows, "id long, epoch int, label long, logits array<double>, probs array<double>"))
    assert dynamics.forgetting_scores(m).first().score == 3.0
    assert dynamics.window_variance(m, 50, 5).first().variance is None
    assert dynamics.el2n_scores(m, 12, "zero").first().score == pytest.approx(dynamics.el2n_scores(m).first().score / 2)


def test_spearman_and_overlap(spark):
    a = spark.createDataFrame([(i, float(i // 2)) for i in range(9)], "id long, x double")
    b = a.select("id", (-F.col("x")).alias("x"))
    assert graph.spearman(a, b).first().rho == pytest.approx(-1.0)
    assert graph.spearman(a.limit(2), b.limit(2)).first().rho is None
    empty = a.filter("id < 0")
    assert tuple(compare.overlap(a, empty).first()) == (0.0, 0.0) and compare.overlap(empty, empty).first().jaccard is None


def test_uniform_scores(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0)], "id long, label long, importance double")
    assert scores.is_uniform(df, "importance").first()[0] is True
    assert {r.importance for r in scores.min_max_normalize(df, "importance").collect()} == {1.0}
    assert metrics.class_distribution(df).first().imbalance == 1.0


def test_selection_round_trip_and_tampering(spark, tmp_path):
    config = {"dataset": "d", "ratio_bp": "r0500bp", "method": "m", "embedding": "e", "seed": 1, "trial": 1}
    df = spark.createDataFrame([(7, 0, 1), (2, 0, 2), (11, 1, 3)], "id long, label long, rank int")
    digest = artifacts.write_selection(df, str(tmp_path), config).first().digest
    assert [r.id for r in artifacts.read_selection(spark, str(tmp_path), config, digest).orderBy("rank").collect()] == [7, 2, 11]
    with pytest.raises(ValueError, match="digest"):
        artifacts.read_selection(spark, str(tmp_path), config, "0" * 64)
    with pytest.raises(ValueError, match="unique"):
        artifacts.write_selection(spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "id long, label long, rank int"), str(tmp_path), config)
    with pytest.raises(ValueError, match="split"):
        samples.read_samples(spark, f"{tmp_path}/selections", "other")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        samples.read_samples(spark, f"{tmp_path}/nothing")


@pytest.mark.parametrize("by_label", [False, True])
def test_grid_of_blocks(spark, by_label):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (70, 3)).astype(float)  # many ties
    labels = [None if i % 9 == 0 else i % 2 for i in range(70)]
    df = spark.createDataFrame([(i, labels[i], v[i].tolist()) for i in range(70)] + [(70, 1, None)], "id long, label long, v array<double>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm == 0, 1, norm)
    cos = u @ u.T
    want = set()
    for i in range(70):
        others = [j for j in range(70) if j != i and (not by_label or labels[i] == labels[j])]
        for r, j in enumerate(sorted(others, key=lambda j: (round(2 - 2 * cos[i, j], 9), j))[:4]):
            want.add((i, r + 1, round(2 - 2 * cos[i, j], 6)))
    for block in (7, 4096):
        got = knn.knn_graph(df, 4, by_label, block).collect()
        assert {(r.src, r["rank"], round(r.dist, 6)) for r in got} == want and len(got) == len(want)
    if not by_label:
        e = np.exp(cos[:50, 50:] / 0.1)  # queries are the last twenty
        share = e / e.sum(0)
        train, queries = df.filter("id < 50"), df.filter("id >= 50")
        for block in (7, 4096):
            got = {r.id: r.importance for r in knn.cross_attention(train, queries, block=block).collect()}
            assert np.allclose([got[i] for i in range(50)], share.sum(1))
            stats = knn.attention_stats(train, queries, block=block).first()
            assert np.allclose([stats.mean_entropy, stats.top1_mass, stats.top10_mass], [-(share * np.log(share)).sum(0).mean(), share.max(0).mean(), np.sort(share, 0)[-10:].sum(0).mean()])
    assert knn.knn_graph(df.filter("id < 0"), 4, by_label).count() == 0


@pytest.mark.parametrize("by_label", [False, True])
def test_pivots_skip_what_cannot_be_near(spark, by_label):
    rng = np.random.default_rng(8)
    n = 600
    centres = rng.normal(size=(12, 8))
    v = centres[np.arange(n) % 12] + 0.05 * rng.normal(size=(n, 8))
    v[5], v[6], v[77] = 0.0, 0.0, v[65]  # no direction, and a tie
    labels = [i % 2 if i % 50 else None for i in range(n)]
    df = spark.createDataFrame([(i, labels[i], v[i].tolist()) for i in range(n)], "id long, label long, v array<double>")
    tuples = lambda x: sorted((r.src, r.dst, r["rank"]) for r in x.collect())
    report: list = []
    got = tuples(knn.knn_graph(df, 5, by_label, 40, report))
    assert got == tuples(knn.knn_graph(df, 5, by_label))
    every, computed = (x.value for x in report)
    assert 0 < computed < (0.8 if by_label else 0.5) * every, (computed, every)


def test_ranks_without_a_task_that_sorts_a_class(spark):
    from corepick.operators import ranks

    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, 900).astype(float)
    labels = [None if i % 100 == 0 else 0 if i % 10 else 1 for i in range(900)]  # a class of nine tenths
    df = spark.createDataFrame([(i, labels[i], float(x[i])) for i in range(900)], "id long, label long, x double")
    got = {r.id: (r.place_, r.size_) for r in ranks.placed(df, ["label"], ["x", "id"]).collect()}
    for c in (None, 0, 1):
        own = sorted((x[i], i) for i in range(900) if labels[i] == c)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    assert np.allclose(ranks.percentiles(df, "x", shares).first().p, np.percentile(x, [100 * p for p in shares]))
    assert ranks.percentiles(df.filter("id < 0"), "x", [0.5]).first().p == [None]
    plan = compare.stratified_subsample(df.filter("label IS NOT NULL"), 50)._jdf.queryExecution().toString()
    assert not re.search(r"windowspecdefinition\(label#\d+L?, h_", plan) and "h_" in plan


def test_no_value_lies_beyond_a_percentile_that_equals_it(spark):
    # 0.2 * 6.44 + 0.8 * 6.44 is more than 6.44
    for n, x in ((3, 6.44), (8, 114.3)):
        row = dynamics.describe_scores(spark.createDataFrame([(x,)] * n, "score double")).first()
        assert [row.p10, row.p25, row.p50, row.p75, row.p90, row.p99] == [x] * 6
        assert (row.above_p90, row.below_p10) == (0, 0)


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 50)
    n = 400  # a star; its centre is 0
    pairs = [(0, i, 0.5 + i / n) for i in range(1, n)] + [(i, 0, 1.0) for i in range(1, n)] + [(7, 8, 1.0)]
    e = spark.createDataFrame(pairs, "src long, dst long, w double")
    split = graph.hubs(e, 50)
    assert [(r.hub, r.parts) for r in split.collect()] == [(0, 8)]
    a = np.zeros((n, n))
    for i, j, w in pairs:
        a[i, j] = w
    got = graph.matmul(e, e, split=split).collect()
    out = np.zeros((n, n))
    for r in got:
        out[r.src, r.dst] = r.w
    assert np.allclose(out, a @ a) and len(got) == np.count_nonzero(a @ a)
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        left, right = e.selectExpr("src", "dst AS via", "w AS wa"), e.selectExpr("src AS via", "dst", "w AS wb")
        tasks = lambda s: sorted(r["count"] for r in graph.through(left, right, s).groupBy(F.spark_partition_id().alias("p")).count().collect())
        whole, parts = tasks(None), tasks(split)
        assert sum(whole) == sum(parts) and max(whole) > 0.95 * sum(whole) and max(parts) < 0.7 * sum(parts)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert graph.k_hop_neighbors(e, 2).count() == n * n


def test_writes_of_selections_count_once_and_whole(spark, tmp_path, monkeypatch):
    config = {"dataset": "d", "ratio_bp": "r0500bp", "method": "m", "embedding": "e", "seed": 1, "trial": 1}
    rows = lambda *ids: spark.createDataFrame([(i, 0, k + 1) for k, i in enumerate(ids)], "id long, label long, rank int")
    base, ids = str(tmp_path), lambda c: [r.id for r in artifacts.read_selection(spark, str(tmp_path), c).orderBy("rank").collect()]
    first = artifacts.write_selection(rows(3, 1), base, config).first()
    assert artifacts.write_selection(rows(3, 1), base, config).first() == first  # the same again
    other = {**config, "trial": 2}
    artifacts.write_selection(rows(9), base, other)

    def broken(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # between the rows and their manifest
        real, calls = artifacts.digest_of, []
        m.setattr(artifacts, "digest_of", lambda *a: broken() if calls.append(1) or len(calls) > 1 else real(*a))
        with pytest.raises(RuntimeError):
            artifacts.write_selection(rows(5, 6, 7), base, config)
    assert ids(config) == [3, 1] and ids(other) == [9]
    artifacts.write_selection(rows(5, 6, 7), base, config)
    assert ids(config) == [5, 6, 7] and ids(other) == [9]
    assert artifacts.read_selections(spark, base).count() == 4
    status = artifacts.verify_selections(artifacts.read_selections(spark, base), artifacts.read_manifests(spark, base)).collect()
    assert [r.status for r in status] == ["ok", "ok"]
    with pytest.raises(ValueError, match="no selection"):
        artifacts.read_selection(spark, base, {**config, "trial": 3})


def test_steps_in_a_task_equal_steps_by_jobs(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, 0 if i < 40 else 1 if i < 50 else 2, rng.normal(size=4).tolist(), float(rng.random())) for i in range(53)]
    rows += [(60, 0, rows[3][2], 0.5), (61, 0, rows[3][2], 0.5)]  # ties
    df = spark.createDataFrame(rows, "id long, label long, v array<double>, importance double")
    found = {}
    for held in (1 << 23, 100, 0):  # all classes in tasks, the largest by jobs, all by jobs
        monkeypatch.setattr(g, "HELD", held)
        found[held] = [sorted((r.id, r.label, r["rank"]) for r in out.collect()) for out in (g.herding(df, 5), g.weighted_farthest_points(df, 5, df))]
    assert found[1 << 23] == found[100] == found[0] and len(found[0][0]) == len(found[0][1]) == 13


def test_overlaps_from_bitmaps(spark):
    rng = np.random.default_rng(11)
    sets = {f"c{k:02d}": {*rng.choice([*range(-70, 300), 10**12, 65_535, 65_536, 2**63 - 1, -(2**63)], 150, replace=False).tolist()} for k in range(20)}
    sets["other"] = {10**15}
    rows = [(c, int(i)) for c, ids in sets.items() for i in [*ids, *list(ids)[:3]]]  # some twice
    got = {(r.a, r.b): r.overlap_pct for r in compare.overlap_matrix(spark.createDataFrame(rows, "config string, id long")).collect()}
    assert got == pytest.approx({(a, b): len(sets[a] & sets[b]) / len(sets[a]) * 100 for a in sets for b in sets})


def test_kernel_validation_equals_numpy(spark):
    rng = np.random.default_rng(12)
    n, k, t = 60, 4, 0.7
    v = rng.normal(size=(n, 5))
    df = spark.createDataFrame([(i, i % 2, v[i].tolist()) for i in range(n)], "id long, label long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 2 * (1 - u @ u.T)
    np.fill_diagonal(dist, np.inf)
    a = np.zeros((n, n))
    for i in range(n):
        for j in np.argsort(dist[i])[:k]:
            a[i, j] = min(1.0, max(0.0, 1 - dist[i, j] / 2))
    a = np.maximum(a, a.T)
    d = 1 / np.sqrt(a.sum(1))
    a = d[:, None] * a * d[None, :]
    heat, term = np.zeros((n, n)), np.eye(n)
    for i in range(13):
        heat, term = heat + np.exp(-t) * term, term @ a * t / (i + 1)
    a2 = a + a @ a
    rank = lambda x: np.array([(np.sum(x < y) + np.sum(x <= y) + 1) / 2 for y in x])
    picks = [plain_greedy(m, np.ones(n), [i % 2 for i in range(n)], 5, g.FACILITY) for m in (heat, a2)]
    both = sorted({*picks[0]} & {*picks[1]})
    order = [rank(np.array([p.index(i) for i in both], float)) for p in picks]
    got = sweep.validate_kernel(df, 5, k, t).first()
    assert got.row_sum_rho == pytest.approx(np.corrcoef(rank(heat.sum(1)), rank(a2.sum(1)))[0, 1])
    assert got.order_rho == pytest.approx(np.corrcoef(*order)[0, 1]) and got.overlap_pct == pytest.approx(len(both) / 10 * 100)
    assert got.jaccard == pytest.approx(len(both) / (20 - len(both)))


def test_probe_and_projection_equal_numpy(spark):
    from corepick.operators import probe

    rng = np.random.default_rng(13)
    n = 120
    label = rng.integers(0, 3, n)
    v = rng.normal(size=(n, 4)) + 1.2 * np.eye(4)[label]
    rows = [(i, int(label[i]), v[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    train, test = df.filter("id < 80"), df.filter("id >= 80")
    x, y, w, b = v[:80], np.eye(3)[label[:80]], np.zeros((4, 3)), np.zeros(3)
    for _ in range(20_000):  # sum of losses and half the squared weights
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        off = p / p.sum(1, keepdims=True) - y
        w, b = w - 0.01 * (x.T @ off + w), b - 0.01 * off.sum(0)
    pred = (v[80:] @ w + b).argmax(1)
    got = probe.linear_probe(train, test).first()
    assert got.accuracy == pytest.approx((pred == label[80:]).mean())
    centred = v - v.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    plane = centred @ axes.T
    chosen = spark.createDataFrame([("b", 3), ("a", 3), ("a", 5)], "config string, id long")
    out = {r.id: r for r in probe.project_2d(df, chosen).collect()}
    assert np.allclose([[out[i].x, out[i].y] for i in range(n)], plane)
    assert out[3].picked_by == ["a", "b"] and out[5].picked_by == ["a"] and out[4].picked_by is None


def test_greedy_rounds_move_no_edges_and_deal_large_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = [(int(i), int(j), float(rng.random())) for i in range(12) for j in range(12) if i < 2 or rng.random() < 0.3]
    edges = spark.createDataFrame(cells, "i long, j long, w double")
    nodes = spark.range(12).selectExpr("id", "0L AS label", "1.0D AS imp")
    kernel = g.EdgeKernel(edges)
    want = sorted(tuple(r) for r in g.greedy(kernel, nodes, 3, per_class=False).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the small state is broadcast
    try:
        plan = kernel._with_state(kernel.edges)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    own = graph.hubs
    monkeypatch.setattr(graph, "hubs", lambda edges: own(edges, 6))
    split = g.EdgeKernel(edges)
    assert {r.hub for r in split.large_rows.collect()} >= {0, 1}
    assert sorted(tuple(r) for r in g.greedy(split, nodes, 3, per_class=False).collect()) == want


def test_hop_cosines_over_several_blocks(spark):
    rng = np.random.default_rng(10)
    n = 60
    v = rng.normal(size=(n, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = [None if i % 3 == 0 else i % 2 for i in range(n)]
    df = spark.createDataFrame([(i, label[i], v[i].tolist()) for i in range(n)] + [(n, 1, None)], "id long, label long, v array<double>")
    want = {tuple(r) for r in graph.k_hop_neighbors(knn.knn_graph(df, 3, by_label=True), 2).collect()}
    got = {(r.src, r.dst): r.cos for r in methods.hop_cosines(df, 3, 2, block=8).collect()}
    assert set(got) == want and all(abs(c - u[i] @ u[j]) < 1e-12 for (i, j), c in got.items())
