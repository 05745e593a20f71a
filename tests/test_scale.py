"""What bounds the work and memory of tasks on larger tables."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corepick.operators import graph, greedy, knn, methods


def vectors(spark, n, classes=2, width=8):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(i, int(i % classes), rng.normal(size=width).tolist()) for i in range(n)], "id long, label long, v array<double>")


def test_blocks_are_multiplied_by_tiles():
    seen = []

    def work(a, b):
        seen.append(len(a["id"]))
        return {"id": a["id"], "sum": (a["u"] @ b["u"].T).sum(1)}

    n = 2 * knn.TILE + 3
    a, b = ({"id": np.arange(m), "u": np.random.default_rng(m).normal(size=(m, 4))} for m in (n, 50))
    out = knn.by_tiles(work)(a, b)
    assert seen == [knn.TILE, knn.TILE, 3]
    assert out["id"].tolist() == list(range(n)) and np.allclose(out["sum"], (a["u"] @ b["u"].T).sum(1))


def test_cells_of_the_grid_of_blocks_are_dealt_evenly(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else partitions without rows are left out
    try:
        for by_label in (False, True):
            u = vectors(spark, 600, 3).withColumnRenamed("v", "u")
            work = lambda a, b: {"id": a["id"][:1], "pairs": np.array([len(a["id"]) * len(b["id"])])}
            out = knn.blocked(u, u, work, "id long, pairs long", by_label, block=10)
            dealt = [r.n for r in out.groupBy(F.spark_partition_id().alias("to")).agg(F.sum("pairs").alias("n")).collect()]
            assert sum(dealt) == (3 * 200**2 if by_label else 600**2)
            parts = out.rdd.getNumPartitions()
            assert len(dealt) > 2 * spark.sparkContext.defaultParallelism  # not dealt anew for the join, into fewer
            if not by_label:
                assert len(dealt) == parts and max(dealt) < 2.5 * 600**2 / parts
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_classes_share_the_cells_of_the_grid(spark):
    many = vectors(spark, 400, 20).select("id", F.col("label").alias("scope"), F.col("v").alias("u"))
    sizes, tasks = knn._sizes(many, many, 4, 32).collect(), 32
    assert len(sizes) == 20 and sum(r.strips * r.slabs for r in sizes) <= 4 * tasks
    assert all(1 <= r.strips <= r.lefts and 1 <= r.slabs <= r.rights for r in sizes)


def path(spark, n):
    pairs = [(i, i + 1) for i in range(n - 1)]
    return spark.createDataFrame([(a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))], "src long, dst long, w double")


def test_spreading_takes_all_steps_without_a_tolerance(spark):
    start = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 0.0)], "id long, importance double")
    ten, nine, tenth = ({r.id: r.importance for r in graph.propagate_importance(start, path(spark, 3), iterations=n, tol=tol).collect()} for n, tol in ((10, 0.0), (9, 0.0), (10, 1.0)))
    assert ten != nine and tenth != ten


def test_a_walk_is_planned_once(spark):
    p, _ = graph.laid_out(path(spark, 4))
    x = spark.range(4).select("id", F.lit(1.0).alias("x"))
    plan = graph.reach_sum(p, x, 5, 0.85, transposed=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5


def test_dealt_rows_are_sorted_for_merge_joins(spark):
    p, _ = graph.laid_out(path(spark, 50))
    assert "src" in p._jdf.queryExecution().executedPlan().outputOrdering().toString()


def test_default_spreading_query_takes_ten_steps(spark):
    from tests.test_queries import rows, run_sql

    from corepick.plans import registry
    import tests.test_queries as q

    q.SF, before = "/root/testdata/sf0.01", q.SF
    try:
        name = "g8_propagate_importance_default"
        assert rows(registry.queries()[name](spark, q.SF).toPandas()) == rows(run_sql(registry.oracle_sql()[name]))
    finally:
        q.SF = before


def as_map(edges):
    return {(r.src, r.dst): r.w for r in edges.collect()}


def test_matrix_rows_in_tasks_equal_joins(spark, monkeypatch):
    e = path(spark, 7).union(spark.createDataFrame([(0, 3, 0.5), (3, 0, 0.5), (9, 9, 1.0)], "src long, dst long, w double"))
    nodes, sym = spark.range(9), graph.sym_normalize(e)
    make = lambda: [as_map(x) for x in (graph.power_sum_kernel(sym, 3), graph.heat_kernel(sym, nodes), graph.reachability(e, nodes, 4), graph.reachability(e, nodes, 4, row_max=True))]
    in_tasks = make()
    plan = graph.reachability(e, nodes, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    for a, b in zip(in_tasks, make()):
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


@pytest.mark.parametrize("hops", [3, 5])
def test_power_sums_are_picked_from_without_their_matrix(spark, monkeypatch, hops):
    df = vectors(spark, 40)
    sym = methods.normalized_graph(df, 4, False)
    want = greedy.greedy(greedy.EdgeKernel(methods._as_columns(graph.power_sum_kernel(sym, hops))), methods._nodes(df, None), 4).collect()
    monkeypatch.setattr(graph, "power_sum_kernel", lambda *a: pytest.fail("the matrix was built"))
    assert sorted(methods.select(df, f"graph_a{hops}", 4, k=4).collect()) == sorted(want)


def test_graph_fps_moves_no_vectors_for_all_pairs(spark, monkeypatch):
    df = vectors(spark, 30)
    edges = {(r.src, r.dst): 1 - r.cos for r in methods.hop_cosines(df, 3, 2).collect()}
    monkeypatch.setattr(methods, "hop_cosines", lambda *a: pytest.fail("all pairs were measured"))
    got = {}
    for r in sorted(methods.select(df, "graph_fps", 5, k=3).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.label, []).append(r.id)
    for c, picks in got.items():
        d = {i: 2.0 for i in range(30) if i % 2 == c and i != picks[0]}
        for last, then in zip(picks, picks[1:]):
            d = {i: min(x, edges.get((last, i), 2.0)) for i, x in d.items() if i != last}
            assert then == min(d, key=lambda i: (-round(d[i], 12), i))


@pytest.mark.parametrize("rule", [greedy.REACH, greedy.FACILITY])
def test_bounds_of_influence_know_the_entry_that_divides_a_row(spark, rule):
    n, rng = 9, np.random.default_rng(3)
    imp, a = rng.random(n), np.zeros((n, n))
    for i, j in [(i, i + 1) for i in range(n - 2)] + [(0, 4), (2, 6)]:  # the last has no edges
        a[i, j] = a[j, i] = 1 + i
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    edges = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n) if p[i, j]], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, 0, float(imp[i])) for i in range(n)], "id long, label long, imp double")
    for walk in (0, 2, 5):
        r = sum(0.85**t * np.linalg.matrix_power(p, t) for t in range(walk + 1))
        kernel = greedy.WalkKernel(edges, [0.85**t for t in range(walk + 1)], row_max=True)
        kernel.begin(nodes, rule, False)
        gain, got = (r / r.max(1, keepdims=True)) @ imp, {x.id: x.gain for x in kernel.bounds().collect()}
        bound, plain = np.array([got[i] for i in range(n)]), r @ imp
        assert (bound >= gain * (1 - 1e-12)).all()
        # as good as the gain itself where walks end after two steps
        assert np.allclose(bound, gain) if walk < 3 else (bound - gain).sum() < 0.7 * (plain - gain).sum()


def test_the_driver_holds_little_beside_the_edges_of_a_matrix():
    rng, n = np.random.default_rng(2), 1_000_000
    src, dst, w = rng.integers(0, 80_000, n) * 3, rng.integers(0, 80_000, n) * 3, rng.random(n)
    tracemalloc.start()
    small = graph.SmallMatrix.of(src, dst, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n
    assert np.array_equal(np.repeat(small.ids, np.diff(small.starts)), np.sort(src)) and np.array_equal(np.sort(small.ids[small.to]), np.sort(dst))


def test_rows_of_three_powers_come_from_tasks_beyond_the_edges_of_two(spark, monkeypatch):
    p = spark.createDataFrame([(i, (i + d) % 9, 1.0) for i in range(9) for d in (1, 2)], "src long, dst long, w double")
    want = {(r.src, r.dst): r.w for r in graph.reachability(p, spark.range(9), 3).collect()}
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 6)
    monkeypatch.setattr(graph, "matmul", None)
    got = {(r.src, r.dst): r.w for r in graph.reachability(p, spark.range(9), 3).collect()}
    assert got == want and len(got) == 9 * 7
