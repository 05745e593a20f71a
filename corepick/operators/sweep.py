"""Sweeps over methods, parameters and sources, and comparisons of what they select."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.functions.scores import budget_per_class
from corepick.operators import compare, graph
from corepick.operators import greedy as g
from corepick.operators.importance import NEEDS, compute_importance
from corepick.operators.knn import knn_graph
from corepick.operators.methods import METHODS, SHARED, _as_columns, _nodes, select
from corepick.operators.runtime import cut

#: Columns that only a trained source has.
TRAINED = {"eva", "aum", "forgetting", "el2n", "conf_var", "conf_mean"}
#: Methods whose picks depend on the seed; all others are computed once for all trials.
SEEDED = {"random", "random_proportional", "fps", "graph_fps", "easy_then_diverse", "proto_then_diverse"}

#: Methods of which a smaller budget does not pick the first of what a larger one picks; all others run once, at the largest budget.
NOT_NESTED = {"el2n_mid", "random_proportional", "easy_then_diverse", "proto_then_diverse", "global_influence"}


def resolve_dependencies(methods: list[str], sources: list[str], importances: tuple[str, ...] | list[str] = ()) -> list[str]:
    """The sources, with ``trained`` where a method or an importance metric needs its scores."""
    needs = {c for m in methods for c in METHODS[m].needs} | {c for m in importances for c in NEEDS[m]}
    return sources if not needs & TRAINED or "trained" in sources else [*sources, "trained"]


def valid_configs(methods: list[str], sources: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """(method, source) pairs whose needs the source meets; methods that need no vectors run once, under ``none``."""
    out = []
    for m in methods:
        fit = [s for s, df in sources.items() if {"id", "label", *METHODS[m].needs} <= {*df.columns}]
        if fit and "v" not in METHODS[m].needs:
            out.append((m, "none"))
        else:
            out += [(m, s) for s in fit]
    return out


def _importance(sources: dict[str, DataFrame], first: DataFrame, metric: str, propagate: bool, k: int, queries: DataFrame | None, propagation: dict) -> DataFrame:
    """``id, importance_`` from ``first``, or else from the first source that has what the metric needs."""
    giver = next((df for df in (first, *sources.values()) if {"id", *NEEDS[metric]} <= {*df.columns}), None)
    if giver is None:
        raise ValueError(f"no source has {sorted(NEEDS[metric])} for {metric}")
    values = compute_importance(giver, metric, k=k, queries=queries)
    if propagate:
        if "v" not in first.columns:
            raise ValueError("importance propagates over vectors, and the source has none")
        values = graph.propagate_importance(values, cut(graph.adjacency(knn_graph(first, k))), **propagation)
    return cut(values.select("id", F.col("importance").alias("importance_")))


def selection_sweep(
    sources: dict[str, DataFrame],
    methods: list[str],
    ratios: list[float],
    trials: int = 1,
    seed: int = 42,
    importances: tuple[str, ...] | list[str] = (),
    propagate: bool = False,
    k: int = 10,
    queries: DataFrame | None = None,
    **propagation,
) -> tuple[DataFrame, list[dict]]:
    """``(selections, failures)``: ``method, embedding, importance, ratio, trial, id, label, rank`` of every valid configuration.

    Every method is crossed with every importance metric (``none`` without any); ``propagate`` spreads importance over the
    source's neighbour graph first, with the options of :func:`graph.propagate_importance`. What does not depend on the seed
    or on importance is selected once, smaller budgets are the first ranks of the largest where a method allows it, and
    selections from the same rows share their neighbour graphs. Each selection is run and checkpointed here, so that what
    fails, tasks included, is recorded and the others go on.
    """
    parts, failures = [], []
    made: dict[tuple, DataFrame] = {}
    scored: dict[tuple, DataFrame] = {}
    graphs: dict[tuple, dict] = defaultdict(dict)
    for method, source in valid_configs(methods, sources):
        fit = [df for df in sources.values() if {"id", "label", *METHODS[method].needs} <= {*df.columns}]
        df = sources[source] if source != "none" else fit[0]
        uses = METHODS[method].importance != "ignore"
        name = next(n for n, x in sources.items() if x is df)
        budgets = {r: budget_per_class(df, r).first().budget for r in ratios}
        for ratio, budget in budgets.items():
            most = budget if method in NOT_NESTED else max(budgets.values())
            for metric in importances or ("none",):
                for trial in range(trials):
                    key = (method, source, most, metric if uses else None, trial if method in SEEDED else None)
                    try:
                        if key not in made:
                            pool, column = df, None
                            if uses and metric != "none":
                                which = (name, metric)
                                if which not in scored:
                                    scored[which] = _importance(sources, df, metric, propagate, k, queries, propagation)
                                pool, column = df.join(scored[which], "id"), "importance_"
                            token = SHARED.set(graphs[name, column and metric])
                            try:
                                made[key] = cut(select(pool, method, most, column, seed=seed + trial))
                            finally:
                                SHARED.reset(token)
                        config = {"method": method, "embedding": source, "importance": metric, "ratio": ratio, "trial": trial}
                        parts.append(made[key].filter(F.col("rank") <= budget).select(*(F.lit(v).alias(n) for n, v in config.items()), "id", "label", "rank"))
                    except Exception as e:  # a sweep reports what failed and goes on
                        failures.append({"method": method, "embedding": source, "importance": metric, "ratio": ratio, "trial": trial, "error": str(e)})
    if not parts:
        raise ValueError(f"nothing was selected: {failures}")
    return reduce(DataFrame.union, parts), failures


def named(parts: dict[str, DataFrame]) -> DataFrame:
    return cut(reduce(DataFrame.union, [df.select(F.lit(n).alias("config"), "id", "label", "rank") for n, df in parts.items()]))


def compare_k(samples: DataFrame, ks: list[int], budget: int, hops: int = 2) -> DataFrame:
    """Overlaps of graph selections over several k, from one neighbour join at the largest."""
    knn = cut(knn_graph(samples, max(ks)))
    parts = {}
    for k in ks:
        sym = cut(graph.sym_normalize(cut(graph.adjacency(knn.filter(F.col("rank") <= k)))))
        kernel = _as_columns(graph.power_sum_kernel(sym, hops))
        parts[f"k{k:02d}"] = g.greedy(g.EdgeKernel(kernel), _nodes(samples, None), budget, per_class=False)
    return compare.overlap_matrix(named(parts))


def compare_global(samples: DataFrame, budget: int, method: str = "graph_a2") -> DataFrame:
    """Overlap of the per-class and the global scope of a method, with the class counts of both."""
    a = cut(select(samples, method, budget))
    b = cut(select(samples, method, budget, global_selection=True))
    counts = [compare.selection_class_counts(x, samples).select("label", F.col("n").alias(n)) for x, n in ((a, "n_per_class"), (b, "n_global"))]
    return counts[0].join(counts[1], "label").crossJoin(F.broadcast(compare.overlap(a, b)))


def compare_sources(sources: dict[str, DataFrame], budget: int, method: str = "prototype") -> DataFrame:
    return compare.overlap_matrix(named({n: select(df, method, budget) for n, df in sources.items()}))


def compare_methods(samples: DataFrame, methods: list[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """Overlap matrix, and what only one method picks."""
    s = named({m: select(samples, m, budget) for m in methods})
    return compare.overlap_matrix(s), compare.unique_per_config(s)


def validate_kernel(samples: DataFrame, budget: int, k: int = 10, t: float = 1.0) -> DataFrame:
    """One row: how alike the heat kernel and the sum of two powers are, in row sums, picks and pick order."""
    sym = cut(graph.sym_normalize(cut(graph.adjacency(knn_graph(samples, k)))))
    ones = cut(samples.select("id", F.lit(1.0).alias("x")))
    scales = {"heat": graph.heat_scale(t, 12), "a2": [0.0, 1.0, 1.0]}
    sums = {n: cut(graph.walk_sum(sym, ones, scale)) for n, scale in scales.items()}
    kernels = {"heat": g.WalkKernel(sym, scales["heat"]), "a2": g.EdgeKernel(_as_columns(graph.power_sum_kernel(sym, 2)))}
    picks = {n: cut(g.greedy(kernel, _nodes(samples, None), budget, per_class=False)) for n, kernel in kernels.items()}
    rho = graph.spearman(sums["heat"], sums["a2"]).select(F.col("rho").alias("row_sum_rho"))
    order = graph.spearman(*(picks[n].select("id", F.col("rank").cast("double").alias("x")) for n in ("heat", "a2"))).select(F.col("rho").alias("order_rho"))
    return rho.crossJoin(order).crossJoin(compare.overlap(picks["heat"], picks["a2"]))
