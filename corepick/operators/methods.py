"""Selection methods under one signature, and the registry that dispatches to them."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions import scores
from corepick.functions.vectors import sq_l2
from corepick.operators import graph
from corepick.operators import greedy as g
from corepick.operators.knn import BLOCK, PAIRS, density_of, knn_graph, unit_vectors
from corepick.operators.metrics import class_centroids
from corepick.operators.runtime import cut

IMPORTANCE_MODES = ("ignore", "optional", "required")


@dataclass(frozen=True)
class MethodSpec:
    """``fn(df, budget, importance or None, seed, **kwargs)``; ``needs``: columns beside id and label."""

    fn: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    importance: str = "ignore"
    kwargs: dict = field(default_factory=dict)
    description: str = ""


METHODS: dict[str, MethodSpec] = {}


def register_method(name: str, needs: tuple[str, ...] = (), importance: str = "ignore", description: str = "", **kwargs):
    """Decorator that plugs in a selection method."""
    if importance not in IMPORTANCE_MODES:
        raise ValueError(f"importance must be one of {IMPORTANCE_MODES}")

    def add(fn):
        METHODS[name] = MethodSpec(fn, needs, importance, kwargs, description or (fn.__doc__ or "").strip())
        return fn

    return add


def select(df: DataFrame, method: str, budget_per_class: int, importance_col: str | None = None, seed: int = 42, **overrides) -> DataFrame:
    """``id, label, rank`` by a registered method. Overrides that the method does not declare are ignored, and missing columns
    are an error. A budget of 0 selects nothing. Where a method requires importance and none is given, all rows count alike,
    with a warning."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    spec = METHODS[method]
    missing = [c for c in ("id", "label", *spec.needs) if c not in df.columns]
    if missing:
        raise ValueError(f"{method} needs {missing}")
    importance = None
    if spec.importance == "required" and not importance_col:
        warnings.warn(f"{method} got no importance; all rows count alike", stacklevel=2)
    if spec.importance != "ignore" and (importance_col or spec.importance == "required"):
        column = F.col(importance_col) if importance_col else F.lit(1.0)
        importance = df.select("id", "label", column.cast("double").alias("importance"))
    kwargs = {**spec.kwargs, **{k: v for k, v in overrides.items() if k in spec.kwargs}}
    return spec.fn(df, budget_per_class, importance, seed, **kwargs)


#: Neighbour graphs that several selections from the same rows share, while it is set: the tables by ``(k, by label)``.
SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


def neighbours(df: DataFrame, k: int, by_label: bool = False) -> DataFrame:
    shared = SHARED.get()
    if shared is None:
        return knn_graph(df, k, by_label)
    if (k, by_label) not in shared:
        shared[k, by_label] = cut(knn_graph(df, k, by_label))
    return shared[k, by_label]


def _hash_first(df: DataFrame, seed: int) -> DataFrame:
    best = df.groupBy("label").agg(F.min(F.struct(scores.hash_order(seed, F.col("id")).alias("h"), F.col("id"))).alias("m"))
    return best.select(F.col("m.id").alias("id"), "label")


def _uniform(importance: DataFrame | None) -> bool:
    return importance is None or scores.is_uniform(importance, "importance").first()[0] in (True, None)


def _nodes(df: DataFrame, importance: DataFrame | None) -> DataFrame:
    if importance is None:
        return df.select("id", "label", F.lit(1.0).alias("imp"))
    return df.select("id", "label").join(importance.select("id", F.col("importance").alias("imp")), "id")


def _register_scores() -> None:
    for name, column, descending in (("eva", "eva", True), ("aum", "aum", False), ("forgetting", "forgetting", True), ("el2n_top", "el2n", True), ("el2n_bottom", "el2n", False), ("high_variance", "conf_var", True)):
        def fn(df, budget, importance, seed, column=column, descending=descending):
            return scores.top_k_per_class(df, column, budget, descending)

        register_method(name, (column,), description=f"{'highest' if descending else 'lowest'} {column} of each class")(fn)


_register_scores()


@register_method("random")
def random(df, budget, importance, seed):
    """Rows of each class in hash order."""
    return scores.top_k_per_class(df.withColumn("h_", scores.hash_order(seed, F.col("id"))), "h_", budget, False)


@register_method("random_proportional")
def random_proportional(df, budget, importance, seed):
    """As many rows of the whole pool in hash order; more than there are is an error."""
    size = df.agg(F.count("*").alias("n"), F.count_distinct("label").alias("c")).first()
    if budget * size.c > size.n:
        raise ValueError(f"{budget} x {size.c} rows of {size.n}")
    top = df.select("id", "label", scores.hash_order(seed, F.col("id")).alias("h_")).orderBy("h_", "id").limit(budget * size.c)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("h_", "id"))).select("id", "label", "rank")  # of the few rows kept


@register_method("el2n_mid", ("el2n",))
def el2n_mid(df, budget, importance, seed):
    """The middle of each class by error."""
    return scores.mid_k_per_class(df, "el2n", budget)


@register_method("easy_samples", ("conf_var", "conf_mean"))
def easy_samples(df, budget, importance, seed):
    """Highest mean confidence less its variance."""
    return scores.top_k_per_class(df.withColumn("s_", F.col("conf_mean") - F.col("conf_var")), "s_", budget)


def _to_centroid(df: DataFrame) -> DataFrame:
    c = class_centroids(df).withColumnRenamed("label", "c_")
    return df.join(c, F.col("label") == F.col("c_")).withColumn("s_", F.sqrt(sq_l2(F.col("v"), F.col("centroid"))))


@register_method("prototype", ("v",))
def prototype(df, budget, importance, seed):
    """Nearest to the class centroid (raw vectors)."""
    return scores.top_k_per_class(_to_centroid(df), "s_", budget, False)


@register_method("anti_prototype", ("v",))
def anti_prototype(df, budget, importance, seed):
    """Farthest from the class centroid."""
    return scores.top_k_per_class(_to_centroid(df), "s_", budget)


@register_method("graph_density", ("v",), k=10)
def graph_density(df, budget, importance, seed, k):
    """Densest within the class's own graph."""
    density = density_of(neighbours(df, k, by_label=True))
    rows = df.select("id", "label").join(density, "id", "left").withColumn("density", F.coalesce("density", F.lit(0.0)))
    return scores.top_k_per_class(rows, "density", budget)


@register_method("greedy_importance", importance="required")
def greedy_importance(df, budget, importance, seed):
    """Highest importance."""
    return scores.top_k_per_class(importance, "importance", budget)


@register_method("fps", ("v",), "optional")
def fps(df, budget, importance, seed):
    """Farthest points by cosine distance; with importance, half the score is importance."""
    if _uniform(importance):
        return g.farthest_points(g.CosineDistance(df), df.select("id", "label"), budget, _hash_first(df, seed))
    return g.weighted_farthest_points(df, budget, importance)


@register_method("facility", ("v",), "optional", global_selection=False)
def facility(df, budget, importance, seed, global_selection):
    """Facility location on cosine similarity, computed block by block."""
    return g.greedy(g.CosineKernel(df, not global_selection), _nodes(df, importance), budget, per_class=not global_selection)


@register_method("herding", ("v",), "optional")
def herding(df, budget, importance, seed):
    """Running mean towards the class mean; importance is accepted and not used."""
    return g.herding(df, budget)


def hop_cosines(df: DataFrame, k: int, hops: int, block: int = BLOCK) -> DataFrame:
    """``src, dst, cos`` of pairs within some hops of the class graphs.

    Rows of a class are dealt into blocks, and a vector moves once for each block of its class, not for each pair. A task holds
    the vectors of two blocks; of two pairs that differ in direction one moves.
    """
    pairs = graph.k_hop_neighbors(neighbours(df, k, by_label=True), hops)
    u = cut(unit_vectors(df).filter("u IS NOT NULL"))
    sizes = u.groupBy(F.col("label").alias("label_s")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    u = u.join(sizes, F.col("label").eqNullSafe(F.col("label_s"))).drop("label_s")
    at = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    pairs = pairs.filter("src <= dst").join(u.select(F.col("id").alias("src"), "label", "blocks"), "src")
    pairs = pairs.select(F.col("label").alias("scope"), F.least(at("src"), at("dst")).alias("lo"), F.greatest(at("src"), at("dst")).alias("hi"), "src", "dst")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    u = u.select("label", "id", "u", at("id").alias("at"), other.alias("other"))
    u = u.select(F.col("label").alias("scope"), F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "id", "u")

    def measured(some: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id").combine_chunks()
        ids, v = vectors["id"].to_numpy(), vectors["u"].combine_chunks().flatten().to_numpy().reshape(len(vectors), -1)
        src, dst = some["src"].to_numpy(), some["dst"].to_numpy()
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        cos = np.concatenate([np.empty(0), *((v[a[i : i + PAIRS]] * v[b[i : i + PAIRS]]).sum(1) for i in range(0, len(a), PAIRS))])
        back = src != dst
        return pa.table({"src": np.concatenate([src, dst[back]]), "dst": np.concatenate([dst, src[back]]), "cos": np.concatenate([cos, cos[back]])})

    key = ("scope", "lo", "hi")
    return cut(pairs.groupBy(*key).cogroup(u.groupBy(*key)).applyInArrow(measured, "src long, dst long, cos double"))


@register_method("graph_fps", ("v",), "optional", k=10, hops=2)
def graph_fps(df, budget, importance, seed, k, hops):
    """Farthest points where pairs that are no k-hop neighbours lie 2 apart."""
    if _uniform(importance):
        first = _hash_first(df, seed)
    else:
        best = importance.groupBy("label").agg(F.max(F.struct("importance", (-F.col("id")).alias("m"))).alias("b"))
        first = best.select((-F.col("b.m")).alias("id"), "label")
    pairs = graph.k_hop_neighbors(neighbours(df, k, by_label=True), hops)
    return g.farthest_points(g.HopDistance(pairs, unit_vectors(df)), df.select("id", "label"), budget, first)


@register_method("graph_facility", ("v",), "optional", k=10, hops=2)
def graph_facility(df, budget, importance, seed, k, hops):
    """Facility location where only k-hop pairs are similar."""
    edges = hop_cosines(df, k, hops).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("cos").alias("w"))
    return g.greedy(g.EdgeKernel(edges), _nodes(df, importance), budget)


def normalized_graph(df: DataFrame, k: int, global_selection: bool) -> DataFrame:
    return cut(graph.sym_normalize(cut(graph.adjacency(neighbours(df, k, by_label=not global_selection)))))


def _as_columns(kernel: DataFrame) -> DataFrame:
    return kernel.select(F.col("dst").alias("i"), F.col("src").alias("j"), "w")


def _register_powers() -> None:
    for n in range(1, 6):
        @register_method(f"graph_a{n}", ("v",), "optional", f"facility location on the sum of powers 1 to {n} of the graph", k=10, hops=n, global_selection=False, prune=0.0)
        def fn(df, budget, importance, seed, k, hops, global_selection, prune):
            sym = normalized_graph(df, k, global_selection)
            if hops > 2 and not prune:
                # more powers fill in; no entry of a power of a matrix of norm 1 is above 1
                kernel = g.WalkKernel(sym, [0.0] + [1.0] * hops, top=float(hops))
            else:
                kernel = g.EdgeKernel(_as_columns(graph.power_sum_kernel(sym, hops, prune)))
            return g.greedy(kernel, _nodes(df, importance), budget, per_class=not global_selection)


_register_powers()


@register_method("heat_kernel", ("v",), "optional", k=10, t=1.0, terms=12, global_selection=False, prune=0.0)
def heat_kernel(df, budget, importance, seed, k, t, terms, global_selection, prune):
    """Facility location on the heat kernel of the graph, whose matrix is never built."""
    kernel = g.WalkKernel(normalized_graph(df, k, global_selection), g.heat_scale(t, terms), prune=prune)
    return g.greedy(kernel, _nodes(df, importance), budget, per_class=not global_selection)


def _walks(df: DataFrame, k: int, by_label: bool, walk: int, gamma: float, row_max: bool, prune: float) -> g.WalkKernel:
    p = cut(graph.transition(cut(graph.adjacency(neighbours(df, k, by_label)))))
    return g.WalkKernel(p, [gamma**t for t in range(walk + 1)], row_max, prune)


@register_method("graph_coverage", ("v",), "required", k=10, walk=5, gamma=0.85, global_selection=False, prune=0.0)
def graph_coverage(df, budget, importance, seed, k, walk, gamma, global_selection, prune):
    """Largest importance-weighted gain of walks that reach what is not yet covered."""
    kernel = _walks(df, k, not global_selection, walk, gamma, False, prune)
    return g.greedy(kernel, _nodes(df, importance), budget, g.COVERAGE, not global_selection)


@register_method("global_influence", ("v",), "required", k=10, walk=5, gamma=0.85, mode="prob", prune=0.0)
def global_influence(df, budget, importance, seed, k, walk, gamma, mode, prune):
    """Influence over one graph of all classes, by reach probability or by best cover."""
    if mode not in ("prob", "max"):
        raise ValueError("mode must be 'prob' or 'max'")
    kernel = _walks(df, k, False, walk, gamma, True, prune)
    return g.greedy(kernel, _nodes(df, importance), budget, g.REACH if mode == "prob" else g.FACILITY, per_class=False)


def _then_diverse(df: DataFrame, head: DataFrame, budget: int, first_n: int, seed: int) -> DataFrame:
    head = cut(head)
    rest = df.join(head.select("id"), "id", "left_anti")
    more = fps(rest, budget - first_n, None, seed)
    return head.union(more.select("id", "label", (F.col("rank") + first_n).cast("int").alias("rank")))


@register_method("easy_then_diverse", ("v", "conf_var", "conf_mean"), easy_ratio=0.5)
def easy_then_diverse(df, budget, importance, seed, easy_ratio):
    """Some of the easiest rows, then farthest points among the rest."""
    n = int(budget * easy_ratio)
    return _then_diverse(df, easy_samples(df, n, None, seed), budget, n, seed)


@register_method("proto_then_diverse", ("v",), proto_ratio=0.5)
def proto_then_diverse(df, budget, importance, seed, proto_ratio):
    """Some rows nearest to the centroid, then farthest points among the rest."""
    n = int(budget * proto_ratio)
    return _then_diverse(df, prototype(df, n, None, seed), budget, n, seed)
