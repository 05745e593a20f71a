"""Importance scores by name, scaled to [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.functions.scores import min_max_normalize, raw_importance
from corepick.operators import graph
from corepick.operators.knn import cross_attention, knn_graph, local_density

FORMULAS = ("uniform", "el2n_easy", "el2n_hard", "el2n_mid", "variance_low", "variance_high")
METHODS = (*FORMULAS, "test_attention", "local_density", "centrality")
#: Columns that a metric needs beside ``id``.
NEEDS = {
    "uniform": set(),
    "el2n_easy": {"el2n"},
    "el2n_hard": {"el2n"},
    "el2n_mid": {"el2n"},
    "variance_low": {"conf_var", "conf_mean"},
    "variance_high": {"conf_var"},
    "test_attention": {"label", "v"},
    "local_density": {"label", "v"},
    "centrality": {"label", "v"},
}


def compute_importance(df: DataFrame, method: str, normalize: bool = True, k: int = 10, queries: DataFrame | None = None, temperature: float = 0.1) -> DataFrame:
    """``id, importance``. ``df`` has ``id`` and what the method needs: score columns, or ``label`` and ``v``."""
    if method in FORMULAS:
        out = raw_importance(df, method).select("id", "importance")
    elif method == "test_attention":
        if queries is None:
            raise ValueError("test_attention needs queries")
        out = cross_attention(df, queries, temperature)
    elif method == "local_density":
        out = local_density(df, k).select("id", F.col("density").alias("importance"))
    elif method == "centrality":
        out = graph.pagerank(graph.adjacency(knn_graph(df, k)), df.select("id"))
    else:
        raise ValueError(f"unknown importance {method!r}; known: {', '.join(METHODS)}")
    return min_max_normalize(out, "importance") if normalize else out
