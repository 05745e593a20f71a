"""Sparse matrices as edge tables ``(src, dst, w)``: products, normalisations, kernels and centralities.

A zero is an absent row. Products are joins with a pre-aggregated sum. Loops cut their lineage with checkpoints.
Sums of powers of a matrix that every task may hold come row by row from tasks; larger ones by joins, power by power.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions.vectors import edge_weight
from corepick.operators.runtime import cut

#: Edges of a source from which on its rows are dealt into parts, and how many such sources there may be (the largest; all others
#: have fewer edges than any of them).
HUB, HUBS = 10_000, 10_000
#: Entries of a matrix that every task may hold (some 20 bytes each), and cells of the rows that it computes at once.
BROADCAST_EDGES, CELLS = 2_000_000, 1 << 21
#: How many times as many entries every task may hold where whole rows of three powers or more are the result.
MORE = 4


def symmetrize_max(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").union(back).groupBy("src", "dst").agg(F.max("w").alias("w")).filter("w > 0")


def adjacency(knn: DataFrame, symmetric: bool = True, similarity_weights: bool = True) -> DataFrame:
    edges = knn.select("src", "dst", edge_weight(F.col("dist"), similarity_weights).alias("w"))
    return symmetrize_max(edges) if symmetric else edges.filter("w > 0")


def hubs(edges: DataFrame, degree: int = HUB) -> DataFrame | None:
    """``hub, parts``: the sources of more than ``degree`` edges (the ``HUBS`` largest) and into how many parts theirs are dealt."""
    n = edges.groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("n")).filter(F.col("n") > degree)
    found = n.orderBy(F.desc("n"), "hub").limit(HUBS).select("hub", F.ceil(F.col("n") / degree).cast("int").alias("parts")).toArrow()
    return edges.sparkSession.createDataFrame(found) if len(found) else None


def through(left: DataFrame, right: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``via``. The right rows of a hub in ``split`` are dealt into its parts, and the left ones go to each."""
    if split is None:
        return left.join(right, "via")
    of_hub = F.broadcast(split)
    right = right.join(of_hub, F.col("via") == F.col("hub"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")).drop("hub", "parts")
    left = left.join(of_hub, F.col("via") == F.col("hub"), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("hub", "parts")
    return left.join(right, ["via", "part"]).drop("part")


def matmul(a: DataFrame, b: DataFrame, prune: float = 0.0, split: DataFrame | None = None) -> DataFrame:
    """The product; ``split``: the :func:`hubs` of ``b``."""
    left = a.select("src", F.col("dst").alias("via"), F.col("w").alias("wa"))
    right = b.select(F.col("src").alias("via"), "dst", F.col("w").alias("wb"))
    out = through(left, right, split).groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))
    return out.filter(F.abs("w") > prune) if prune else out


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """``id, x``: the matrix times the column vector ``x(id, x)``."""
    return a.join(x.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` cut and, given a ``key``, dealt by it first; plans know from it how the rows lie."""
    spark = df.sparkSession
    # an adaptive plan does not say how its rows are dealt, so the checkpoint would not either
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # sorted too, so that a merge join by the key sorts the other side only
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key) if key else df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def laid_out(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges dealt by source once, for loops in which :func:`vecmat` then moves vectors alone; and their hubs, whose edges are
    dealt into parts (column ``part``, only where there are hubs)."""
    edges = cut(edges)
    split, key = hubs(edges), ["src"]
    if split is not None:
        part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
        edges = edges.join(F.broadcast(split), F.col("src") == F.col("hub"), "left").select("src", "dst", "w", part.alias("part"))
        key = ["src", "part"]
    return dealt(edges, *key), split


def to_parts(rows: DataFrame, split: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """``rows(src, ..)`` as they meet :func:`laid_out` edges, those of a hub once for each part, and the key to join by."""
    if split is None:
        return rows, ["src"]
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))
    return rows.join(F.broadcast(split), F.col("src") == F.col("hub"), "left").select(*rows.columns, parts.alias("part")), ["src", "part"]


def vecmat(x: DataFrame, a: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """``id, x``: the row vector times the matrix; ``split``: the hubs of a matrix that is :func:`laid_out`."""
    left, key = to_parts(x.select(F.col("id").alias("src"), "x"), split)
    return a.join(left, key).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))


def k_hop_neighbors(edges: DataFrame, hops: int, include_self: bool | None = None) -> DataFrame:
    """``src, dst`` that a walk of 1 to ``hops`` edges of the undirected graph joins; by default self pairs from 2 hops on."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = cut(both)
    split = hubs(both) if hops > 1 else None
    reach = step = both
    for _ in range(hops - 1):
        step = through(step.select("src", F.col("dst").alias("via")), both.select(F.col("src").alias("via"), "dst"), split).select("src", "dst").distinct()
        reach = cut(reach.union(step).distinct())
    return reach if (hops >= 2 if include_self is None else include_self) else reach.filter("src <> dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("w").alias("degree"))


def sym_normalize(edges: DataFrame) -> DataFrame:
    """``D^-1/2 A D^-1/2``; a row without edges counts as degree 1 and has nothing to scale."""
    d = degrees(edges)
    out = edges.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("degree").alias("other")), "dst")
    return out.select("src", "dst", (F.col("w") / F.sqrt(F.col("degree") * F.col("other"))).alias("w"))


def transition(edges: DataFrame) -> DataFrame:
    return edges.join(degrees(edges).filter("degree <> 0"), "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("w"))


def add(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("src", "dst", "w")
    for p in parts[1:]:
        out = out.union(p.select("src", "dst", "w"))
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))


@dataclass(frozen=True)
class SmallMatrix:
    """A sparse matrix of at most ``BROADCAST_EDGES`` entries by row: those of row k are at ``starts[k]`` to ``starts[k + 1]``."""

    ids: np.ndarray
    to: np.ndarray
    w: np.ndarray
    starts: np.ndarray
    prune: float

    @classmethod
    def of(cls, src: np.ndarray, dst: np.ndarray, w: np.ndarray, prune: float = 0.0) -> SmallMatrix:
        ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)]))
        a, b = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
        order = np.lexsort((b, a))
        return cls(ids, b[order], w[order], np.append(0, np.cumsum(np.bincount(a, minlength=len(ids)))), prune)

    @classmethod
    def sent(cls, p: DataFrame, prune: float = 0.0, most: int = BROADCAST_EDGES) -> Broadcast | None:
        """The matrix for every task; None if it has more than ``most`` entries."""
        if p.count() > most:
            return None
        edges = p.select("src", "dst", "w").limit(most + 1).toArrow()
        return p.sparkSession.sparkContext.broadcast(cls.of(*(edges[c].to_numpy() for c in ("src", "dst", "w")), prune))

    def sums(self, some: np.ndarray, scale: list[float], own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``src, dst, w`` of the rows ``some`` of ``sum_t scale[t] P^t``, row by row, some rows at a time. ``own``: which of them have
        the first term (all)."""
        own = np.ones(len(some)) if own is None else own
        at = np.searchsorted(self.ids, some)
        here = at < len(self.ids)
        here[here] = self.ids[at[here]] == some[here]
        alone = ~here & (own * scale[0] != 0)
        if alone.any():  # without an entry of its own
            yield some[alone], some[alone], own[alone] * scale[0]
        some, at, own = some[here], at[here], own[here]
        # what one row's last product adds up, by the mean of entries a row
        each = min(float(len(self.w)), (len(self.w) / max(1, len(self.ids))) ** (len(scale) - 1))
        n = int(max(1, CELLS // max(1.0, each)))
        for k in range(0, len(some), n):
            yield from self._block(some[k : k + n], at[k : k + n], own[k : k + n], scale)

    def _block(self, some: np.ndarray, at: np.ndarray, own: np.ndarray, scale: list[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        size = len(self.ids)
        row, col, x = np.arange(len(at)), at, np.full(len(at), scale[-1])
        diagonal = np.arange(len(at)) * size + at
        for step in range(len(scale) - 2, -1, -1):
            more = scale[step] * (own if step == 0 else np.ones(len(at)))
            degree = self.starts[col + 1] - self.starts[col]
            place = np.arange(degree.sum()) + np.repeat(self.starts[col] - (np.cumsum(degree) - degree), degree)
            key, part = np.repeat(row, degree) * size + self.to[place], np.repeat(x, degree) * self.w[place]
            if len(at) * size <= 4 * len(key):
                y = np.bincount(key, part, len(at) * size)
                y[np.abs(y) <= self.prune] = 0.0
                y[diagonal] += more
                key = np.flatnonzero(y)
                x = y[key]
            else:
                key, x = _added(key, part)
                stays = np.abs(x) > self.prune
                key, x = _added(np.concatenate([key[stays], diagonal]), np.concatenate([x[stays], more]))
                key, x = key[x != 0], x[x != 0]
            row, col = np.divmod(key, size)
        yield some[row], self.ids[col], x


def _added(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and the sums of their numbers."""
    if not len(key):
        return key, x
    order = np.argsort(key, kind="stable")
    key, x = key[order], x[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(x, first)


def by_row_max(src: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Entries, row by row, by the largest of their row."""
    starts = np.flatnonzero(np.diff(src, prepend=src[:1] - 1))
    top = np.maximum.reduceat(w, starts) if len(src) else w
    return w / np.repeat(np.where(top == 0, 1.0, top), np.diff(np.append(starts, len(src))))


def walk_matrix(p: DataFrame, nodes: DataFrame | None, scale: list[float], row_max: bool = False) -> DataFrame | None:
    """``sum_t scale[t] P^t``, the first term for ``nodes`` alone and rows divided by their largest entry if ``row_max``, row by row
    in tasks, so that no power is stored or moved; None if the matrix has too many entries for every task to hold."""
    # joins of three powers and more fill disks long before so many edges fill a task
    small = SmallMatrix.sent(p, most=BROADCAST_EDGES * (MORE if len(scale) > 3 else 1))
    if small is None:
        return None
    rows = p.select(F.col("src").alias("id"), F.lit(0.0).alias("own"))
    rows = rows if nodes is None else rows.union(nodes.select("id", F.lit(1.0)))

    def run(batches):
        for batch in batches:
            for src, dst, w in small.value.sums(batch.column(0).to_numpy(), scale, batch.column(1).to_numpy()):
                w = by_row_max(src, w) if row_max else w
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(w)], names=["src", "dst", "w"])

    parts = 4 * p.sparkSession.sparkContext.defaultParallelism
    return rows.groupBy("id").agg(F.max("own").alias("own")).repartition(parts, "id").mapInArrow(run, "src long, dst long, w double")


def power_sum_kernel(normalized: DataFrame, hops: int, prune: float = 0.0) -> DataFrame:
    """Sum of the powers 1 to ``hops``; entries up to ``prune`` are dropped from each power (0: none)."""
    base = power = cut(normalized)
    if hops > 1 and not prune and (rows := walk_matrix(base, None, [0.0] + [1.0] * hops)) is not None:
        return rows
    powers, split = [base], hubs(base) if hops > 1 else None
    for _ in range(hops - 1):
        power = cut(matmul(power, base, prune, split))
        powers.append(power)
    return add(*powers) if hops > 1 else base


def heat_scale(t: float, terms: int) -> list[float]:
    return [math.exp(-t) * t**i / math.factorial(i) for i in range(terms + 1)]


def heat_kernel(normalized: DataFrame, nodes: DataFrame, t: float = 1.0, terms: int = 12, prune: float = 0.0) -> DataFrame:
    """``exp(-t (I - A))`` as ``e^-t sum t^i/i! A^i``; the spectrum of A lies in [-1, 1], so the rest is at most the tail of the series."""
    base = power = cut(normalized)
    if not prune and (rows := walk_matrix(base, nodes, heat_scale(t, terms))) is not None:
        return rows
    scaled = lambda df, i: df.select("src", "dst", (F.col("w") * (math.exp(-t) * t**i / math.factorial(i))).alias("w"))
    total, split = add(scaled(identity(nodes), 0), scaled(base, 1)), hubs(base)
    for i in range(2, terms + 1):
        power = cut(matmul(power, base, prune, split))
        total = cut(add(total, scaled(power, i)))
    return total


def reachability(edges: DataFrame, nodes: DataFrame, walk: int = 5, gamma: float = 0.85, prune: float = 0.0, row_max: bool = False) -> DataFrame:
    """``sum_t gamma^t P^t`` for t from 0 to ``walk``, its rows by their largest entry if ``row_max``. Fills in quickly: ``prune`` bounds it at scale, and scores that are
    linear in it need :func:`reach_sum` only."""
    p = cut(transition(edges))
    if not prune and (rows := walk_matrix(p, nodes, [gamma**t for t in range(walk + 1)], row_max)) is not None:
        return rows
    total, power, split = identity(nodes), None, hubs(p)
    for t in range(1, walk + 1):
        power = p if power is None else cut(matmul(power, p, prune, split))
        total = cut(add(total, power.select("src", "dst", (F.col("w") * gamma**t).alias("w"))))
    return row_max_normalize(total) if row_max else total


def reach_sum(p: DataFrame, x: DataFrame, walk: int, gamma: float, transposed: bool = False, split: DataFrame | None = None) -> DataFrame:
    """``id, x``: reachability (or its transpose) times the vector ``x``, by ``walk`` sparse products and never the matrix.
    ``split``: the hubs of a :func:`laid_out` matrix, for the transpose."""
    return walk_sum(p, x, [gamma**t for t in range(walk + 1)], transposed, split)


def walk_sum(p: DataFrame, x: DataFrame, scale: list[float], transposed: bool = False, split: DataFrame | None = None) -> DataFrame:
    """``id, x``: ``sum_t scale[t] P^t`` (or its transpose) times the vector ``x``, by Horner's rule: each product is planned once."""
    part = lambda c: x.select("id", (F.col("x") * c).alias("x"))
    total = part(scale[-1])
    for c in scale[-2::-1]:
        moved = vecmat(total, p, split) if transposed else matvec(p, total)
        total = (moved.union(part(c)) if c else moved).groupBy("id").agg(F.sum("x").alias("x"))
    return total


def row_max_normalize(edges: DataFrame) -> DataFrame:
    top = edges.groupBy("src").agg(F.max("w").alias("m"))
    return edges.join(top, "src").select("src", "dst", (F.col("w") / F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m"))).alias("w"))


def propagate_importance(importance: DataFrame, edges: DataFrame, gamma: float = 0.85, iterations: int = 10, walk: int = 5, damping: float = 0.5, tol: float = 1e-6) -> DataFrame:
    """``id, importance``: ``x <- d * importance + (1 - d) * (R / geo)' x`` until no value moves by ``tol`` (0: all ``iterations``)."""
    p, split = laid_out(transition(edges))
    geo = (1 - gamma ** (walk + 1)) / (1 - gamma) if gamma < 1 else walk + 1.0
    start = cut(importance.select("id", F.col("importance").alias("x")))
    x = start
    for _ in range(iterations):
        moved = reach_sum(p, x, walk, gamma, transposed=True, split=split).withColumnRenamed("x", "y")
        new = start.select("id", F.col("x").alias("x0")).join(moved, "id", "left").select("id", (damping * F.col("x0") + (1 - damping) * F.coalesce("y", F.lit(0.0)) / geo).alias("x"))
        new = cut(new)
        change = new.join(x.withColumnRenamed("x", "old"), "id").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] if tol > 0 else math.inf
        x = new
        if change is None or change < tol:
            break
    return x.select("id", F.col("x").alias("importance"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 50, tol: float = 1e-6) -> DataFrame:
    """``id, importance`` by power iteration without redistribution of dangling mass; what converged is the iterate before
    the last step."""
    p, split = laid_out(transition(edges))
    n = nodes.count()
    x = cut(nodes.select("id", F.lit(1.0 / max(1, n)).alias("x")))
    for _ in range(iterations):
        moved = vecmat(x, p, split).withColumnRenamed("x", "y")
        new = cut(nodes.select("id").join(moved, "id", "left").select("id", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("y", F.lit(0.0))).alias("x")))
        change = new.join(x.withColumnRenamed("x", "old"), "id").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        if change is None or change < tol:
            break
        x = new
    return x.select("id", F.col("x").alias("importance"))


def graph_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").cast("double").alias("n"))
    d = edges.groupBy("src").agg(F.count("*").alias("deg"))
    e = edges.agg(F.count("*").alias("nnz"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.avg("w").alias("mean_w"))
    g = d.agg(F.max("deg").alias("max_degree"))
    return e.crossJoin(n).crossJoin(g).select("nnz", (1 - F.col("nnz") / (F.col("n") * F.col("n"))).alias("sparsity"), "min_w", "max_w", "mean_w", (F.col("nnz") / F.col("n")).alias("mean_degree"), "max_degree")


def kernel_row_sums(kernel: DataFrame) -> DataFrame:
    return kernel.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("row_sum"))


def average_rank(df: DataFrame, column: str, parts: int = 100) -> DataFrame:
    """``id, r``: ranks with ties averaged. Values are dealt into ``parts`` ranges by approximate quantiles; each range counts its
    own values in order, and what lies in the ranges before it is added. Only the ``parts`` totals are ordered as a whole."""
    sizes = df.groupBy(column).agg(F.count("*").alias("c"))
    bounds = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)]).alias("bounds_"))
    sizes = sizes.crossJoin(F.broadcast(bounds)).withColumn("part_", F.size(F.filter("bounds_", lambda b: b < F.col(column))))
    totals = sizes.groupBy("part_").agg(F.sum("c").alias("t"))
    totals = totals.select("part_", (F.sum("t").over(Window.orderBy("part_")) - F.col("t")).alias("before_"))
    within = F.sum("c").over(Window.partitionBy("part_").orderBy(column)) - F.col("c")
    ranks = sizes.withColumn("within_", within).join(F.broadcast(totals), "part_")
    ranks = ranks.select(F.col(column).alias("value_"), (F.col("before_") + F.col("within_") + (F.col("c") + 1) / 2).alias("r"))
    return df.join(ranks, F.col(column) == F.col("value_")).select("id", "r")


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``rho`` over the common ids of ``(id, x)`` tables; null with two or fewer."""
    both = a.select("id", F.col("x").alias("xa")).join(b.select("id", F.col("x").alias("xb")), "id")
    ra = average_rank(both, "xa").withColumnRenamed("r", "ra")
    rb = average_rank(both, "xb").withColumnRenamed("r", "rb")
    spread = F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))
    return ra.join(rb, "id").agg(F.when(F.count("*") > 2, F.covar_pop("ra", "rb") / spread).alias("rho"))
