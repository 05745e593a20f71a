"""Exact nearest neighbours and attention, by a blocked similarity join.

Rows are dealt into blocks by a hash of the id, each packed into one row, within classes if asked (the number of blocks
follows the size of the class). The pairs of blocks form a grid, cut into strips of left and slabs of right blocks: a cell of
it is one key of a join, so a left block is copied once a slab and a right block once a strip, not once for every other
block. In a task numpy multiplies the two matrices of a pair; what a left block has found (k neighbours a row) is merged with
what its next pair finds as long as the pairs of one block follow each other, and the rest is merged by Spark. A Python
worker holds a few blocks, the join at most ``STRIP`` of them, whatever the size of the table or of a class. Rows without a
vector have no neighbours and are nobody's.

The nearest neighbours of more than one block of rows are found by pivots: some rows, which are sent to all tasks. Blocks hold
rows of one nearest pivot, and the neighbours within its own block give each row a first bound. No row of a block is nearer
to another one than that one's angle to the pivot less the largest angle in the block, so of a pair of blocks only rows with a
bound beyond that are multiplied; in the worst case all are, as before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions.vectors import l2_normalize
from corepick.operators.runtime import cut

BLOCK = 4096
#: Right blocks, which the join holds, in one cell of the grid.
STRIP = 32
BROADCAST_CLASSES = 100_000
#: Rows that tasks measure others by at most; bounds what is sent to them.
PIVOTS = 1024
#: Angles, and cosines beside what single precision leaves open, nearer than this may be equal.
SLACK, CLOSE = 1e-6, 1e-12
#: Rows of a block that are multiplied with another one at once, and pairs of rows measured at once; they bound a task's memory.
TILE, PAIRS = 256, 1 << 15

#: Columns of a block's rows, in the order of their ids.
Block = dict[str, np.ndarray]


def unit_vectors(df: DataFrame) -> DataFrame:
    """``id, label, u``"""
    return df.select("id", "label", l2_normalize(F.col("v")).alias("u"))


def _sizes(left: DataFrame, right: DataFrame, block: int, tasks: int) -> DataFrame:
    """Per scope, the blocks of both sides and into how many strips and slabs they are dealt, for about ``tasks`` cells in all."""
    count = lambda df: F.max("at") + 1 if "at" in df.columns else F.ceil(F.count("*") / block)
    blocks = lambda df, name: df.groupBy("scope").agg(count(df).cast("int").alias(name))
    a, b = blocks(left, "lefts"), blocks(right, "rights").withColumnRenamed("scope", "scope_r")
    both = cut(a.join(b, F.col("scope").eqNullSafe(F.col("scope_r"))).drop("scope_r"))
    pairs = F.col("lefts").cast("long") * F.col("rights")
    own = F.ceil(tasks * pairs / (both.agg(F.sum(pairs)).first()[0] or 1))
    both = both.withColumn("strips", F.least("lefts", F.ceil(F.sqrt(own))).cast("int"))
    return both.withColumn("slabs", F.least("rights", F.greatest(F.ceil(F.col("rights") / STRIP), F.ceil(own / F.col("strips")))).cast("int"))


def _packed(df: DataFrame, sizes: DataFrame, blocks: str, own: str, copies: str) -> DataFrame:
    """``scope, at, own, other, rows``: each block ``at`` of a scope in its ``own`` part of the grid, once for each ``other`` one."""
    rows = F.struct("id", *(c for c in df.columns if c not in ("id", "label", "scope", "at")))
    of_scope = sizes.select(F.col("scope").alias("scope_s"), blocks, own, copies)
    dealt = df.join(of_scope, F.col("scope").eqNullSafe(F.col("scope_s")))
    dealt = dealt if "at" in df.columns else dealt.withColumn("at", F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int"))
    packed = dealt.groupBy("scope", "at", own, copies).agg(F.sort_array(F.collect_list(rows)).alias("rows"))
    return packed.select("scope", "at", F.pmod("at", own).alias("own"), F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("other"), "rows")


def _block(rows: pa.ListScalar) -> Block:
    values, out = rows.values, {}
    for field, column in zip(values.type, values.flatten()):
        if pa.types.is_list(field.type):
            out[field.name] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
        else:
            out[field.name] = column.to_numpy(zero_copy_only=False)
    return out


def blocked(left: DataFrame, right: DataFrame, work: Callable[[Block, Block], Block], schema: str, by_label: bool = False, merge: Callable[[Block, Block], Block] | None = None, block: int = BLOCK) -> DataFrame:
    """``work(a, b)`` for every pair of blocks of two tables with ``id, label, u`` (and more numbers), within labels if asked.

    ``merge`` makes one of two results of the same block ``a``; it may not get all of them. Tables with a column ``at`` are dealt
    into blocks by it, from 0 within each scope.
    """
    scope = F.col("label") if by_label else F.lit(0)
    left, right = (df.filter("u IS NOT NULL").withColumn("scope", scope) for df in (left, right))
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    sizes = cut(_sizes(left, right, block, tasks))
    product = lambda x, y: F.coalesce(F.sum(F.col(x).cast("long") * F.col(y)), F.lit(0))
    scopes, cells, pairs, slabs = sizes.agg(F.count("*"), product("strips", "slabs"), product("lefts", "rights"), F.coalesce(F.max("slabs"), F.lit(1))).first()
    sizes = F.broadcast(sizes) if scopes <= BROADCAST_CLASSES else sizes
    a = _packed(left, sizes, "lefts", "strips", "slabs").toDF("scope", "lb", "strip", "slab", "l_rows")
    b = _packed(right, sizes, "rights", "slabs", "strips").toDF("scope_r", "rb", "slab_r", "strip_r", "r_rows")
    # a number of partitions that is given is not reduced for being small, as there is much to compute for each byte
    parts = max(1, min(cells, max(tasks, pairs // STRIP)))
    # the cells of a scope go to one partition after the other; a hash would put several of these few into one, and none into others
    place = lambda scope, strip, slab: F.pmod(F.xxhash64(scope) + F.col(strip) * slabs + F.col(slab), F.lit(parts)).cast("int")
    a, b = a.withColumn("to", place("scope", "strip", "slab")).repartitionById(parts, "to"), b.withColumn("to_r", place("scope_r", "strip_r", "slab_r")).repartitionById(parts, "to_r")
    same = (F.col("to") == F.col("to_r")) & F.col("scope").eqNullSafe(F.col("scope_r")) & (F.col("strip") == F.col("strip_r")) & (F.col("slab") == F.col("slab_r"))
    pairs = a.join(b, same).select("scope", "lb", "l_rows", "r_rows")

    def rows_of(result: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x) if x.ndim == 2 else x) for x in result.values()], names=list(result))

    def run(batches):
        last, own, held = None, None, None
        for batch in batches:
            for i in range(len(batch)):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != last:
                    if held is not None:
                        yield rows_of(held)
                    last, own, held = key, _block(batch.column(2)[i]), None
                found = work(own, _block(batch.column(3)[i]))
                if merge is None:
                    yield rows_of(found)
                else:
                    held = found if held is None else merge(held, found)
        if held is not None:
            yield rows_of(held)

    return pairs.mapInArrow(run, schema)


def added(name: str) -> Callable[[Block, Block], Block]:
    """Merges results of the same rows by the sum of a column."""
    return lambda x, y: {**x, name: x[name] + y[name]}


def by_tiles(work: Callable[[Block, Block], Block]) -> Callable[[Block, Block], Block]:
    """``work`` that gives a row for each of ``a``, done for ``TILE`` of them at once."""

    def run(a: Block, b: Block) -> Block:
        parts = [work({c: x[i : i + TILE] for c, x in a.items()}, b) for i in range(0, len(a["id"]), TILE)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return run


def _cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of unit vectors, in single precision (see :func:`_margin`); least where there is none."""
    cos = u.astype(np.float32) @ v.astype(np.float32).T
    return np.nan_to_num(cos, copy=False, nan=-np.inf) if np.isnan(cos.sum()) else cos


def _margin(u: np.ndarray) -> float:
    """What :func:`_cosines` may be off by: each of the products and sums by at most ``2^-24`` of vectors no longer than 1."""
    return (u.shape[1] + 8) * 2.0**-23


def _angles(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ v.T, -1.0, 1.0))


def _by_pivot(units: DataFrame, pivots: np.ndarray, k: int, by_label: bool, block: int) -> DataFrame:
    """``units`` with their block ``at``, its ``pivot``, their angle ``off`` to it, and the angle ``reach`` to the k-th nearest in the block."""
    sent = units.sparkSession.sparkContext.broadcast(pivots)

    def measured(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                angle = _angles(part.column(2).flatten().to_numpy().reshape(len(part), -1), sent.value)
                nearest = angle.argmin(1)
                columns = [*part.columns, pa.array(nearest, pa.int32()), pa.array(angle[np.arange(len(part)), nearest])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "u", "pivot", "off"])

    kind = units.schema["label"].dataType.simpleString()
    near = cut(units.mapInArrow(measured, f"id long, label {kind}, u array<double>, pivot int, off double")).withColumn("scope", F.col("label") if by_label else F.lit(0))
    parts = near.groupBy("scope", "pivot").agg(F.ceil(F.count("*") / block).alias("parts"))
    parts = parts.withColumn("first", F.sum("parts").over(Window.partitionBy("scope").orderBy("pivot")) - F.col("parts"))
    parts = cut(parts.select(F.col("scope").alias("scope_p"), F.col("pivot").alias("pivot_p"), "parts", "first"))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_CLASSES else parts
    near = near.join(parts, F.col("scope").eqNullSafe(F.col("scope_p")) & (F.col("pivot") == F.col("pivot_p")))
    near = near.withColumn("at", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    packed = near.groupBy("scope", "at").agg(F.first("label").alias("label"), F.first("pivot").alias("pivot"), F.sort_array(F.collect_list(F.struct("id", "u", "off"))).alias("rows"))

    def reached(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows = _block(batch.column(4)[i])
                n = len(rows["id"])
                reach = np.full(n, np.inf)
                for a in range(0, n if n > k else 0, TILE):
                    cos = _cosines(rows["u"][a : a + TILE], rows["u"])
                    own = np.arange(len(cos))
                    cos[own, a + own] = -np.inf
                    reach[a : a + TILE] = np.arccos(np.clip(np.partition(cos, n - k, axis=1)[:, n - k].astype(float) - _margin(rows["u"]), -1.0, 1.0))
                same = lambda c: pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type)
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"]), same(2), pa.array(list(rows["u"])), same(1), same(3), pa.array(rows["off"]), pa.array(reach)], names=["id", "label", "u", "at", "pivot", "off", "reach"])

    return cut(packed.mapInArrow(reached, f"id long, label {kind}, u array<double>, at int, pivot int, off double, reach double"))


def knn_graph(samples: DataFrame, k: int, by_label: bool = False, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """``src, dst, rank, dist``: the ``k`` nearest others by squared distance of unit vectors; ties by id. One row alone has none.

    ``report`` gets two accumulators, of the cells of all pairs of blocks and of those computed.
    """
    units = cut(unit_vectors(samples).filter("u IS NOT NULL"))
    context = units.sparkSession.sparkContext
    every, computed = context.accumulator(0), context.accumulator(0)
    if report is not None:
        report += [every, computed]
    size, sent = units.count(), None
    if size > block:
        some = units.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-size // block))).select("u").toArrow()["u"].combine_chunks()
        pivots = some.flatten().to_numpy().reshape(len(some), -1)
        sent, units = context.broadcast(pivots), _by_pivot(units, pivots, k, by_label, block)

    def best(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> Block:
        order = np.lexsort((dst, dist, src))
        start = np.flatnonzero(np.diff(src[order], prepend=src[order][:1] - 1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        keep = order[rank < k]
        return {"src": src[keep], "dst": dst[keep], "dist": dist[keep]}

    def nearest(a: Block, b: Block) -> Block:
        bound, off = None, CLOSE + _margin(a["u"])
        if sent is not None:
            every.add(len(a["id"]) * len(b["id"]))
            pivot = sent.value[b["pivot"][0]]
            may = _angles(a["u"], pivot[None, :])[:, 0] - b["off"].max() <= a["reach"] + SLACK
            a = {c: a[c][may] for c in ("id", "u", "reach")}
            computed.add(len(a["id"]) * len(b["id"]))
            # the k-th nearest has at least this cosine
            bound = np.where(a["reach"] < np.pi, np.cos(np.minimum(a["reach"], np.pi)), -1.0) - off
        ids, own = b["id"], a["id"]
        rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(own), TILE):
            cos = _cosines(a["u"][at : at + TILE], b["u"])
            row, col = np.divmod(np.flatnonzero(cos >= bound[at : at + TILE, None].astype(np.float32)), len(ids)) if bound is not None else (None, None)
            if row is None or len(row) > 8 * k * len(cos):
                # all that are about as near as the k-th, itself aside
                place = len(ids) - min(k + 1, len(ids))
                row, col = np.nonzero(cos >= np.partition(cos, place, axis=1)[:, place, None] - np.float32(2 * off))
            rows.append(row + at)
            cols.append(col)
        row, col = np.concatenate(rows), np.concatenate(cols)
        other = own[row] != ids[col]
        row, col = row[other], col[other]
        # by pairs, so that equal vectors are equally far wherever they stand in a block
        dist = [2.0 * (1.0 - (a["u"][row[i : i + PAIRS]] * b["u"][col[i : i + PAIRS]]).sum(1)) for i in range(0, len(row), PAIRS)]
        dist = np.concatenate([np.empty(0), *dist])
        there = np.isfinite(dist)
        return best(own[row[there]], ids[col[there]], dist[there])

    def merge(x: Block, y: Block) -> Block:
        return best(*(np.concatenate([x[c], y[c]]) for c in ("src", "dst", "dist")))

    partial = blocked(units, units, nearest, "src long, dst long, dist double", by_label, merge, block)
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return partial.withColumn("rank", place).filter(F.col("rank") <= k).select("src", "dst", "rank", "dist")


def cross_attention(train: DataFrame, queries: DataFrame, temperature: float = 0.1, block: int = BLOCK) -> DataFrame:
    """``id, importance``: over the queries, the sum of each row's share in the softmax of ``cosine / temperature``.

    Two passes over the block pairs: partial log-sum-exps by query, then shares, summed within blocks before they are merged.
    """
    t, q = cut(unit_vectors(train)), cut(unit_vectors(queries))

    def sums(a: Block, b: Block) -> Block:
        s = a["u"] @ b["u"].T / temperature
        top = s.max(1)
        return {"id": a["id"], "top": top, "total": np.exp(s - top[:, None]).sum(1)}

    def merge(x: Block, y: Block) -> Block:
        top = np.maximum(x["top"], y["top"])
        return {"id": x["id"], "top": top, "total": sum(p["total"] * np.exp(p["top"] - top) for p in (x, y))}

    parts = blocked(q, t, by_tiles(sums), "id long, top double, total double", merge=merge, block=block)
    tops = parts.groupBy("id").agg(F.max("top").alias("m"))
    lse = parts.join(tops, "id").groupBy("id", "m").agg(F.sum(F.col("total") * F.exp(F.col("top") - F.col("m"))).alias("s"))
    q = q.join(lse.select("id", (F.col("m") + F.log("s")).alias("lse")), "id")

    def shares(a: Block, b: Block) -> Block:
        return {"id": a["id"], "part": np.exp(a["u"] @ b["u"].T / temperature - b["lse"][None, :]).sum(1)}

    found = blocked(t, q, by_tiles(shares), "id long, part double", merge=added("part"), block=block)
    return found.groupBy("id").agg(F.sum("part").alias("importance"))


def attention_stats(train: DataFrame, queries: DataFrame, temperature: float = 0.1, block: int = BLOCK) -> DataFrame:
    """One row: mean entropy of the queries' attention, and the mean mass of the strongest row and of the ten strongest."""
    t, q = cut(unit_vectors(train)), cut(unit_vectors(queries))

    def parts(a: Block, b: Block) -> Block:
        s = a["u"] @ b["u"].T / temperature
        top = s.max(1)
        e = np.exp(s - top[:, None])
        return {"id": a["id"], "top": top, "total": e.sum(1), "weighted": (e * s).sum(1), "best": -np.sort(-s, axis=1)[:, :10]}

    def merge(x: Block, y: Block) -> Block:
        top = np.maximum(x["top"], y["top"])
        total, weighted = (sum(p[c] * np.exp(p["top"] - top) for p in (x, y)) for c in ("total", "weighted"))
        return {"id": x["id"], "top": top, "total": total, "weighted": weighted, "best": -np.sort(-np.hstack([x["best"], y["best"]]), axis=1)[:, :10]}

    p = blocked(q, t, by_tiles(parts), "id long, top double, total double, weighted double, best array<double>", merge=merge, block=block)
    m = p.groupBy("id").agg(F.max("top").alias("m"), F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("best"))
    scale = F.exp(F.col("top") - F.col("m"))
    s = p.drop("best").join(m, "id").groupBy("id", "m").agg(F.sum(F.col("total") * scale).alias("z"), F.sum(F.col("weighted") * scale).alias("w"), F.first("best").alias("best"))
    share = F.transform(F.slice("best", 1, 10), lambda x: F.exp(x - F.col("m")) / F.col("z"))
    rows = s.select((F.col("m") + F.log("z") - F.col("w") / F.col("z")).alias("entropy"), F.get(share, 0).alias("one"), F.aggregate(share, F.lit(0.0), lambda a, x: a + x).alias("ten"))
    return rows.agg(F.avg("entropy").alias("mean_entropy"), F.avg("one").alias("top1_mass"), F.avg("ten").alias("top10_mass"))


def local_density(samples: DataFrame, k: int, by_label: bool = False) -> DataFrame:
    """``id, density``: the inverse of the mean squared distance to the ``k`` nearest."""
    return density_of(knn_graph(samples, k, by_label))


def density_of(knn: DataFrame) -> DataFrame:
    return knn.groupBy(F.col("src").alias("id")).agg((1 / (F.avg("dist") + 1e-8)).alias("density"))
