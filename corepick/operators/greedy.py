"""Greedy selection in exact lazy rounds, and farthest points.

The gain of a candidate only falls as others are picked, so a gain once computed stays an upper bound. A round

1. takes the candidates (of each class, for per-class scope) with the largest bounds and computes gains until the best of
   them beats every bound that is left, so that candidates whose stale bound cannot reach the top cost nothing;
2. adds up, over all rows, what the pick of one of the best ``width`` candidates would take from the gain of another. What
   several picks take lies between the largest and the sum of what each takes, so a candidate is picked as long as its least possible gain beats the largest possible one of every other, inside and outside;
3. brings the state of the rows up to date.

The first pick of a round is always certain. However many rows there are, the driver takes at most ``FRESH`` gains
and tables of ``width`` x ``width`` numbers a class, fewer where there are many classes. Ties (gains nearer than ``LEAD``, in proportion) go to the least id.

A kernel says what a candidate does for a row. :class:`EdgeKernel` has it as a table; :class:`WalkKernel` and
:class:`CosineKernel` never store theirs and compute only columns of candidates that are looked into.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.functions.vectors import dot, l2_normalize
from corepick.operators.graph import BROADCAST_EDGES, SmallMatrix, add, by_row_max, dealt, heat_scale, hubs, laid_out, matmul, to_parts, walk_sum
from corepick.operators.knn import Block, added, blocked, by_tiles, unit_vectors
from corepick.operators.runtime import cut

WIDTH = 256
#: Candidates of all classes in a round's tables, which so have WIDTH times as many numbers at most.
CANDIDATES = 4096
#: Candidates whose gains one pass over the rows computes, and gains of a round that the driver holds; beyond that they stay a table,
#: for which one pass by blocks sees to all that are left and takes about as long as a few of these.
PASS, FRESH = 2048, 3 * 2048
#: Picks that rows take into account as they are read, before their state is written anew.
PENDING = 1024
LEAD = 1e-12
ROWS = 1024


@dataclass(frozen=True)
class Rule:
    """How a row with state ``s`` gains from a candidate of kernel value ``w``, its state afterwards, and ``loss(w, s, imp)``: from
    rows x candidates, how much of a candidate's gain (first axis) the pick of another one (second axis) takes."""

    start: float
    gain: Callable
    after: Callable
    loss: Callable
    #: No gain is ever below nothing.
    positive: bool = True


def _at_least_zero(x):
    return F.greatest(x, F.lit(0.0)) if isinstance(x, Column) else np.maximum(x, 0.0)


def _larger(a, b):
    return F.greatest(a, b) if isinstance(a, Column) else np.maximum(a, b)


def _shared(w: np.ndarray, s: np.ndarray, imp: np.ndarray) -> np.ndarray:
    a = np.maximum(w - s[:, None], 0.0)
    return np.stack([imp @ np.minimum(a[:, j : j + 1], a) for j in range(a.shape[1])])


#: Facility location: a row is covered as well as its best pick covers it.
FACILITY = Rule(0.0, lambda w, s: _at_least_zero(w - s), _larger, _shared)
#: Coverage: what is not yet covered counts in proportion (and against a candidate where walks cover a row more than once).
COVERAGE = Rule(0.0, lambda w, s: w * (1 - s), _larger, lambda w, s, imp: (w * imp[:, None]).T @ np.maximum(w - s[:, None], 0.0), positive=False)
#: Probability that no pick reaches the row.
REACH = Rule(1.0, lambda w, s: w * s, lambda w, s: s * (1 - w), lambda w, s, imp: (w * (imp * s)[:, None]).T @ w)


def _small(spark: SparkSession, **columns) -> DataFrame:
    """A table of what the driver holds, without a Python task."""
    return spark.createDataFrame(pa.table({k: pa.array(v, pa.float64() if k == "g_" else pa.int64()) for k, v in columns.items()}))


def _ranked(spark: SparkSession, picks: list[tuple[int, object, int]]) -> DataFrame:
    ids, labels, ranks = zip(*picks) if picks else ((), (), ())
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64()), "rank": pa.array(ranks, pa.int32())}))


@dataclass
class Round:
    """The candidates of a round by group, in order of their bounds; ``outside``: the best ``(gain, id)`` left out of a group."""

    groups: list[list[tuple[int, object]]]
    outside: list[tuple[float, int] | None]
    left: dict
    #: The candidate that is certainly the first of each group; None: the one with the largest gain, once that is known.
    first: list[int | None]

    @property
    def ids(self) -> list[int]:
        return [i for rows in self.groups for i, _ in rows]


class Sums:
    """Gains and losses of a round's candidates over the rows that a task has met."""

    def __init__(self, groups: list[list[tuple[int, object]]], rule: Rule):
        self.rule, self.gains = rule, [np.zeros(len(x)) for x in groups]
        self.losses: dict[int, np.ndarray] = {}

    def add(self, g: int, w: np.ndarray, s: np.ndarray, imp: np.ndarray) -> None:
        for a in range(0, len(w), ROWS):
            part = slice(a, a + ROWS)
            self.gains[g] += imp[part] @ self.rule.gain(w[part], s[part, None])
            self.losses[g] = self.losses.get(g, 0.0) + self.rule.loss(w[part], s[part], imp[part])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for g, loss in self.losses.items():
            a, b = np.nonzero(loss)
            own = np.arange(len(self.gains[g]))
            columns = [np.full(len(own) + len(a), g, np.int32), np.concatenate([own, a]).astype(np.int32), np.concatenate([np.full(len(own), -1), b]).astype(np.int32), np.concatenate([self.gains[g], loss[a, b]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "a", "b", "x"])


TABLE = "g int, a int, b int, x double"


class EdgeKernel:
    """A kernel given as ``edges(i, j, w)``: column j says what candidate j does for row i. Edges and the state of rows are dealt by
    row once, so that rounds move sums by candidate alone; rows of very many candidates are dealt into parts."""

    #: Whether the bounds are the gains themselves and cheap enough for every round; if not, whether the first ones are the gains.
    exact, exact_first = True, True
    #: Candidates of a class in a round's table at most.
    width = WIDTH

    def __init__(self, edges: DataFrame):
        laid, self.large_rows = laid_out(edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"))
        self.edges = laid.withColumnsRenamed({"src": "i", "dst": "j"})

    def begin(self, nodes: DataFrame, rule: Rule, per_class: bool) -> DataFrame:
        """Takes the rows' first state; they come back as ``id, label``."""
        self.rule = rule
        self.state = dealt(nodes.select("id", "label", F.col("imp").cast("double").alias("imp"), F.lit(rule.start).alias("s")), "id")
        return self.state.select("id", "label")

    def columns(self, ids: list[int]) -> DataFrame:
        """``i, j, w`` of some candidates."""
        return self.edges.join(F.broadcast(self._table(ids)), "j")

    def _table(self, ids: list[int]) -> DataFrame:
        return _small(self.state.sparkSession, j=ids)

    def _with_state(self, edges: DataFrame) -> DataFrame:
        rows, key = to_parts(self.state.select(F.col("id").alias("src"), "s", "imp"), self.large_rows)
        return edges.withColumnRenamed("i", "src").join(rows, key).withColumnRenamed("src", "i")

    def _gains(self, edges: DataFrame) -> DataFrame:
        joined = self._with_state(edges)
        return joined.groupBy(F.col("j").alias("id")).agg(F.sum(F.col("imp") * self.rule.gain(F.col("w"), F.col("s"))).alias("gain"))

    def bounds(self) -> DataFrame:
        """``id, gain``: no candidate gains more, and one that is not listed gains nothing."""
        return self._gains(self.edges)

    def gains(self, ids: list[int]) -> dict[int, float]:
        return {i: 0.0 for i in ids} | {r.id: r.gain for r in self._gains(self.columns(ids)).collect()}

    def tables(self, now: Round) -> DataFrame:
        """``g, a, b, x``: of group g the gain of candidate a (b is -1), or what candidate b takes of it, in parts to be summed."""
        rows = self._with_state(self.columns(now.ids)).groupBy("i", "s", "imp").agg(F.collect_list("j").alias("js"), F.collect_list("w").alias("ws"))
        order = sorted((i, g, k) for g, members in enumerate(now.groups) for k, (i, _) in enumerate(members))
        ids, group, place = (np.array(x, np.int64) for x in zip(*order))
        groups, rule = now.groups, self.rule

        def run(batches):
            sums = Sums(groups, rule)
            for batch in batches:
                s, imp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                at = np.repeat(np.arange(len(batch)), np.diff(batch.column(3).offsets.to_numpy()))
                k, w = np.searchsorted(ids, batch.column(3).flatten().to_numpy()), batch.column(4).flatten().to_numpy()
                for g in np.unique(group[k]):
                    own = group[k] == g
                    for a in range(0, len(batch), ROWS):
                        part = own & (at >= a) & (at < a + ROWS)
                        rows, row = np.unique(at[part], return_inverse=True)
                        dense = np.zeros((len(rows), len(groups[g])))
                        dense[row, place[k[part]]] = w[part]
                        sums.add(int(g), dense, s[rows], imp[rows])
            yield from sums.batches()

        return rows.mapInArrow(run, TABLE)

    def advance(self, ids: list[int]) -> None:
        """The state after the picks; a maximum or a product over them, so their order does not matter."""
        columns, s = self.columns(ids), F.col("s")
        if self.rule is REACH:
            moved = columns.groupBy("i").agg(F.product(1 - F.col("w")).alias("f"))
            new = s * F.coalesce("f", F.lit(1.0))
        else:
            moved = columns.groupBy("i").agg(F.max("w").alias("f"))
            new = F.greatest(s, F.coalesce("f", s))
        self.state = dealt(self.state.join(moved, F.col("id") == F.col("i"), "left").select("id", "label", "imp", new.alias("s")))


class WalkKernel(EdgeKernel):
    """``sum_t scale[t] P^t`` of a sparse matrix ``p(src, dst, w)``, its rows divided by their largest entry if ``row_max``:
    candidate j does for row i what entry (j, i) says, 0 to ``top`` (or more, for COVERAGE only).

    Neither the sum nor a power is ever stored. Bounds come from products with one vector; the rows of candidates that are
    looked into from sparse products with those rows alone, both by Horner's rule, so that each step adds its own term and no
    power is kept. Entries of a partial sum up to ``prune`` are dropped (0: none). Some ``held`` rows are kept from round to round.
    """

    exact = False

    def __init__(self, p: DataFrame, scale: list[float], row_max: bool = False, prune: float = 0.0, held: int = 4 * WIDTH, top: float = 1.0):
        self.top = top
        self.p, self.scale, self.row_max, self.prune, self.most = p, scale, row_max, prune, held
        self.exact_first = not row_max
        self.split, self.large_rows = hubs(p), None
        self.small = SmallMatrix.sent(p, prune, BROADCAST_EDGES)
        self.held: set[int] = set()
        self.parts: list[DataFrame] = []

    def bounds(self) -> DataFrame:
        # what a candidate gains is at most w (1 - s / top) or w s of each row, where w is by the largest entry of its own
        free = F.col("s") if self.rule is REACH else 1 - F.col("s") / self.top
        x = cut(self.state.select("id", (F.col("imp") * free).alias("x")))
        sums = walk_sum(self.p, x, self.scale)
        if not self.row_max or self.prune:
            return sums.select("id", F.col("x").alias("gain"))
        return sums.join(self._on_diagonal(), "id", "left").select("id", (F.col("x") / F.coalesce("m", F.lit(self.scale[0]))).alias("gain"))

    def _on_diagonal(self) -> DataFrame:
        """``id, m``: the entry (id, id) as far as walks of none and two steps go; the largest of its row is no smaller, and most often
        this very entry. Without it a bound may be too large by a tenth, and many more rows have to be computed."""
        back = self.p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
        two = self.p.join(back, ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("back")).alias("two"))
        return two.select("id", (F.lit(self.scale[0]) + F.lit(self.scale[2] if len(self.scale) > 2 else 0.0) * F.col("two")).alias("m"))

    def _rows(self, ids: list[int]) -> DataFrame:
        own = self._table(ids)
        if self.small is not None:
            return self._rows_in_tasks(own)
        part = lambda c: own.select(F.col("j").alias("src"), F.col("j").alias("dst"), F.lit(c).alias("w"))
        total = part(self.scale[-1])
        for c in self.scale[-2::-1]:
            total = add(matmul(total, self.p, self.prune, self.split), part(c))
        if self.row_max:
            total = cut(total)
            top = total.groupBy("src").agg(F.max("w").alias("m"))
            total = total.join(F.broadcast(top), "src").select("src", "dst", (F.col("w") / F.col("m")).alias("w"))
        return total.select(F.col("dst").alias("i"), F.col("src").alias("j"), "w")

    def _rows_in_tasks(self, own: DataFrame) -> DataFrame:
        sent, scale, row_max = self.small, self.scale, self.row_max

        def run(batches):
            for batch in batches:
                for src, dst, w in sent.value.sums(batch.column(0).to_numpy(), scale):
                    w = by_row_max(src, w) if row_max else w
                    yield pa.RecordBatch.from_arrays([pa.array(dst), pa.array(src), pa.array(w)], names=["i", "j", "w"])

        return own.repartition(own.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "i long, j long, w double")

    def columns(self, ids: list[int]) -> DataFrame:
        if missing := [i for i in ids if i not in self.held]:
            if len(self.held) + len(missing) > max(self.most, len(ids)):
                keep = [i for i in ids if i in self.held]
                self.parts, self.held = [cut(self._of(keep))] if keep else [], {*keep}
            self.parts.append(cut(self._rows(missing)))
            self.held |= {*missing}
        return self._of(ids)

    def _of(self, ids: list[int]) -> DataFrame:
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every.join(F.broadcast(self._table(ids)), "j").select("i", "j", "w")


class CosineKernel:
    """Cosine similarity of all pairs (within labels, if asked), computed block by block and never stored.

    A pass over the rows meets the vectors of a few candidates, which are sent to every task. Rows carry their state; picks since
    it was written are sent along and taken into account as rows are read.
    """

    exact, exact_first = False, True
    #: All columns overlap, so few picks are certain at a time.
    width = 32

    def __init__(self, samples: DataFrame, by_label: bool):
        self.units, self.by_label = unit_vectors(samples), by_label

    def begin(self, nodes: DataFrame, rule: Rule, per_class: bool) -> DataFrame:
        if rule is not FACILITY:
            raise ValueError("cosines can be negative, which only facility location allows")
        self.rule, self.pending, self.met = rule, [], {}
        imp = nodes.select("id", F.col("imp").cast("double").alias("imp"))
        self.rows = cut(self.units.filter("u IS NOT NULL").join(imp, "id").select("id", "label", "imp", F.lit(rule.start).alias("s"), "u"))
        return self.rows.select("id", "label").union(nodes.select("id", "label").join(self.rows, "id", "left_anti"))

    def _vectors(self, ids: list[int]) -> dict[object, tuple[np.ndarray, np.ndarray]]:
        """``ids, vectors`` by label, or all under None."""
        if missing := [i for i in ids if i not in self.met]:
            found = self.rows.join(F.broadcast(_small(self.rows.sparkSession, j=missing)), F.col("id") == F.col("j")).select("id", "label", "u").toArrow().combine_chunks()
            vectors = found["u"].combine_chunks().flatten().to_numpy().reshape(len(found), -1) if len(found) else []
            if len(self.met) + len(found) > 2 * PASS:
                self.met = {i: self.met[i] for i in [*self.pending, *ids] if i in self.met}
            self.met.update({i: (label, v) for i, label, v in zip(found["id"].to_pylist(), found["label"].to_pylist(), vectors)})
        by: dict = defaultdict(list)
        for i in ids:
            if i in self.met:
                by[self.met[i][0] if self.by_label else None].append(i)
        return {label: (np.array(own), np.stack([self.met[i][1] for i in own])) for label, own in by.items()}

    def _passed(self, work: Callable, schema: str) -> DataFrame:
        """``work(parts)`` in each task, where a part is ``label, id, imp, s, u`` of rows of one label, with the state of now."""
        picks, by_label, after = self._vectors(self.pending) if self.pending else {}, self.by_label, self.rule.after

        def run(batches):
            def parts():
                for batch in batches:
                    for a in range(0, len(batch), ROWS):
                        b = batch.slice(a, ROWS)
                        i, imp, s = (b.column(k).to_numpy() for k in (0, 2, 3))
                        u = b.column(4).flatten().to_numpy().reshape(len(b), -1)
                        labels = b.column(1).to_pylist() if by_label else [None] * len(b)
                        for label in {*labels}:
                            own = np.array([x == label for x in labels])
                            state = s[own]
                            if label in picks:
                                state = after((u[own] @ picks[label][1].T).max(1), state)
                            yield label, i[own], imp[own], state, u[own]

            yield from work(parts())

        return self.rows.mapInArrow(run, schema)

    def _now(self) -> DataFrame:
        def work(parts):
            for _, i, _, s, _ in parts:
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s)], names=["i", "s_now"])

        now = self._passed(work, "i long, s_now double")
        return self.rows.join(now, F.col("id") == F.col("i")).select("id", "label", "imp", F.col("s_now").alias("s"), "u")

    def bounds(self, among: DataFrame | None = None) -> DataFrame:
        rows = cut(self._now()) if self.pending else self.rows
        left = rows if among is None else rows.join(among.select("id"), "id", "left_semi")

        def work(a: Block, b: Block) -> Block:
            # the gain of facility location, in place: tables of this size cost more to allocate than to compute
            w = a["u"] @ b["u"].T
            w -= b["s"]
            return {"id": a["id"], "gain": np.maximum(w, 0.0, out=w) @ b["imp"]}

        parts = blocked(left.select("id", "label", "u"), rows, by_tiles(work), "id long, gain double", self.by_label, added("gain"))
        return parts.groupBy("id").agg(F.sum("gain").alias("gain"))

    def gains(self, ids: list[int]) -> dict[int, float]:
        some, rule = self._vectors(ids), self.rule

        def work(parts):
            total = {label: np.zeros(len(x[0])) for label, x in some.items()}
            for label, _, imp, s, u in parts:
                if label in some:
                    total[label] += imp @ rule.gain(u @ some[label][1].T, s[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some[x][0] for x in total])), pa.array(np.concatenate(list(total.values())))], names=["id", "gain"])

        if not some:
            return {i: 0.0 for i in ids}
        summed = self._passed(work, "id long, gain double").groupBy("id").agg(F.sum("gain").alias("gain"))
        return {i: 0.0 for i in ids} | {r.id: r.gain for r in summed.collect()}

    def tables(self, now: Round) -> DataFrame:
        some, groups, rule = self._vectors(now.ids), now.groups, self.rule
        own: dict = {}
        for g, members in enumerate(groups):
            label = members[0][1] if self.by_label else None
            place = {i: k for k, (i, _) in enumerate(members)}
            if label in some:
                u = np.zeros((len(members), some[label][1].shape[1]))
                for i, v in zip(some[label][0].tolist(), some[label][1]):
                    u[place[i]] = v
                own[label] = (g, u)

        def work(parts):
            sums = Sums(groups, rule)
            for label, _, imp, s, u in parts:
                if label in own:
                    g, v = own[label]
                    sums.add(g, u @ v.T, s, imp)
            yield from sums.batches()

        return self._passed(work, TABLE)

    def advance(self, ids: list[int]) -> None:
        self.pending = self.pending + ids
        if len(self.pending) > PENDING:
            self.rows, self.pending = cut(self._now()), []


def certain(ids: list[int], labels: list, gains: np.ndarray, losses: np.ndarray, left: dict, outside: tuple[float, int] | None, first: int | None, positive: bool = True) -> list[int]:
    """Places of the candidates that greedy picks next, as far as the losses by pairs prove it."""
    lead = lambda x: LEAD * max(1.0, abs(x))
    left, most, total, picks = dict(left), np.zeros(len(ids)), np.zeros(len(ids)), []
    live = np.ones(len(ids), bool)
    number = np.array(ids)
    while True:
        open_ = live & np.array([left[c] > 0 for c in labels])
        if not open_.any():
            return picks
        low, high = gains - (np.minimum(total, gains) if positive else total), gains - most
        if not picks and first is not None:
            p = first
        elif not picks:
            best = gains[open_].max()
            near = np.flatnonzero(open_ & (gains >= best - lead(best)))
            p = int(near[number[near].argmin()])
        else:
            at = np.flatnonzero(open_)
            p = int(at[np.lexsort((number[at], -low[at]))[0]])
            rivals = [(float(high[k]), int(number[k])) for k in at if k != p] + ([outside] if outside else [])
            if not all(low[p] - gain > lead(low[p]) or low[p] == gain == 0.0 and number[p] < i for gain, i in rivals):
                return picks
        picks.append(p)
        live[p] = False
        left[labels[p]] -= 1
        most, total = np.maximum(most, losses[:, p]), total + losses[:, p]


def _picked(tables: DataFrame, now: Round, positive: bool) -> tuple[list[list[int]], list[np.ndarray]]:
    """By group the places of the candidates that are picked, in order, and the gains of all."""
    found = tables.groupBy("g", "a", "b").agg(F.sum("x").alias("x")).toArrow()
    group, a, b, x = (found[c].to_numpy() for c in ("g", "a", "b", "x"))
    picks, gains = [], []
    for g, members in enumerate(now.groups):
        gain, loss = np.zeros(len(members)), np.zeros((len(members), len(members)))
        own, pair = (group == g) & (b < 0), (group == g) & (b >= 0)
        gain[a[own]], loss[a[pair], b[pair]] = x[own], x[pair]
        gains.append(gain)
        picks.append(certain([i for i, _ in members], [c for _, c in members], gain, loss, now.left, now.outside[g], now.first[g], positive))
    return picks, gains


@dataclass
class Search:
    """The bounds of all candidates, as a table, and what is known of a round."""

    kernel: object
    bounds: DataFrame
    per_class: bool
    width: int
    fresh: dict[int, tuple[float, object]] = field(default_factory=dict)
    looked: int = 0

    def _top(self, gone: list[int], left: dict, n: int) -> dict[object, list[tuple[float, int, object, bool]]]:
        """By group the ``n`` largest bounds of candidates that are neither picked nor fresh, and the ``width`` + 1 largest that the
        table has as gains of this round, as ``(-bound, id, label, is a gain)``."""
        spark = self.bounds.sparkSession
        free = self.bounds.filter(F.col("label").isin([c for c, k in left.items() if k and c is not None]) | (F.lit(bool(left.get(None))) & F.col("label").isNull()))
        out = _small(spark, id=[*gone, *self.fresh])
        own = Window.partitionBy("known", *(["label"] if self.per_class else [])).orderBy(F.desc("gain"), F.asc("id"))
        best = free.join(out, "id", "left_anti").withColumn("r", F.row_number().over(own)).filter(F.col("r") <= max(n, self.width + 1))
        found: dict = defaultdict(list)
        for r in best.select("id", "label", "gain", "known").collect():
            found[r.label if self.per_class else None].append((-r.gain, r.id, r.label, r.known))
        return found

    def candidates(self, gone: list[int], left: dict) -> dict[object, list[tuple[float, int, object]]]:
        """By group the best ``width`` + 1 candidates, so that the best gain is known to be the best of all."""
        probe, n = self.width, self.width + 1
        while True:
            top = self._top(gone, left, n)
            found: dict = {g: [x[:3] for x in rows if x[3]] for g, rows in top.items()}
            for i, (gain, label) in self.fresh.items():
                if left[label]:
                    found.setdefault(label if self.per_class else None, []).append((-gain, i, label))
            open_: list[tuple[float, int, object]] = []
            floors: dict = {}
            seen_all = True
            for g, rows in top.items():
                best = max((-x[0] for x in found[g]), default=-math.inf)
                floor = floors[g] = best - LEAD * max(1.0, abs(best)) if found[g] else best
                # where no gain is below nothing, a bound of nothing is exact
                stale = [x[:3] for x in rows if not x[3] and not (self.kernel.exact or self.kernel.rule.positive and x[0] >= 0) and -x[0] >= floor]
                seen_all &= len(stale) < min(n, sum(not x[3] for x in rows))
                open_ += stale
                found[g] += [x[:3] for x in rows if not x[3] and x[:3] not in stale] if len(stale) < n else []
            if not open_:
                return {g: sorted(rows) for g, rows in found.items()}
            if self._look(sorted(open_)[:probe], gone, floors) and seen_all and len(open_) <= probe:
                looked = {i for _, i, _ in open_}
                for g, rows in found.items():
                    rows += [(-gain, i, c) for i, (gain, c) in self.fresh.items() if i in looked and (c if self.per_class else None) == g]
                return {g: sorted(rows) for g, rows in found.items()}
            probe = n = PASS

    def _look(self, some: list[tuple[float, int, object]], gone: list[int], floors: dict) -> bool:
        """Computes gains; False if they are in the table and not in ``fresh``. ``floors``: by group what a bound must reach."""
        if len(self.fresh) + len(some) > FRESH and hasattr(self.kernel, "units"):
            # too many for the driver: all that can reach the top stay a table, from one pass, however many they are
            spark = self.bounds.sparkSession
            rest = self.bounds.filter(~F.col("known")).join(_small(spark, id=[*gone, *self.fresh]), "id", "left_anti")
            if self.per_class:
                least = spark.createDataFrame(pa.table({"c_": pa.array([*floors], pa.int64()), "f_": pa.array([*floors.values()], pa.float64())}))
                rest = rest.join(F.broadcast(least), F.col("label").eqNullSafe(F.col("c_"))).filter(F.col("gain") >= F.col("f_"))
            else:
                rest = rest.filter(F.col("gain") >= floors[None])
            new = self.kernel.bounds(rest).select(F.col("id").alias("i_"), F.col("gain").alias("g_"))
            met = self.bounds.join(new, F.col("id") == F.col("i_"), "left")
            self.bounds = cut(met.select("id", "label", F.coalesce("g_", "gain").alias("gain"), (F.col("known") | F.col("g_").isNotNull()).alias("known")))
            return False
        self.looked += len(some)
        gains = self.kernel.gains([i for _, i, _ in some])
        self.fresh.update({i: (gains[i], label) for _, i, label in some})
        return True

    def keep(self) -> None:
        """Writes what is known to the bounds; the next round's gains are lower."""
        new = _small(self.bounds.sparkSession, i_=[*self.fresh], g_=[float(gain) for gain, _ in self.fresh.values()])
        met = self.bounds.join(F.broadcast(new), F.col("id") == F.col("i_"), "left")
        self.bounds = cut(met.select("id", "label", F.least("gain", F.coalesce("g_", "gain")).alias("gain"), F.lit(False).alias("known")))
        self.fresh, self.looked = {}, 0


def greedy(kernel, nodes: DataFrame, budget: int, rule: Rule = FACILITY, per_class: bool = True, width: int = WIDTH, report: list | None = None) -> DataFrame:
    """``id, label, rank`` from ``nodes(id, label, imp)``: up to ``budget`` picks a class.

    Per class, rank counts within the class, and the kernel must not join classes. Otherwise one ranking runs over all rows;
    a class leaves when it has its budget. ``report`` gets ``(picks, gains computed one by one)`` of each round.
    """
    spark = nodes.sparkSession
    rows = kernel.begin(nodes, rule, per_class)
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    left = {c: min(budget, n) for c, n in sizes.items()}
    width = min(width, kernel.width)
    width = max(2, min(width, CANDIDATES // max(1, len(sizes)))) if per_class else width
    with_gain = lambda: rows.join(kernel.bounds(), "id", "left").select("id", "label", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.lit(kernel.exact_first).alias("known"))
    picks: list[tuple[int, object, int]] = []
    ranks: dict = defaultdict(int)
    search = None
    while any(left.values()):
        gone = [p[0] for p in picks]
        # no more candidates than picks that are to come may need
        most = max(left.values()) if per_class else sum(left.values())
        look = min(width, max(16, 8 * most))
        if search is None or kernel.exact:
            search = Search(kernel, with_gain() if kernel.exact else cut(with_gain()), per_class, look)
        search.width = look
        found = list(search.candidates(gone, left).values())
        now = Round([[(i, c) for _, i, c in rows_[:look]] for rows_ in found], [(-rows_[look][0], rows_[look][1]) if len(rows_) > look else None for rows_ in found], left, [0 if kernel.exact else None] * len(found))
        places, gains = _picked(kernel.tables(now), now, rule.positive)
        new = [now.groups[g][a] for g, own in enumerate(places) for a in own]
        for i, c in new:
            key = c if per_class else None
            ranks[key] += 1
            left[c] -= 1
            picks.append((i, c, ranks[key]))
        if report is not None:
            report.append((len(new), search.looked))
        if any(left.values()):
            if not kernel.exact:
                search.fresh.update({i: (float(x), c) for members, own in zip(now.groups, gains) for (i, c), x in zip(members, own)})
                search.keep()
            kernel.advance([i for i, _ in new])
    return _ranked(spark, picks)


# ------------------------------------------------------------------------------------------------- farthest points


class CosineDistance:
    """``1 - cosine`` of all pairs."""

    def __init__(self, samples: DataFrame):
        self.points = cut(samples.select("id", l2_normalize(F.col("v")).alias("u")))

    def among(self, ids: list[int]) -> Callable[[int, int], float]:
        u = {r.id: np.array(r.u) for r in self.points.filter(F.col("id").isin(ids)).collect()}
        return lambda a, b: float(1 - u[a] @ u[b])

    def nearest_of(self, state: DataFrame, picked: list[int]) -> DataFrame:
        """``id, d``: distance to the nearest of ``picked`` in the same class; the picks' vectors are broadcast."""
        new = self.points.filter(F.col("id").isin(picked)).join(state.select("id", "label"), "id")
        new = F.broadcast(new.select(F.col("id").alias("p"), F.col("u").alias("pu"), F.col("label").alias("pl")))
        own = self.points.join(state.select("id", "label"), "id").join(new, F.col("label") == F.col("pl"))
        return own.groupBy("id").agg(F.min(1 - F.aggregate(F.zip_with("u", "pu", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)).alias("d"))


class HopDistance:
    """``1 - cosine`` of pairs within some hops of a graph, ``far`` of all others. ``pairs(src, dst)``, ``units(id, u)``: cosines are
    computed for pairs of picks alone, so that no vector moves for each of all pairs."""

    def __init__(self, pairs: DataFrame, units: DataFrame, far: float = 2.0):
        self.pairs, self.units, self.far = cut(pairs.select("src", "dst")), cut(units.select("id", "u")), far

    def among(self, ids: list[int]) -> Callable[[int, int], float]:
        some = _small(self.pairs.sparkSession, j=ids)
        of_ids = self.pairs.join(F.broadcast(some), F.col("src") == F.col("j"), "left_semi").join(F.broadcast(some), F.col("dst") == F.col("j"), "left_semi")
        near = {(r.src, r.dst) for r in of_ids.collect()}
        u = {r.id: np.array(r.u) for r in self.units.join(F.broadcast(some), F.col("id") == F.col("j"), "left_semi").collect()}
        return lambda a, b: float(1 - u[a] @ u[b]) if (a, b) in near else self.far

    def nearest_of(self, state: DataFrame, picked: list[int]) -> DataFrame:
        some = F.broadcast(_small(self.pairs.sparkSession, j=picked))
        of_picks = F.broadcast(self.units.join(some, F.col("id") == F.col("j"), "left_semi").select(F.col("id").alias("src"), F.col("u").alias("pu")))
        near = self.pairs.join(of_picks, "src").join(self.units, F.col("dst") == F.col("id"))
        near = near.select("id", (1 - dot(F.col("pu"), F.col("u"))).alias("d")).groupBy("id").agg(F.min("d").alias("d"))
        classes = state.join(some, F.col("id") == F.col("j"), "left_semi").select(F.col("label").alias("pl")).distinct()
        reached = state.join(F.broadcast(classes), F.col("label") == F.col("pl"), "left_semi").select("id")
        return reached.join(near, "id", "left").select("id", F.least(F.coalesce("d", F.lit(self.far)), F.lit(self.far)).alias("d"))


def farthest_points(distance, nodes: DataFrame, budget: int, first: DataFrame, width: int = 64) -> DataFrame:
    """``id, label, rank``: in each class after its ``first(id, label)``, the row farthest from its nearest pick; ties by id.

    A row's distance to the picks only falls, so rounds are lazy as in :func:`greedy`.
    """
    spark = nodes.sparkSession
    picks = {r.label: [r.id] for r in first.collect()} if budget > 0 else {}
    sizes = {r.label: r.n for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    need = {c: min(budget, sizes[c]) for c in picks}
    state = cut(nodes.select("id", "label", F.lit(float("inf")).alias("d")))
    new = [i for ids in picks.values() for i in ids]
    while any(len(picks[c]) < need[c] for c in picks):
        moved = distance.nearest_of(state, new).withColumnRenamed("d", "e")
        state = cut(state.join(moved, "id", "left").select("id", "label", F.least("d", F.coalesce("e", "d")).alias("d")))
        done = _small(spark, id=[i for ids in picks.values() for i in ids])
        open_ = [c for c in picks if len(picks[c]) < need[c]]
        free = state.filter(F.col("label").isin(open_)).join(done, "id", "left_anti")
        place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("d"), "id"))
        rows = free.withColumn("r", place).filter(F.col("r") <= width + 1).collect()
        measure = distance.among([r.id for r in rows])
        new = []
        for c in open_:
            own = sorted((r for r in rows if r.label == c), key=lambda r: r.r)
            bound = own[width].d if len(own) > width else -1.0
            live, start = {r.id: r.d for r in own[:width]}, True
            while live and len(picks[c]) < need[c]:
                i = min(live, key=lambda x: (-live[x], x))
                if not start and live[i] <= bound + LEAD:
                    break
                start = False
                picks[c].append(i)
                new.append(i)
                del live[i]
                for x in live:
                    live[x] = min(live[x], measure(i, x))
    rows = [(i, c, n + 1) for c, ids in picks.items() for n, i in enumerate(ids[: need[c]])]
    return _ranked(spark, rows)


#: Numbers of a class's vectors (8 bytes each) that one task may hold.
HELD = 1 << 23


def _by_size(samples: DataFrame, budget: int, steps: Callable, extra: str = "") -> tuple[DataFrame | None, DataFrame | None]:
    """Picks ``id, label, rank`` of the classes whose vectors fit ``HELD``, by ``steps(vectors, *extra)`` (places in the order of ids)
    in one task a class, and the rows of all larger classes; None where there are none."""
    extras = extra.split()
    rows = samples.filter("label IS NOT NULL AND v IS NOT NULL")
    numbers = rows.groupBy("label").agg(F.sum(F.size("v").cast("long")).alias("n"))
    large = [r.label for r in numbers.filter(F.col("n") > HELD).collect()]
    kind = rows.schema["label"].dataType.simpleString()

    def run(table):
        table = table.sort_by("id").combine_chunks()
        u = table["u"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        picks = steps(u, *(table[c].to_numpy() for c in extras))[:budget]
        return pa.table({"id": table["id"].take(pa.array(picks, pa.int64())), "label": table["label"].slice(0, len(picks)), "rank": pa.array(np.arange(1, len(picks) + 1), pa.int32())})

    small = rows.filter(~F.col("label").isin(large)) if large else rows
    small = small.select("id", "label", l2_normalize(F.col("v")).alias("u"), *extras)
    return small.groupBy("label").applyInArrow(run, f"id long, label {kind}, rank int"), rows.filter(F.col("label").isin(large)) if large else None


def _weighted_steps(budget: int) -> Callable:
    def steps(u: np.ndarray, importance: np.ndarray, scaled: np.ndarray) -> list[int]:
        d, scale, picks, score = np.full(len(u), np.inf), 1.0, [], importance.copy()
        while len(picks) < min(budget, len(u)):
            score[picks] = -np.inf
            picks.append(int(score.argmax()))
            d = np.minimum(d, 1 - u @ u[picks[-1]])
            scale = d.max() if d.max() > 1e-8 else scale
            score = 0.5 * d / scale + 0.5 * scaled
        return picks

    return steps


def _herding_steps(budget: int) -> Callable:
    def steps(u: np.ndarray) -> list[int]:
        mean, total, picks = u.mean(0), np.zeros(u.shape[1]), []
        while len(picks) < min(budget, len(u)):
            score = u @ ((len(picks) + 1) * mean - total)
            score[picks] = -np.inf
            picks.append(int(score.argmax()))
            total = total + u[picks[-1]]
        return picks

    return steps


def weighted_farthest_points(samples: DataFrame, budget: int, importance: DataFrame) -> DataFrame:
    """Farthest points where half the score is importance, scaled within the class. The scale of distances changes with every
    pick, so nothing bounds a later score: a class that fits ``HELD`` is seen to in a task, all larger ones by one job a step."""
    from corepick.functions.scores import min_max_normalize_by_class

    rows = samples.select("id", "label", "v").join(importance.select("id", "importance"), "id")
    scaled = cut(min_max_normalize_by_class(rows.withColumn("scaled", F.col("importance")), "scaled"))
    small, large = _by_size(scaled, budget, _weighted_steps(budget), "importance scaled")
    return small if large is None else small.union(_weighted_by_jobs(large, budget, importance))


def _weighted_by_jobs(samples: DataFrame, budget: int, importance: DataFrame) -> DataFrame:
    from corepick.functions.scores import min_max_normalize_by_class

    spark, metric = samples.sparkSession, CosineDistance(samples)
    rows = samples.select("id", "label").join(importance.select("id", "importance"), "id")
    scaled = min_max_normalize_by_class(rows.withColumn("scaled", F.col("importance")), "scaled")
    state = cut(scaled.select("id", "label", "importance", "scaled", F.lit(float("inf")).alias("d")))
    norms: dict = {}
    picks: dict = defaultdict(list)
    for step in range(budget):
        done = _small(spark, id=[i for ids in picks.values() for i in ids])
        free = state.join(done, "id", "left_anti")
        if step == 0:
            score = F.col("importance")
        else:
            top = {r.label: r.m for r in state.groupBy("label").agg(F.max("d").alias("m")).collect()}
            for c, m in top.items():
                if m > 1e-8:
                    norms[c] = m
            scale = spark.createDataFrame([(c, float(norms.get(c, 1.0))) for c in top], "c_ long, m_ double")
            free = free.join(F.broadcast(scale), F.col("label") == F.col("c_"))
            score = 0.5 * F.col("d") / F.col("m_") + 0.5 * F.col("scaled")
        best = free.groupBy("label").agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("minus"))).alias("b"))
        new = [(-r.b.minus, r.label) for r in best.collect()]
        for i, c in new:
            picks[c].append(i)
        if step + 1 < budget and new:
            moved = metric.nearest_of(state, [i for i, _ in new]).withColumnRenamed("d", "e")
            state = cut(state.join(moved, "id", "left").select("id", "label", "importance", "scaled", F.least("d", F.coalesce("e", "d")).alias("d")))
    out = [(i, c, n + 1) for c, ids in picks.items() for n, i in enumerate(ids)]
    return _ranked(spark, out)


def herding(samples: DataFrame, budget: int) -> DataFrame:
    """Step i of each class picks the largest ``x . ((i + 1) mean - sum of picks)`` over unit vectors. Scores move both ways, so
    nothing bounds a later one: a class that fits ``HELD`` is seen to in a task, all larger ones by one job a step, for which the
    driver holds one direction a class."""
    small, large = _by_size(samples.select("id", "label", "v"), budget, _herding_steps(budget))
    return small if large is None else small.union(_herding_by_jobs(large, budget))


def _herding_by_jobs(samples: DataFrame, budget: int) -> DataFrame:
    spark = samples.sparkSession
    units = cut(unit_vectors(samples))
    mean = units.select("label", F.posexplode("u").alias("p", "x")).groupBy("label", "p").agg(F.avg("x").alias("x"))
    means: dict = defaultdict(dict)
    for r in mean.collect():
        means[r.label][r.p] = r.x
    means = {c: np.array([v[i] for i in sorted(v)]) for c, v in means.items()}
    total = {c: np.zeros_like(m) for c, m in means.items()}
    picks: dict = defaultdict(list)
    for step in range(budget):
        aims = spark.createDataFrame([(c, [float(x) for x in (step + 1) * means[c] - total[c]]) for c in means], "c_ long, aim_ array<double>")
        done = _small(spark, id=[i for ids in picks.values() for i in ids])
        free = units.join(done, "id", "left_anti").join(F.broadcast(aims), F.col("label") == F.col("c_"))
        score = F.aggregate(F.zip_with("u", "aim_", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        best = free.groupBy("label").agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("minus"), F.col("u"))).alias("b")).collect()
        for r in best:
            picks[r.label].append(-r.b.minus)
            total[r.label] = total[r.label] + np.array(r.b.u)
    out = [(i, c, n + 1) for c, ids in picks.items() for n, i in enumerate(ids)]
    return _ranked(spark, out)
