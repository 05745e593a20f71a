"""Groups of like sequences of words: buckets by key, a filter that drops no link, alignment, connected parts.

An item is a sequence of words with an identity ``v`` (16 bytes), its number of words ``w``, a print ``fp`` and some keys.
Items that share a key are compared by their prints inside the task that has the bucket; no pairs are emitted. What the prints
connect in a bucket is a part, and each part is sent on as rows ``(g, v)``, where ``g`` is its least member. Parts of many
buckets with one least member are one group, so that like items, which share most of their keys, move their texts about once.
A task then aligns the items of a group that it has not connected yet, and returns the links that connect them. Links only
serve to find connected parts, so none is lost.

A bucket of more than ``CHUNK`` items is met by pairs of chunks, each a group of its own; so is a group of texts beyond
``TEXTS``. So no task holds more than two chunks, and no pair is left out.

A print has the parity of the number of words that fall on each of its bits; the second, third ... time that an item has a word
count as other words, so that what an item says twice does not cancel out. It has at least twice as many bits as the item
has words (a power of two), and folding it in half by exclusive or gives the print of half the size, so that items of
different lengths compare. A changed word flips two bits at most, one put in or left out flips one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corepick.llm.align import edits_within
from corepick.llm.common import cut, fits
from corepick.llm.groups import connected_groups
from corepick.llm.words import Words, mix
from corepick.llm.words import slices as text_slices

#: Items of one bucket, and texts of one group, that meet at once.
CHUNK = 8192
TEXTS = 2048
BROADCAST_KEYS = 2_000_000
#: Words up to which an alignment is as cheap as a bound of it.
FEW = 128
#: Print rows that are compared at once, and pairs that are looked for before what is one part already is left out.
AT_ONCE, PAIRS = 1 << 18, 1 << 12


def edits_allowed(words: int, similarity: float) -> int:
    return int((1 - similarity) * words + 1e-9)


def print_bits(words: np.ndarray) -> np.ndarray:
    """Size of the prints of items with so many words."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * words, 1))).astype(np.int64))


def numbered(x: np.ndarray) -> np.ndarray:
    """For each value how many equal ones are counted before it."""
    order, number = np.argsort(x), np.arange(len(x))
    new = np.concatenate([[True], x[order][1:] != x[order][:-1]])[: len(x)]
    out = np.empty(len(x), np.int64)
    out[order] = number - np.maximum.accumulate(np.where(new, number, 0))
    return out


def prints_of(hashes: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Prints of items, given by the hashes of all their words and how many each has."""
    bits = print_bits(lengths)
    own, base = np.repeat(bits, lengths), np.repeat(np.cumsum(bits) - bits, lengths)
    place = lambda h, some: (mix(h) & (own[some].astype(np.uint64) - np.uint64(1))).astype(np.int64) + base[some]
    at = place(hashes, slice(None))
    count = np.bincount(at, minlength=int(bits.sum()))
    # a word that an item has again shares its bit
    some = np.flatnonzero(count[at] > 1)
    label = numbered(mix(hashes[some] ^ mix(at[some].astype(np.uint64))))
    if len(again := np.flatnonzero(label)):
        some = some[again]
        at[some] = place(hashes[some] + label[again].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), some)
        count = np.bincount(at, minlength=int(bits.sum()))
    packed = np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes()
    ends = (np.cumsum(bits) // 8).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def present(sizes: np.ndarray) -> list[int]:
    """The different numbers among ``sizes``, which are powers of two."""
    found, n = int(np.bitwise_or.reduce(sizes)), 1
    out = []
    while n <= found:
        out += [n] if found & n else []
        n <<= 1
    return out


def bytes_of(values: pa.Array) -> pa.Buffer | bytes:
    """The bytes of a binary array without nulls, end to end."""
    if not len(values):
        return b""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))


class Prints:
    """Prints of many items, to compare pairs of them; ``half`` are folded once."""

    def __init__(self, fp: pa.Array, words: np.ndarray, similarity: float):
        self.words, self.similarity = words, similarity
        self.sizes = pc.binary_length(fp).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        self.full = np.frombuffer(bytes_of(fp), np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _rows(self, items: np.ndarray, size: int) -> np.ndarray:
        """The prints of some items as rows of ``size`` numbers."""
        out, own = np.empty((len(items), size), np.uint64), self.sizes[items]
        for s in present(own):
            some = slice(None) if s == own[0] and (own == s).all() else own == s
            rows = self.full[self.starts[items[some]][:, None] + np.arange(s)]
            while rows.shape[1] > size:
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            out[some] = rows
        return out

    def may_be_like(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of items may be alike by their lengths and prints."""
        longer, gap = np.maximum(self.words[a], self.words[b]), np.abs(self.words[a] - self.words[b])
        edits = ((1 - self.similarity) * longer + 1e-9).astype(np.int64)
        out = gap <= edits
        size = np.minimum(self.sizes[a], self.sizes[b])
        for s in present(size[out]):
            at = np.flatnonzero(out & (size == s))
            step = max(1, AT_ONCE // s)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                bits = np.bitwise_count(self._rows(a[some], s) ^ self._rows(b[some], s)).sum(axis=1, dtype=np.int64)
                out[some] = bits <= 2 * edits[some] - gap[some]
        return out


def runs(batches, names: list[str], key: int) -> Iterator[pa.Table]:
    """Whole groups (rows in the order of their first ``key`` columns) as they come, many groups at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        batch = batch.select(names)
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for i in range(key):
            same &= pc.equal(batch.column(i), batch.column(i)[-1]).to_numpy(zero_copy_only=False)
        going = held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in range(key))
        whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if whole:
            yield pa.Table.from_batches([*held, batch.slice(0, whole)])
            held = [batch.slice(whole)]
        elif held and not going:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_ends(t: pa.Table, key: int) -> np.ndarray:
    """The end of each group of a table in the order of its first ``key`` columns."""
    new = np.zeros(len(t), bool)
    for i in range(key):
        c = t.column(i).combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), len(t))


def spread(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first row of its group, and how many rows of it follow."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.repeat(starts, ends - starts), np.repeat(ends, ends - starts) - np.arange(int(ends[-1])) - 1


def later_pairs(at: np.ndarray, left: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows ``at`` with each that follows in their group, nearer ones first, some at once; without those that share
    a root by then."""
    step = 1
    while len(at := at[left[at] >= step]):
        n = max(1, PAIRS // len(at))
        a = np.repeat(at, np.minimum(left[at] - step + 1, n))
        first = np.flatnonzero(np.diff(a, prepend=-1))
        b = a + step + np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        open_ = root[a] != root[b]
        yield a[open_], b[open_]
        step += n


def join_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray, start: int = 0, end: int | None = None) -> None:
    """Make the roots of ``x`` and ``y`` one, the least, for each pair; all rows that share a root are between start and end."""
    if len(x) == 1:
        (a, b), own = sorted((int(root[x[0]]), int(root[y[0]]))), root[start:end]
        own[own == b] = a
        return
    while len(x):
        a, b = root[x], root[y]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, jumped := root[root]):
            root[:] = jumped
        differ = root[x] != root[y]
        x, y = x[differ], y[differ]


def bucket_parts(prints: Prints, ends: np.ndarray) -> np.ndarray:
    """For each row the first row of the part that prints connect it to within its bucket."""
    n = int(ends[-1])
    first, left = spread(ends)
    root = np.arange(n)
    rest = np.flatnonzero(first != root)
    like = rest[prints.may_be_like(first[rest], rest)]
    root[like] = first[like]
    # what is one part already needs no more comparison
    apart = np.zeros(n, bool)
    apart[first[rest[root[rest] != first[rest]]]] = True
    for a, b in later_pairs(np.flatnonzero(apart[first]), left, root):
        like = prints.may_be_like(a, b)
        join_roots(root, a[like], b[like])
    return root


def _parts(similarity: float):
    """Rows ``key, lo, hi, v, w, fp`` in the order of the first three to ``g, v``: parts by their least members."""

    def run(batches):
        for t in runs(batches, ["key", "lo", "hi", "v", "w", "fp"], 3):
            prints = Prints(t.column("fp").combine_chunks(), t.column("w").to_numpy().astype(np.int64), similarity)
            root = bucket_parts(prints, group_ends(t, 3))
            members = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
            if not len(members):
                continue
            v = t.column("v").combine_chunks()
            halves = np.frombuffer(bytes_of(v.take(pa.array(members))), ">u8").reshape(-1, 2)
            order = np.lexsort((halves[:, 1], halves[:, 0], root[members]))
            owner = root[members][order]
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            least = np.repeat(members[order][new], np.diff(np.append(np.flatnonzero(new), len(order))))
            yield pa.RecordBatch.from_arrays([v.take(pa.array(least)), v.take(pa.array(members[order]))], names=["g", "v"])

    return run


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays have in common, repeated ones as often as both have them."""
    (a, m), (b, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.minimum(m, n[at])[b[at] == a].sum())


def neighbours(x: np.ndarray) -> np.ndarray:
    return mix(x[:-1] * np.uint64(31) + x[1:])


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two items, given by the hashes of their words, need no more edits than are allowed."""
    most, n = edits_allowed(max(len(x), len(y)), similarity), min(len(x), len(y))
    if len(x) == len(y) and np.count_nonzero(x != y) <= most:  # changed words alone
        return True
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[start:][::-1][: n - start] != y[start:][::-1][: n - start])
    tail = int(differ[0]) if len(differ) else n - start
    x, y = x[start : len(x) - tail], y[start : len(y) - tail]
    # an edit takes one word at most from what both have in common, and two pairs of neighbours
    n = max(len(x), len(y))
    if n > FEW and (n - in_common(x, y) > most or n - 1 - in_common(neighbours(x), neighbours(y)) > 2 * most):
        return False
    return edits_within(x.tolist(), y.tolist(), most) is not None


def links_within(texts: list[str], ends: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is alike in each of some groups of texts; a group ends where ``ends`` says."""
    words, lengths, fp = [], [], []
    for a, b in text_slices(texts):
        some = Words(texts[a:b])
        words.append(some.hashes)
        lengths.append(some.per_text())
        fp += prints_of(some.hashes, lengths[-1])
    flat, sizes = np.concatenate(words), np.concatenate(lengths)
    starts = np.cumsum(sizes) - sizes
    prints = Prints(pa.array(fp, pa.binary()), sizes, similarity)
    first, left = spread(ends)
    root, found = np.arange(len(texts)), []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        like = prints.may_be_like(a, b)
        for i, j in zip(a[like].tolist(), b[like].tolist()):
            # what has come into one part meanwhile needs no check
            if root[i] != root[j] and alike(flat[starts[i] : starts[i] + sizes[i]], flat[starts[j] : starts[j] + sizes[j]], similarity):
                join_roots(root, np.array([i]), np.array([j]), int(first[i]), int(j + left[j] + 1))
                found.append((i, j))

    # first with the first text of each group, then, where that leaves several parts, with the next ones in turn
    link(first[rest := np.flatnonzero(first != np.arange(len(texts)))], rest)
    apart = np.zeros(len(texts), bool)
    apart[first[rest[root[rest] != first[rest]]]] = True
    for a, b in later_pairs(np.flatnonzero(apart[first]), left, root):
        link(a, b)
    return found


def _link(similarity: float):
    """Rows ``g, lo, hi, v, s`` in their order to links that connect what is alike in each group, from the least of each part to all
    others: links in chains would take more rounds to connect."""

    def run(batches):
        for t in runs(batches, ["g", "lo", "hi", "v", "s"], 3):
            found = links_within(t.column("s").to_pylist(), group_ends(t, 3), similarity)
            if found:
                v, root = t.column("v").combine_chunks(), np.arange(len(t))
                join_roots(root, *np.array(found).T)
                members = np.flatnonzero(root != np.arange(len(t)))
                yield pa.RecordBatch.from_arrays([v.take(pa.array(x)) for x in (root[members], members)], names=["a", "b"])

    return run


def in_chunks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows(key, v, n, ...)`` with ``lo`` and ``hi``: groups of ``n`` rows beyond ``size`` are met by pairs of chunks."""
    chunks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("v"), chunks).cast("int")
    others = [c for c in rows.columns if c not in (key, "n")]
    dealt = rows.select(key, *others, own.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d"))
    return dealt.select(key, F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), *others)


def repeated(items: DataFrame, twice: DataFrame) -> DataFrame:
    """``key, v, w, fp, n`` for the keys of ``items(v, w, fp, keys)`` that are in ``twice(key, n)``."""
    if fits(twice, BROADCAST_KEYS):
        return items.select("v", "w", "fp", F.explode("keys").alias("key")).join(F.broadcast(twice), "key")
    # keys meet their counts without prints; an item, which has few keys, then gets back those that repeat, and its print moves once
    known = items.select("v", F.explode("keys").alias("key")).join(twice, "key")
    known = known.groupBy("v").agg(F.collect_list(F.struct("key", "n")).alias("found"))
    return items.select("v", "w", "fp").join(known, "v").select("v", "w", "fp", F.inline("found"))


def like_groups(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """``v, root`` of the items that have links; ``items(v, w, fp, keys)`` has each item once.

    ``texts_of`` gives ``v, s`` once for each ``v`` of the frame that it gets: the texts whose words the items are.
    """
    # hardly any key repeats, so none are summed before the shuffle
    twice = items.select(F.explode("keys").alias("key")).repartition("key").groupBy("key").agg(F.count("*").alias("n"))
    members = repeated(items, cut(twice.filter("n > 1")))
    group = ["key", "lo", "hi"]
    dealt = in_chunks(members, "key", CHUNK)
    parts = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_parts(similarity), "g binary, v binary")
    parts = cut(parts.dropDuplicates(["g", "v"]))
    sized = parts.join(parts.groupBy("g").agg(F.count("*").alias("n")), "g")
    texts = texts_of(parts.select("v").distinct())
    group = ["g", "lo", "hi"]
    ready = in_chunks(sized, "g", TEXTS).join(texts, "v").select(*group, "v", "s")
    ready = ready.repartition(*group).sortWithinPartitions(*group, "v")
    return connected_groups(ready.mapInArrow(_link(similarity), "a binary, b binary"))
