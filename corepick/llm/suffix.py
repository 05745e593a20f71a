"""Removal of repeated byte strings by suffix arrays, over a corpus that no single task could sort.

A string of ``length`` bytes that starts at two places has the same anchor in both: the least hash among its ``K``-byte
windows. Neighbouring strings with one anchor make up its segment. So repeated strings lie in the segments of anchors that
occur twice or more, and all places of a string meet where the segments of its anchor meet.

1. Each text gives its anchors: hash of the K bytes, and where its segment lies and the digest of that.
2. Anchors that occur once are dropped. Equal segments are one, with the number of their places.
3. The distinct segments of an anchor that has several are sent to one task by the anchor's hash. A task joins the
   segments of many anchors, sorts their suffixes in two stages, and takes adjacent common prefixes: suffixes smaller than
   their successor are sorted directly, the rest are induced by scans over the buckets of first bytes. Starts with a common
   prefix of ``length`` bytes or more are repeats.
4. Segments with several places are repeats as a whole. Repeated starts are brought back to all places of their segment,
   joined to ranges, and cut from the texts.

An anchor with more than ``HOT`` distinct segments would be one large sort: its segments are split by the digests of their
``length``-byte windows, which are counted by a shuffle instead.

Nulls: a null text is empty and a null id allowed; a document is a row, so equal rows repeat each other. Texts shorter
than ``length`` lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import cut, fits, table

LENGTH = 200
K = 32
#: Distinct segments of one anchor that a task sorts at most.
HOT = 4_000
#: Bytes that a task joins for one suffix array.
BYTES_AT_ONCE = 1 << 20
#: Never part of UTF-8; separates segments.
SEPARATOR = 0xFF
BROADCAST_ROWS = 500_000
BROADCAST_ANCHORS = 2_000_000


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all ``k``-byte windows, by doubling; wraps around."""
    out, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    powers = {1: base}
    acc, done, rest = None, 0, k
    while rest:
        if rest & 1:
            if acc is None:
                acc, done = out, width
            else:
                n = len(acc) - width
                acc = acc[:n] * powers[width] + out[done : done + n] if n > 0 else acc[:0]
                done += width
        rest >>= 1
        if rest:
            n = len(out) - width
            out = out[:n] * powers[width] + out[width : width + n] if n > 0 else out[:0]
            with np.errstate(over="ignore"):
                powers[2 * width] = powers[width] * powers[width]
            width *= 2
    acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return acc ^ (acc >> np.uint64(32))


#: Bytes of which the anchors are found at once; neighbouring runs overlap by a string.
RUN = 1 << 23


def anchors_of(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, start and stop of each anchor of a text.

    The anchor of a string is its K-byte window of least hash, the rightmost of equal ones. Strings at neighbouring places
    that share an anchor make up its segment, ``start`` to ``stop``: every string lies in the segment of its own anchor alone.
    """
    parts = [_anchors_of_run(data[at : at + RUN + length - 1], at, length, k) for at in range(0, max(1, len(data) - length + 1), RUN)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors_of_run(data: bytes, at: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < length:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    h = rolling_hashes(np.frombuffer(data, np.uint8), k)
    window, n = length - k + 1, len(h)
    low = np.uint64(0xFFFFFF)
    # ties go to the right; a place takes the lower 24 bits
    value = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    # least value of each window, from prefix and suffix minima over blocks of one window
    padded = np.full(-(-n // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = (low - (least[first] & low)).astype(np.int64)
    last = np.append(first[1:], len(least)) - 1
    return h[place], place + at, first + at, last + length + at


# ---------------------------------------------------------------------------------------------------- two-stage sorting


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``data`` (bytes, the last one being SEPARATOR), in the order of at least ``depth`` bytes.

    Suffixes smaller than their successor (type B) are sorted directly; each other one (type A) is placed behind those
    that its bucket has so far when the scan meets its successor, since it is larger than that and has a byte in front.
    """
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    # the first differing neighbour decides for the whole run of equal bytes before it
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)] if len(change) else np.zeros(n, np.int64)
    beyond = np.arange(n) > (change[-1] if len(change) else -1)
    type_b = np.where(beyond, False, data[np.minimum(run_end + 1, n - 1)] > data[run_end])
    b = np.flatnonzero(type_b)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)[b]
    b = b[np.argsort(np.ascontiguousarray(windows).view(f"S{depth}").ravel(), kind="stable")]
    counts = np.bincount(data, minlength=256)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.full(n, -1, np.int64)
    # type B suffixes stand at the end of their bucket
    first = data[b]
    of_b = np.bincount(first, minlength=256)
    tails = heads + counts
    begin_b = np.concatenate([[0], np.cumsum(of_b)[:-1]])
    for c in np.flatnonzero(of_b).tolist():
        out[tails[c] - of_b[c] : tails[c]] = b[begin_b[c] : begin_b[c] + of_b[c]]
    fill = heads.copy()

    def induce(entries: np.ndarray) -> None:
        """Put the type A suffixes just before ``entries`` behind their buckets' heads, in the order of the entries."""
        before = entries[entries > 0] - 1
        before = before[~type_b[before]]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        sizes = np.bincount(byte, minlength=256)
        at = np.repeat(fill - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(before))
        out[at] = before
        fill[:] += sizes

    # the very last suffix has no successor and is the head of its bucket
    out[fill[data[-1]]] = n - 1
    fill[data[-1]] += 1
    for c in np.flatnonzero(counts).tolist():
        done = heads[c]
        while done < fill[c]:  # suffixes that begin with a run of c come from within the bucket
            start, done = done, fill[c]
            induce(out[start:done])
        induce(out[tails[c] - of_b[c] : tails[c]])
    return out


def common_prefix_at_least(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have ``length`` bytes in common; the pairs still equal go on by eight bytes."""
    out = np.zeros(len(a), bool)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    left = np.arange(len(a))
    for at in range(0, length, 8):
        step = min(8, length - at)
        same = (words[a[left] + at, :step] == words[b[left] + at, :step]).all(1)
        left = left[same]
        if not len(left):
            break
    out[left] = True
    return out


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the starts of ``length``-byte strings that also start elsewhere in any of them."""
    lengths = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    firsts = np.cumsum(lengths + 1) - lengths - 1
    order = suffix_array(data, length)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    room = (firsts + lengths)[owner[order]] - order >= length
    order = order[room]
    twice = common_prefix_at_least(data, order[:-1], order[1:], length)
    starts = np.sort(order[np.concatenate([twice, [False]]) | np.concatenate([[False], twice])]) if len(order) else order
    cuts = np.searchsorted(starts, [*firsts, len(data)])
    return [starts[i:j] - f for i, j, f in zip(cuts[:-1], cuts[1:], firsts)]


# -------------------------------------------------------------------------------------------------------------- on Spark


def _ranges(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of runs of consecutive starts."""
    if len(starts):
        gaps = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[[0, *(gaps + 1)]].tolist(), starts[[*gaps, len(starts) - 1]].tolist())


SKETCH = "t1 long, t2 long, h array<long>, start array<int>, stop array<int>, s1 array<long>, s2 array<long>"


def _find_anchors(batches):
    """``t1, t2, text`` to the anchors of each text, each with the digest of its segment in two halves."""
    for batch in batches:
        ends, columns, digests = [0], ([], [], []), []
        for text in batch.column("text"):
            data = text.as_py().encode()
            h, at, starts, stops = anchors_of(data)
            lead = (at - starts).astype(">u2").tobytes()
            digests += [hashlib.blake2b(data[a:b] + lead[2 * i : 2 * i + 2], digest_size=16).digest() for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist()))]
            ends.append(ends[-1] + len(h))
            for c, v in zip(columns, (h.view(np.int64), starts, stops)):
                c.append(v)
        flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        typed = [(flat[0], pa.int64()), (flat[1], pa.int32()), (flat[2], pa.int32()), (halves[:, 0], pa.int64()), (halves[:, 1], pa.int64())]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(v), t)) for v, t in typed]
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), *lists], names=["t1", "t2", "h", "start", "stop", "s1", "s2"])


CUTOUT = "h long, s1 long, s2 long, data binary"


def _cut_segments(batches):
    """``text, wanted array<struct<h, s1, s2, start, stop>>`` to one row per wanted segment with its bytes."""
    for batch in batches:
        out = ([], [], [], [])
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            raw = text.as_py().encode()
            for w in wanted.as_py():
                for c, v in zip(out, (w["h"], w["s1"], w["s2"], raw[w["start"] : w["stop"]])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["h", "s1", "s2", "data"])


RANGES = "h long, s1 long, s2 long, lo int, hi int"


def _sort_suffixes(batches):
    """Segments in the order of ``h, s1, s2`` to ranges of repeated starts. All segments of an anchor are sorted together."""

    def solve(keys, data):
        out = ([], [], [], [], [])
        for key, starts in zip(keys, repeated_starts(data)):
            for run in _ranges(starts):
                for c, v in zip(out, (*key, *run)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "s1", "s2", "lo", "hi"])

    keys, data, size, last = [], [], 0, None
    for batch in batches:
        for *key, d in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "data"))):
            if key == last:  # the same segment from an equal text
                continue
            if size > BYTES_AT_ONCE and key[0] != last[0]:
                yield solve(keys, data)
                keys, data, size = [], [], 0
            last = key
            keys.append(key)
            data.append(d)
            size += len(d)
    if keys:
        yield solve(keys, data)


def _windows(batches):
    """Segments to one row per ``LENGTH``-byte window: its digest in two halves and its start."""
    for batch in batches:
        keys, digests, starts = [], [], []
        for *key, d in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "data"))):
            for i in range(len(d) - LENGTH + 1):
                keys.append(key)
                digests.append(hashlib.blake2b(d[i : i + LENGTH], digest_size=16).digest())
                starts.append(i)
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        owners = np.array(keys, np.int64).reshape(-1, 3)
        columns = [*(pa.array(np.ascontiguousarray(x)) for x in (*owners.T, *halves.T)), pa.array(starts, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "s1", "s2", "w1", "w2", "lo"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if fits(df, rows) else df


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the identity of the text in two halves (``t1, t2``) and the text, null as empty, as ``text``."""
    full = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(full), "t2": F.xxhash64(F.lit(1), full), "text": full})


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """``t1, t2, lo, hi`` for ``texts(t1, t2, text)``: runs of places whose strings of LENGTH bytes also start elsewhere."""
    sketch = cut(texts.select("t1", "t2", "text").mapInArrow(_find_anchors, SKETCH))
    twice = cut(sketch.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    each = sketch.select("t1", "t2", F.explode(F.arrays_zip("h", "start", "stop", "s1", "s2")).alias("a")).select("t1", "t2", "a.*")
    places = each.join(_small(twice, BROADCAST_ANCHORS), "h", "left_semi")
    first = [F.first(c).alias(c) for c in ("t1", "t2", "start", "stop")]
    segments = cut(places.groupBy("h", "s1", "s2").agg(F.count("*").alias("places"), *first))
    several = segments.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = cut(segments.join(several, "h").select("h", "s1", "s2", "t1", "t2", "start", "stop", "kinds"))
    # the whole of a segment with several places is repeated
    ranges = segments.filter("places > 1").select("h", "s1", "s2", F.lit(0).alias("lo"), (F.col("stop") - F.col("start") - LENGTH).alias("hi"))
    wanted = several.groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "s1", "s2", "start", "stop")).alias("wanted"))
    needed = texts.join(_small(several.select("t1", "t2").distinct(), BROADCAST_ROWS), ["t1", "t2"], "left_semi")
    cutouts = needed.join(wanted, ["t1", "t2"]).mapInArrow(_cut_segments, CUTOUT)
    hot = cut(several.filter(F.col("kinds") > HOT).select("h").distinct())
    if not hot.isEmpty():
        cutouts = cut(cutouts)
        hot = _small(hot, BROADCAST_ROWS)
        split = cutouts.join(hot, "h", "left_semi").dropDuplicates(["h", "s1", "s2"]).mapInArrow(_windows, "h long, s1 long, s2 long, w1 long, w2 long, lo int")
        again = split.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
        ranges = ranges.union(split.join(again, ["w1", "w2"]).select("h", "s1", "s2", "lo", F.col("lo").alias("hi")))
        cutouts = cutouts.join(hot, "h", "left_anti")
    dealt = cutouts.repartition("h").sortWithinPartitions("h", "s1", "s2")
    ranges = cut(ranges.union(dealt.mapInArrow(_sort_suffixes, RANGES)))
    return places.join(ranges, ["h", "s1", "s2"]).select("t1", "t2", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))


def _cut_text(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The bytes left of each text and the removed spans, from the runs of repeated starts."""
    kept, spans = [], []
    for text, run in zip(texts, runs):
        raw, own = text.as_py().encode(), []
        for lo, hi in sorted((r["lo"], r["hi"]) for r in run.as_py() or ()):
            if own and lo <= own[-1][1]:
                own[-1][1] = max(own[-1][1], hi + LENGTH)
            else:
                own.append([lo, hi + LENGTH])
        edges = [0, *(x for s in own for x in s), len(raw)]
        kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        spans.append([{"start": a, "stop": b} for a, b in own])
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "stop": pa.int32()})))], ["kept", "spans"])


def remove_repeats(docs: DataFrame, text: str = "text", kept: str = "kept_bytes", spans: str = "removed_spans") -> DataFrame:
    """``docs`` with what is left of ``text`` (bytes) and the maximal removed runs ``array<struct<start, stop>>`` (in bytes).

    A text of at least LENGTH bytes that several rows hold is removed whole; for such texts no ranges are gathered.
    """
    others = [c for c in docs.columns if c != text]
    # the text is moved once: beside it go the other columns and whether it was null
    work = docs.select(F.struct(F.col(text).isNull().alias("none_"), *others).alias("row"), F.col(text).alias("own"))
    work = keyed(work, "own").drop("own")
    ranges = repeated_ranges(work)
    copied = work.groupBy("t1", "t2").agg(F.count("*").alias("n")).filter("n > 1").select("t1", "t2", F.lit(True).alias("copied"))
    copied = cut(copied)
    single = ranges.join(_small(copied, BROADCAST_ROWS), ["t1", "t2"], "left_anti")
    runs = cut(single.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))
    own = F.array(F.struct(F.lit(0).alias("lo"), (F.octet_length("text") - LENGTH).alias("hi")))
    whole = F.when(F.col("copied") & (F.octet_length("text") >= LENGTH), own)
    work = work.join(_small(copied, BROADCAST_ROWS), ["t1", "t2"], "left")
    touched = runs.select("t1", "t2")
    if fits(touched, BROADCAST_ROWS):  # then only texts that lose something are shuffled
        touched = F.broadcast(touched)
        joined = work.join(touched, ["t1", "t2"], "left_semi").join(runs, ["t1", "t2"])
        rest = work.join(touched, ["t1", "t2"], "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
        joined = joined.unionByName(rest)
    else:
        joined = work.join(runs, ["t1", "t2"], "left")
    udf = F.arrow_udf(_cut_text, "kept binary, spans array<struct<start:int,stop:int>>")
    out = joined.select("row", "text", udf("text", F.coalesce(whole, "runs")).alias("x"))
    same = F.when(~F.col("row.none_"), F.col("text"))
    columns = [same.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in (kept, spans)]
    return out.select(*columns, F.col("x.kept").alias(kept), F.col("x.spans").alias(spans))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
