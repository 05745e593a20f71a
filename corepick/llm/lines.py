"""Removal of lines that repeat, exactly or nearly, anywhere in the corpus.

A line is normalised to its lower-case words; every line with a word takes part. Equal normalised lines (by 128 bits) are one
vertex. A link needs at most ``1 - similarity`` edits (of words) per word of the longer line. One occurrence of each connected
group stays: that of the least document id (nulls last), then the least text hash, then the first line.

Candidates do not come from a SimHash: one word in five moves ten to twelve of 64 bits in an ordinary line, which no blocks of
bits can find. Their keys are words instead. Words are put in an order, rare ones first (by their number in all documents; any
order finds the same pairs). Lines of at most ``SHORT`` words meet on each two of their first words in this order, of which so few edits leave two
equal ones at least: none of their links is left out. Longer lines meet on their ``TRIPLES`` triples of neighbours of least
hash, of which edits leave some with a chance of more than 99 % at the limit (the tests measure it; the rarest would not do,
since what tells the copies of a line apart is rare). Triples of common words alone come after all others, as half of the
corpus shares them. Lines that may be like one of the other kind have keys of both.

Items of a bucket are compared by their prints, and aligned, in :mod:`corepick.llm.buckets`.

Nulls: a null text has no lines and stays null. Rows equal in id and text are judged as one row and keep the same lines.
Lines without a word stay. Extra columns stay, whatever their names. An empty table gives no rows. Very long texts are worked
on whole, in slices that end with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.buckets import edits_allowed, like_groups, prints_of
from corepick.llm.common import cut, fits, small_batches, table
from corepick.llm.words import Words, mix, power_at, slices

SIMILARITY = 0.8
#: Words of the lines that meet on each two of their first words.
SHORT = 16
#: Keys of longer lines.
TRIPLES = 10
#: Share of all words from which on a word is common.
COMMON = 0.0005
#: Bits of a word's hash that choose its place in the table of ranks; words that share a place are counted together and share a rank.
RANK_BITS = 20
#: Ranks by which twice as many words differ: up to 2^32 words have a rank below 2^15.
OCTAVE = 1024
#: Bits of a word's value below its rank.
VALUE_BITS = np.uint64(48)
#: The highest bit of a value tells common words.
IS_COMMON = np.uint64(1 << 63)
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
WORDS_AT_ONCE = 1 << 19


@lru_cache(1 << 16)
def unequal(words: int, similarity: float) -> int:
    """Most of a line's words that need not be in a like line of the same or a greater length."""
    most, longer = 0, words
    while longer - edits_allowed(longer, similarity) <= words:
        most = max(most, edits_allowed(longer, similarity) - (longer - words))
        longer += 1
    return most


@lru_cache(1 << 16)
def has_like(words: int, similarity: float) -> bool:
    """Whether other lines than equal ones can be like a line of so many words."""
    longer = words
    while longer - edits_allowed(longer, similarity) <= words:
        if edits_allowed(longer, similarity):
            return True
        longer += 1
    return False


def first_of(values: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` least values of each row, as hashes that tell repeated ones apart."""
    if n < values.shape[1]:
        values = np.partition(values, n - 1, axis=1)[:, :n]
    values = np.sort(values, axis=1)
    again = values[:, 1:] == values[:, :-1]
    if len(some := np.flatnonzero(again.any(axis=1))):  # few rows have repeated values
        place = np.arange(values.shape[1], dtype=np.uint64)
        new = np.ones((len(some), len(place)), bool)
        new[:, 1:] = ~again[some]
        values[some] += (place - np.maximum.accumulate(np.where(new, place, np.uint64(0)), axis=1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(values)


def keys_of(values: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of lines of one length, a row each, given by the values of their words."""
    words = values.shape[1]
    if not has_like(words, similarity):
        return np.empty((len(values), 0), np.uint64)
    keys = []
    if words <= SHORT:
        first = first_of(values, unequal(words, similarity) + 2)
        i, j = np.triu_indices(first.shape[1], 1)
        keys.append(mix(first[:, i] * np.uint64(31) + first[:, j]))
    if words >= SHORT + 1 - edits_allowed(SHORT + 1, similarity):
        both = mix(values[:, :-1] * np.uint64(31) + values[:, 1:])
        three = mix(both[:, :-1] * np.uint64(37) + values[:, 2:])
        common = values[:, :-2] & values[:, 1:-1] & values[:, 2:] & IS_COMMON
        keys.append(first_of((three & ~IS_COMMON) | common, TRIPLES))
    return np.concatenate(keys, axis=1)


def line_keys(values: np.ndarray, lengths: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All keys of lines, given by the values of all their words and how many each has; and how many keys each has."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    counts, parts = np.zeros(len(lengths), np.int64), []
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        keys = keys_of(values[starts[at][:, None] + np.arange(lengths[at[0]])], similarity)
        counts[at] = keys.shape[1]
        parts.append((at, keys))
    out, ends = np.empty(int(counts.sum()), np.uint64), np.cumsum(counts)
    for at, keys in parts:
        out[(ends - counts)[at][:, None] + np.arange(keys.shape[1])] = keys
    return out, counts


def identities(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """128 bits of each line as two numbers, given by the hashes of all words and how many each line has."""
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(hashes)) - np.repeat(starts, lengths)
    power = power_at(place)
    return np.stack([mix(np.add.reduceat(mix(hashes + np.uint64(seed)) * power, starts) + lengths.astype(np.uint64)) for seed in (1, 2)], axis=1)


def _binary(ids: list[np.ndarray]) -> pa.Array:
    data = np.concatenate([np.empty((0, 2), np.uint64), *ids]).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(data) // 16, [None, pa.py_buffer(np.arange(0, len(data) + 1, 16, dtype=np.int32)), pa.py_buffer(data)])


def _lines_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: number of texts, how many lines with words each has, the lines' numbers and lengths, the words' hashes."""
    strings = [t or "" for t in texts.to_pylist()]
    for a, b in slices(strings):
        words = Words(strings[a:b])
        text, number, lengths = words.lines()
        yield b - a, np.bincount(text, minlength=b - a), number, lengths, words.hashes


def _name_lines(texts: pa.Array) -> pa.Array:
    """Per text the lines with words: number and identity of the normalised line."""
    counts, numbers, ids = [np.zeros(1, np.int64)], [np.empty(0, np.int64)], []
    for _, each, number, lengths, hashes in _lines_of(texts):
        counts.append(each)
        numbers.append(number)
        if len(lengths):
            ids.append(identities(hashes, lengths))
    ends = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.concatenate(numbers).astype(np.int32)), _binary(ids)], ["line", "v"]))


def _sketch_lines(ranks, similarity: float):
    """Per text the lines with words: number, identity of the normalised line, how many words, print, keys."""

    def run(texts: pa.Array) -> pa.Array:
        table_ = ranks.value
        counts, numbers, sizes, ids, prints, keys, key_counts = [np.zeros(1, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], [], [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            hashes, lengths = (np.concatenate(x) for x in zip(*held))
            values = (table_[hashes >> np.uint64(64 - RANK_BITS)].astype(np.uint64) << VALUE_BITS) | (hashes & ((np.uint64(1) << VALUE_BITS) - np.uint64(1)))
            flat, each = line_keys(values, lengths, similarity)
            keys.append(flat)
            key_counts.append(each)
            held.clear()

        for _, each, number, lengths, hashes in _lines_of(texts):
            counts.append(each)
            numbers.append(number)
            sizes.append(lengths)
            if len(lengths):
                ids.append(identities(hashes, lengths))
                prints += prints_of(hashes, lengths)
                held.append((hashes, lengths))
                if sum(len(h) for h, _ in held) > WORDS_AT_ONCE:
                    flush()
        if held:
            flush()
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(key_counts)).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
        columns = [pa.array(np.concatenate(numbers).astype(np.int32)), _binary(ids), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(prints, pa.binary()), listed]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["line", "v", "w", "fp", "keys"]))

    return run


def _count_words(batches):
    """How many words of all texts each place of the table of ranks has: ``at, n``, once a task."""
    total, held = np.zeros(1 << RANK_BITS, np.int64), [np.empty(0, np.uint64)]

    def flush():
        total[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - RANK_BITS)).astype(np.int64), minlength=len(total))
        held.clear()

    for batch in batches:
        strings = [t or "" for t in batch.column(0).to_pylist()]
        for a, b in slices(strings):
            held.append(Words(strings[a:b]).hashes)
            if sum(map(len, held)) > WORDS_AT_ONCE:
                flush()
    if held:
        flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])


def word_ranks(docs: DataFrame) -> np.ndarray:
    """The ranks of all words of ``docs(text)``, 15 bits that grow with how often a word occurs, at the places that their hashes
    choose; the 16th bit tells common words. The driver gets one number for each place."""
    found = docs.select("text").mapInArrow(_count_words, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    out = np.zeros(1 << RANK_BITS, np.uint16)
    out[at] = np.minimum(OCTAVE * np.log2(n), (1 << 15) - 1).astype(np.uint16) | (n > COMMON * n.sum()).astype(np.uint16) << 15
    return out


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if fits(df, rows) else df


def _texts_of(lines: DataFrame, docs: DataFrame):
    """The texts of some of ``lines(v, one)``, each from the document and line that ``one`` names."""

    def find(ends: DataFrame) -> DataFrame:
        wanted = lines.join(_small(ends, BROADCAST_ROWS), "v", "left_semi").select("v", "one.k", "one.t", "one.line")
        wanted = wanted.groupBy("k", "t").agg(F.collect_list(F.struct("v", "line")).alias("wanted")).withColumnsRenamed({"k": "k2", "t": "t2"})
        found = docs.join(_bounded(wanted, "wanted", 40), F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")))
        found = found.select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w")).select("w.v", F.get("all", F.col("w.line")).alias("s"))
        return found.groupBy("v").agg(F.min("s").alias("s"))

    return find


def _bounded(df: DataFrame, array: str, size: int) -> DataFrame:
    """``df`` to be broadcast if its arrays, of elements of ``size`` bytes, and rows take at most ``BROADCAST_BYTES``."""
    df = cut(df)
    total = df.agg(F.sum(F.size(array) * size + 100)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def without(text: Column, goes: Column) -> Column:
    """``text`` without the lines of the numbers ``goes``."""
    stays = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), goes), lambda i: F.get(lines, i))
    # a transform of one element names the lines, so that they are split once
    return F.array_join(F.get(F.transform(F.array(F.split(text, "\n")), stays), 0), "\n")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with all but one line of each group taken out of ``text``; ``removed``: name for the numbers of these lines."""
    small_batches(docs.sparkSession)
    full = F.coalesce(F.col(text), F.lit(""))
    fields = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in (text, removed)}
    # the text is moved once: beside it go the other columns and whether it was null
    row = F.struct(F.col(text).isNull().alias("none"), *(F.col(f"`{c}`").alias(f) for c, f in fields.items()))
    work = docs.select(row.alias("row"), F.col(key).alias("k"), full.alias("text"), F.xxhash64(full).alias("t"))
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(work))
    udf = F.arrow_udf(_sketch_lines(ranks, similarity), "array<struct<line:int,v:binary,w:int,fp:binary,keys:array<bigint>>>")
    each = work.select("k", "t", F.explode(udf("text")).alias("x")).select("k", "t", "x.*")
    order = F.struct(F.col("k").isNull().alias("none"), "k", "t", "line")
    lines = cut(each.groupBy("v").agg(F.first("w").alias("w"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n"), F.min(order).alias("one")))
    groups = like_groups(lines.select("v", "w", "fp", "keys"), _texts_of(lines, work), similarity)
    rooted = lines.select("v", "n", "one").join(groups, "v", "left")
    rooted = rooted.filter("n > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "v"))
    stays = rooted.groupBy("root").agg(F.min("one").alias("stays"))
    stays = cut(rooted.select("v", "root").join(stays, "root").select("v", "stays"))
    # naming the lines again takes less than keeping all of them
    named = work.select("k", "t", F.explode(F.arrow_udf(_name_lines, "array<struct<line:int,v:binary>>")("text")).alias("x")).select("k", "t", "x.*")
    goes = named.join(_small(stays, BROADCAST_ROWS), "v").filter(order != F.col("stays"))
    goes = _bounded(goes.groupBy(F.col("k").alias("k2"), F.col("t").alias("t2")).agg(F.collect_set("line").alias("goes")), "goes", 4)
    joined = work.join(goes, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    new = F.when(F.col("goes").isNotNull(), without(F.col("text"), F.col("goes"))).when(~F.col("row.none"), F.col("text"))
    columns = [new.alias(c) if c == text else F.col(f"row.{fields[c]}").alias(c) for c in docs.columns if c != removed]
    more = [F.coalesce(F.array_sort("goes"), F.array().cast("array<int>")).alias(removed)] if removed else []
    return joined.select(*columns, *more)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    out = dedup_lines(docs, removed="removed")
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
