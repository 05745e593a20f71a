"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is the sequence of its words; its k-mers are windows of ``K`` words, each labelled with how many times it occurred
before. The labelled k-mers are dealt by hash into ``KEYS`` samples, of each of which the ``PICKS`` of least hash are taken and
kept in text order; their sequence is one key, so two texts share a key if they hold the same k-mers in the same order. A
sample without a k-mer has no key. Few 5-word k-mers of a short text outlive its edits, so texts of up to ``SHORT`` words have
keys of single labelled words: for each of ``SHORT_KEYS`` hash functions the ``SHORT_PICKS`` words of least hash, in text order.
Texts of ``LONG`` to ``SHORT`` words have keys of both kinds, so that two texts that may be alike have one kind in common. A link
needs at most ``1 - similarity`` edits (words put in, taken out or changed) per word of the longer text; the tests measure how
many pairs at that limit share a key, by length.

Equal texts are one vertex, and groups are the connected parts of the links. Items of a bucket are compared by their prints,
and aligned within a band, in :mod:`corepick.llm.buckets`.

Nulls: a null text counts as an empty one, and empty texts are equal texts. A null id is allowed; the class id is the least id of the group, null if all are null. Repeated rows are documents of their
own in :func:`near_classes`; :func:`keep_one` keeps one. Extra columns stay in ``keep_one``, whatever their names, and are
ignored otherwise. An empty table gives no rows. Very long texts are worked on whole, in slices that end with a text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.buckets import like_groups, prints_of
from corepick.llm.common import cut, fits, small_batches, table, text_id
from corepick.llm.words import Words, mix, slices

K = 5
PICKS = 2
KEYS = 96
SIMILARITY = 0.8
#: Texts of up to SHORT words have keys of single words, those of LONG words and more keys of k-mers.
SHORT, LONG = 25, 20
SHORT_PICKS = 4
SHORT_KEYS = 48
BROADCAST_IDS = 500_000

words_of = re.compile(r"\w+").findall


def labelled_kmers(flat: np.ndarray, lengths: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of texts in text order, given by the hashes of all words and how many each text has, at
    least one; and the text that each is in."""
    kmers = np.maximum(1, lengths - k + 1)
    owner = np.repeat(np.arange(len(lengths)), kmers)
    place = np.arange(int(kmers.sum())) - np.repeat(np.cumsum(kmers) - kmers, kmers)
    first, end = (np.cumsum(lengths) - lengths)[owner] + place, np.cumsum(lengths)[owner]
    gram = np.zeros(len(place), np.uint64)
    for j in range(k):
        at = first + j
        gram = mix(gram + np.where(at < end, flat[np.minimum(at, len(flat) - 1)], np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    # the label is the number of the occurrence within its text, in text order; few occur again, so only those are put in it
    own = mix(gram ^ mix(owner.astype(np.uint64)))
    order = np.argsort(own)
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    if len(again := np.flatnonzero(~(new & np.append(new[1:], True)))):
        some = order[again]
        order[again] = some[np.lexsort((some, own[some]))]
    label = np.empty(len(order), np.uint64)
    label[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return mix(gram + label * np.uint64(0xD6E8FEB86659FD93)), owner


def sketch(flat: np.ndarray, lengths: np.ndarray, k: int = K, picks: int = PICKS, keys: int = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The keys of texts, given by the hashes of all words and how many each text has, at least one; and how many each has."""
    gram, owner = labelled_kmers(flat, lengths, k)
    sample = owner * keys + (mix(gram + np.uint64(1)) % np.uint64(keys)).astype(np.int64)
    # by sample, then by hash, as far as both go into one number
    high = np.uint64(int(sample.max()).bit_length())
    both = (sample.astype(np.uint64) << (np.uint64(64) - high) if high else np.zeros(len(gram), np.uint64)) | gram >> high
    order = np.argsort(both)
    if (both[order][1:] == both[order][:-1]).any():
        order = np.lexsort((gram, sample))
    start = np.flatnonzero(np.concatenate([[True], sample[order][1:] != sample[order][:-1]]))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    chosen = np.sort(order[rank < picks])  # in text order
    chosen = chosen[np.argsort(sample[chosen], kind="stable")]
    of = sample[chosen]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    many = np.diff(np.append(start, len(of)))
    key = (of[start] % keys).astype(np.uint64)
    for p in range(picks):
        has = many > p
        key[has] = mix(key[has] * np.uint64(31) + gram[chosen[start[has] + p]])
    return key, np.bincount(of[start] // keys, minlength=len(lengths))


def short_sketch(flat: np.ndarray, lengths: np.ndarray, picks: int = SHORT_PICKS, keys: int = SHORT_KEYS) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of single words of texts, given as for :func:`sketch`; texts of fewer words than a key holds have one of all."""
    gram, owner = labelled_kmers(flat, lengths, 1)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(gram)) - start
    made = []
    for number in range(keys):
        order = np.lexsort((mix(gram ^ mix(np.full(len(gram), number + 1, np.uint64))), owner))
        chosen = np.sort(order[place < picks])  # the order has each text where it stood
        of, rank = owner[chosen], np.arange(len(chosen))
        rank -= np.maximum.accumulate(np.where(np.concatenate([[True], of[1:] != of[:-1]]), rank, 0))
        key = np.full(len(lengths), ~np.uint64(0))  # not where the keys of k-mers begin
        for p in range(picks):
            at = rank == p
            key[of[at]] = mix(key[of[at]] * np.uint64(31) + gram[chosen[at]])
        made.append(key)
    each = np.sort(np.stack(made, axis=1), axis=1)
    new = np.ones(each.shape, bool)
    new[:, 1:] = each[:, 1:] != each[:, :-1]
    return each[new], new.sum(axis=1)


def keys_of(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of texts of both kinds, given by the hashes of all words and how many each text has, at least one; and how many each has."""
    parts, owners = [], []
    for some, make in ((lengths >= LONG, sketch), (lengths <= SHORT, short_sketch)):
        if some.any():
            key, counts = make(flat[np.repeat(some, lengths)], lengths[some])
            parts.append(key)
            owners.append(np.repeat(np.flatnonzero(some), counts))
    owner = np.concatenate(owners)
    return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


def _sketch_batch(texts: pa.Array) -> pa.Array:
    strings = [t or "" for t in texts.to_pylist()]
    sizes, prints, keys, counts = [np.empty(0, np.int64)], [], [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(strings):
        words = Words(strings[a:b])
        lengths = words.per_text()
        sizes.append(lengths)
        prints += prints_of(words.hashes, lengths)
        each, has = np.zeros(b - a, np.int64), lengths > 0
        if has.any():
            flat, each[has] = keys_of(words.hashes, lengths[has])
            keys.append(flat)
        counts.append(each)
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(prints, pa.binary()), listed], ["w", "fp", "keys"])


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """For ``docs(tid, text)``: ``tid, root`` of the text ids that have links."""
    small_batches(docs.sparkSession)
    udf = F.arrow_udf(_sketch_batch, "w int, fp binary, keys array<bigint>")
    texts = cut(docs.select("tid", udf("text").alias("s")).groupBy("tid").agg(F.first("s").alias("s")).select(F.col("tid").alias("v"), "s.*"))

    def texts_of(ends: DataFrame) -> DataFrame:
        side = F.broadcast(ends) if fits(ends, BROADCAST_IDS) else ends
        return docs.join(side.withColumnRenamed("v", "tid"), "tid", "left_semi").groupBy(F.col("tid").alias("v")).agg(F.min("text").alias("s"))

    return like_groups(texts, texts_of, similarity).withColumnRenamed("v", "tid")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``key, class_id, class_size``; ``class_id`` is the least key of the group."""
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tid", text_id(F.col("text")))
    groups = near_groups(docs, similarity)
    # sums by text id first: a text with many copies is one row in all that follows
    counted = docs.groupBy("tid").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rooted = cut(counted.join(groups, "tid", "left").withColumn("root", F.coalesce("root", "tid")))
    classes = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    named = cut(rooted.select("tid", "root").join(classes, "root").select("tid", "class_id", "class_size"))
    named = F.broadcast(named) if fits(named, BROADCAST_IDS) else named
    return docs.select("id", "tid").join(named, "tid").select(F.col("id").alias(key), "class_id", "class_size")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: that of the least key (a null one last), then the least text id."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    work = docs.select(row.alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tid", text_id(F.col("text")))
    groups = near_groups(work.select("tid", "text"), similarity)
    counted = work.groupBy("tid", "id").agg(F.count("*").alias("n")).groupBy("tid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("one"))
    rooted = counted.join(groups, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    best = rooted.groupBy("root").agg(F.min(F.struct("one.none", "one.id", "tid", "one.n")).alias("x"))
    best = cut(best.select(F.col("x.id").alias("id2"), F.col("x.tid").alias("tid2"), "x.n"))
    side = F.broadcast(best) if fits(best, BROADCAST_IDS) else best
    kept = work.join(side, (F.col("tid") == F.col("tid2")) & F.col("id").eqNullSafe(F.col("id2")))
    if not best.filter("n > 1").isEmpty():  # of rows equal in text and id one stays
        kept = kept.filter("n = 1").union(kept.filter("n > 1").dropDuplicates(["tid"]))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
