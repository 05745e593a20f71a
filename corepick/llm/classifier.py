"""Quality classification by the labels of the nearest texts in a latent semantic space.

A text's terms are its character 3-grams, hashed into ``TERMS`` counts over the whole text; a count weighs ``log(1 + n)``
times the term's rarity. The share of words that repeat the word before them is one more coordinate, ``ECHO`` times as heavy
as all terms together, as no 3-gram shows it. The leading ``RANK`` right singular vectors of the labelled texts' weights span the latent space.
The labelled texts' unit vectors there are broadcast, the cosines of every text with all of them are computed exactly, block
by block, and the ``NEIGHBOURS`` nearest vote, each with its label weighted by its cosine (a negative one counts nothing).

What is learned comes from at most ``SAMPLE`` labelled ids, the first in hash order, whose terms the driver takes (some 4 kB
a text) to find the latent space; every text is scored against all of them. Neither grows with the table.

Nulls: a null text is an empty one; empty texts have no terms and get the mean label, as do texts that are like no labelled
one. Null labels and ids teach nothing; without any label all scores are 0.5. An id labelled more than once has the mean of
its labels; of several rows of one id the least text teaches. Of equally near texts (to 6 digits) the one first in hash order
votes first. Very long texts are counted in pieces of ``CHARS`` characters that overlap, so no 3-gram is lost;
words are told apart in each piece. Repeated rows are
scored each, other columns are kept whatever their names, one of the name of the score is replaced. Empty tables give no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import table
from corepick.llm.langid import fold

TERM_BITS = 12
TERMS = 1 << TERM_BITS
#: Two columns of the counts stand behind the terms: words that repeat the one before, and words that have one before.
COLUMNS = TERMS + 2
ECHO = 2.0
RANK = 64
#: Labelled ids that teach at most; with RANK it bounds what is broadcast (2 MB of vectors and 2 MB for the space).
SAMPLE = 4096
NEIGHBOURS = 15
#: Texts whose counts are in memory at once, and characters counted at once.
ROWS, CHARS = 256, 1 << 18
THRESHOLD = 0.3


def _count(pieces: list[tuple[int, str]], out: np.ndarray) -> None:
    points = np.frombuffer("".join(t for _, t in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = [len(t) for _, t in pieces]
    piece = np.repeat(np.arange(len(pieces)), lengths)
    h = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inside = piece[:-2] == piece[2:]
    at = (piece[:-2] * TERMS + (h >> np.uint32(32 - TERM_BITS)))[inside]
    counts = np.bincount(at, minlength=len(pieces) * TERMS).reshape(len(pieces), TERMS)
    np.add.at(out[:, :TERMS], [i for i, _ in pieces], counts)
    for i, t in pieces:
        words = t.split()
        out[i, TERMS:] += sum(map(operator.eq, words, islice(words, 1, None))), max(0, len(words) - 1)


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of the hashed 3-grams of each text, which has a blank put before and after it, and of its words (blanks apart)."""
    out = np.zeros((len(texts), COLUMNS))
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), CHARS):
            piece = text[a - 1 if a else 0 : a + CHARS + 1]
            piece = (" " if a == 0 else "") + piece + (" " if a + CHARS >= len(text) else "")
            held.append((i, piece))
            size += len(piece)
            if size >= CHARS or len(held) == ROWS:
                _count(held, out)
                held, size = [], 0
    if held:
        _count(held, out)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def weights(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    terms = _unit(np.log1p(counts[:, :TERMS]) * rarity)
    return _unit(np.hstack([terms, ECHO * counts[:, TERMS : TERMS + 1] / np.maximum(counts[:, TERMS + 1 :], 1)]))


@dataclass(frozen=True)
class Model:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
        """From the counts and labels of some texts; the singular vectors by subspace iteration from a fixed start."""
        rarity = np.log((1 + len(counts)) / (1 + (counts[:, :TERMS] > 0).sum(0))) + 1
        x = np.empty((len(counts), TERMS + 1), np.float32)
        for a in range(0, len(x), ROWS):
            x[a : a + ROWS] = weights(counts[a : a + ROWS], rarity)
        k = min(rank, *x.shape)
        g = np.random.default_rng(0).normal(size=(x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
        for _ in range(6):
            g = np.linalg.qr(x.T @ (x @ g))[0]
        basis = (g @ np.linalg.svd(x @ g, full_matrices=False)[2].T[:, :k]).astype(np.float64)
        return cls(rarity, basis, _unit((x @ basis.astype(np.float32)).astype(np.float64)) if len(x) else np.zeros((0, k)), labels)

    def embed(self, texts: list[str]) -> np.ndarray:
        return _unit(weights(term_counts(texts), self.rarity) @ self.basis)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of label 1 among each text's neighbours."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = np.round(self.embed(texts) @ self.vectors.T, 6)
        k = min(NEIGHBOURS, near.shape[1])
        limit = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        above, level = near > limit, near == limit
        votes = above | level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True))
        weight = np.where(votes, np.maximum(near, 0), 0)
        total = weight.sum(1)
        share = np.divide(weight @ self.labels, total, out=np.full(len(texts), self.labels.mean()), where=total > 0)
        return np.clip(share, 0, 1)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    for a in range(0, len(texts), ROWS):
        yield [t or "" for t in texts.slice(a, ROWS).to_pylist()]


def sample_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, size: int) -> DataFrame:
    """``place, text, label`` of the first labelled ids of ``docs`` in hash order."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).filter("key IS NOT NULL AND y IS NOT NULL").groupBy("key").agg(F.avg("y").alias("y"))
    there = docs.select(F.col(key).alias("key")).distinct()
    first = known.join(there, "key", "left_semi").withColumn("place", F.xxhash64("key")).orderBy("place", "key").limit(size)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(first), "key")
    return rows.groupBy("place", "key").agg(F.min("text").alias("text"), F.first("y").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", size: int = SAMPLE) -> Model:
    """A model from ``labels`` (``key, label``, a label from 0 to 1) of texts of ``docs``."""

    def count(batches):
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                counts = term_counts(part.column(2).to_pylist())
                terms = [np.flatnonzero(c).astype(np.int32) for c in counts]
                columns = [part.column(0), part.column(1), part.column(3), pa.array(terms, pa.list_(pa.int32())), pa.array([c[t].astype(np.int64) for c, t in zip(counts, terms)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "key", "label", "terms", "counts"])

    rows = sample_of(docs, labels, key, text, label, size)
    found = rows.mapInArrow(count, f"place long, key {rows.schema['key'].dataType.simpleString()}, label double, terms array<int>, counts array<long>").toArrow().sort_by([("place", "ascending"), ("key", "ascending")])
    counts = np.zeros((len(found), COLUMNS), np.float32)
    terms, n = (found[c].combine_chunks() for c in ("terms", "counts"))
    at = np.repeat(np.arange(len(found)), np.diff(terms.offsets.to_numpy()))
    counts[at, terms.flatten().to_numpy()] = n.flatten().to_numpy()
    labels_found = found["label"].to_numpy()
    del found, terms, n, at
    return Model.of(counts, labels_found)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(sent.value.score(b) for b in _blocks(texts))]))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(run, "double")(F.col(text)))


def op12_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(F.col("doc_id")) != 0)
    out = score(docs, fit(docs, labels, label="quality"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
