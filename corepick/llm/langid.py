"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the ``PROFILE_SIZE`` most frequent n-grams (1 to 3 letters, words padded by a blank, lower case) of
a language, most frequent first. A document's own list is compared to each profile by the out-of-place distance: the sum
over its n-grams of how far each stands from its place in the profile, ``PROFILE_SIZE`` for one that is not there. The
nearest profile wins; ties go to the first name. Counting and comparing run in numpy over Arrow batches; the n-gram counts
of all labelled documents are added up by Spark, and only the profiles (``PROFILE_SIZE`` rows a language) reach the driver.

The score is ``1 - distance / largest possible distance``, from 0 to 1.

Nulls: a null or letterless text is ``und`` with score 0. Documents with a null label or text teach nothing. A null id
counts as an empty one. Repeated rows are predicted (and, for learning, counted) each. An empty training set makes every
prediction ``und``. Extra columns are kept by :func:`identify`, whatever their names; one of a name that it adds is replaced.
Very long texts count whole. More than ``MAX_LANGUAGES`` labels raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.llm.common import fresh, small_batches, table
from corepick.llm.words import slices

PROFILE_SIZE = 300
#: Most languages that a model may have; bounds what the driver and each worker hold.
MAX_LANGUAGES = 2_000
UNDETERMINED = "und"


class Grams:
    """Counts of n-grams by group over some texts: parallel arrays ``group, code, count``, sorted by group, then code."""

    def __init__(self, texts: list[str], groups: np.ndarray):
        lowered = [t.lower() for t in texts]
        points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.concatenate([groups[:1], groups]), np.array([1] + [len(t) + 1 for t in lowered]))
        seen = np.zeros(0x110000, bool)
        seen[points] = True
        letters = [c for c in np.flatnonzero(seen) if chr(c).isalpha()]
        #: 0 stands for nothing, 1 for a blank; letters follow in order of their code points.
        self.letter = ["", "_", *map(chr, letters)]
        table_ = np.ones(0x110000, np.uint64)
        table_[letters] = np.arange(2, len(letters) + 2)
        ids = table_[points]
        keep = (ids > 1) | (np.concatenate([[2], ids[:-1]]) > 1)
        ids, owner = ids[keep], owner[keep].astype(np.uint64)
        #: Letters take ``bits`` each, shorter n-grams have zeros before; the group stands above.
        self.bits = int(len(letters) + 1).bit_length()
        b, g = np.uint64(self.bits), np.uint64(3 * self.bits)
        if 3 * self.bits + int(groups.max(initial=0)).bit_length() > 63:
            raise OverflowError
        one = ids > 1
        mid = one[1:-1]
        two = (ids[:-1] << b) | ids[1:]
        parts = [
            (owner[one] << g) | ids[one],
            (np.where(one[:-1], owner[:-1], owner[1:]) << g) | two,
            (owner[1:-1][mid] << g) | (ids[:-2][mid] << (b + b)) | two[1:][mid],
        ]
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        self.group, self.code, self.count = (codes >> g).astype(np.int64), codes & np.uint64((1 << 3 * self.bits) - 1), counts

    def name(self, code: int) -> str:
        mask = (1 << self.bits) - 1
        return "".join(self.letter[code >> k * self.bits & mask] for k in (2, 1, 0))

    def code_of(self, gram: str, number: dict[str, int]) -> int | None:
        """``number``: the place of each letter in ``letter``."""
        code = 0
        for c in gram:
            if c not in number:
                return None
            code = code << self.bits | number[c]
        return code

    def ranked(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``group, code, rank`` of the ``size`` most frequent n-grams of each group; ties by code points."""
        order = np.lexsort((self.code, -self.count, self.group))
        group, code = self.group[order], self.code[order]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(starts, np.diff([*starts, len(group)]))
        top = rank < size
        return group[top], code[top], rank[top]


def grams_of(texts: list[str], groups: np.ndarray) -> Iterator[tuple[int, int, Grams]]:
    """Grams of slices of texts, of single texts where the letters of a slice are too many for one code."""
    for a, b in slices(texts):
        try:
            yield a, b, Grams(texts[a:b], groups[a:b])
        except OverflowError:
            for i in range(a, b):
                yield i, i + 1, Grams(texts[i : i + 1], groups[i : i + 1])


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, gram, rank`` (from 0) from every labelled document."""

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted({*langs})
            numbers = {x: n for n, x in enumerate(names)}
            for _, _, g in grams_of(texts, np.array([numbers[x] for x in langs], np.int64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in g.group.tolist()], pa.string()), pa.array([g.name(c) for c in g.code.tolist()], pa.string()), pa.array(g.count, pa.int64())],
                    names=["lang", "gram", "n"],
                )

    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    counts = labelled.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(by_place) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def collect_profiles(profiles: DataFrame) -> dict[str, list[str]]:
    rows = profiles.limit(MAX_LANGUAGES * PROFILE_SIZE + 1).collect()
    out: dict[str, dict[int, str]] = {}
    for r in rows:
        out.setdefault(r.lang, {})[r.rank] = r.gram
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {k: [v[i] for i in sorted(v)] for k, v in sorted(out.items())}


def nearest(texts: list[str], profiles: dict[str, list[str]], size: int = PROFILE_SIZE) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    names = list(profiles)
    labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for a, b, g in grams_of(texts, np.arange(len(texts))):
        group, code, rank = g.ranked(size)
        if not len(group) or not names:
            continue
        number = {c: i for i, c in enumerate(g.letter) if c}
        known: dict[int, dict[int, int]] = {}
        for n, lang in enumerate(names):
            for place, gram in enumerate(profiles[lang]):
                if (c := g.code_of(gram, number)) is not None:
                    known.setdefault(c, {})[n] = place
        codes = np.array(sorted(known), np.uint64)
        places = np.full((len(codes) + 1, len(names)), -1, np.int32)
        for i, c in enumerate(codes.tolist()):
            for n, place in known[c].items():
                places[i, n] = place
        at = np.searchsorted(codes, code)
        at = np.where((at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == code), at, len(codes)) if len(codes) else np.zeros(len(code), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lengths = np.diff([*starts, len(group)])
        distance = np.empty((len(starts), len(names)))
        for n in range(len(names)):
            place = places[at, n]
            distance[:, n] = np.add.reduceat(np.where(place < 0, size, np.abs(place - rank)), starts)
        best = distance.argmin(1)
        share = 1 - distance[np.arange(len(starts)), best] / (lengths * size)
        for d, n, s in zip(group[starts].tolist(), best.tolist(), share.tolist()):
            labels[d], scores[d] = names[n], min(1.0, max(0.0, s))
    return labels, scores


def identify(docs: DataFrame, profiles: dict[str, list[str]], text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(texts: pa.Array) -> pa.Array:
        labels, scores = nearest([t or "" for t in texts.to_pylist()], sent.value)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["label", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    guess = F.arrow_udf(run, "label string, score double")(F.col(text))
    both = fresh(docs, "guess")
    return docs.withColumn(both, guess).withColumns({label: F.col(f"{both}.label"), score: F.col(f"{both}.score")}).drop(both)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def model_of(docs: DataFrame) -> dict[str, list[str]]:
    """Profiles of the documents outside the held-out fold."""
    return collect_profiles(learn_profiles(docs.filter(fold(F.col("doc_id")) != 0)))


def op8_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), model_of(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
