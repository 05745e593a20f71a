import math
from collections import Counter

import numpy as np

from corepick.llm import classifier as c
from tests.llm.helpers import SF


def bucket(gram):
    h = sum(ord(x) * m for x, m in zip(gram, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))) & 0xFFFFFFFF
    h ^= h >> 15
    return (h * 0x2C1B3C6D & 0xFFFFFFFF) >> 20


def plain_counts(text):
    padded = f" {text} " if text else ""
    return Counter(bucket(padded[i : i + 3]) for i in range(len(padded) - 2))


def plain_score(model, text):
    """One text against all labelled vectors, without numpy's partitions or blocks."""
    weights = {t: math.log1p(n) * model.rarity[t] for t, n in plain_counts(text).items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    words = [w for a in range(0, len(text), c.CHARS) for w in [text[max(0, a - 1) : a + c.CHARS + 1].split()]]
    pairs = [p for w in words for p in zip(w, w[1:])]
    weights = {t: w / length for t, w in weights.items()} | ({c.TERMS: c.ECHO * sum(a == b for a, b in pairs) / len(pairs)} if pairs else {})
    v = sum((w * model.basis[t] for t, w in weights.items()), np.zeros(model.basis.shape[1]))
    size = math.sqrt(float(v @ v))
    near = [round(float(v @ x) / size, 6) if size else 0.0 for x in model.vectors]
    votes = sorted(range(len(near)), key=lambda i: (-near[i], i))[: c.NEIGHBOURS]
    total = sum(max(near[i], 0) for i in votes)
    return sum(max(near[i], 0) * model.labels[i] for i in votes) / total if total else float(model.labels.mean())


def test_counts_equal_plain_python(monkeypatch):
    monkeypatch.setattr(c, "CHARS", 50)
    texts = ["", "a", "ab", "é\U0001f600", "abc " * 100, "x" * 50, "y" * 51, "z" * 100, *(f"text {i}" for i in range(300))]
    got = c.term_counts(texts)
    for t, row in zip(texts, got):
        want = plain_counts(t)
        assert {k: row[k] for k in np.flatnonzero(row[: c.TERMS])} == want, t
    assert c.term_counts(["a a b b b", "a", ""])[:, c.TERMS :].tolist() == [[3, 4], [0, 0], [0, 0]]


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").filter(c.fold(c.F.col("doc_id")) != 0)


def test_query_equals_a_plain_vote_over_all_neighbours(spark):
    docs, labels = docs_of(spark)
    model = c.fit(docs, labels, label="quality")
    assert len(model.labels) == labels.join(docs, "doc_id").count()
    rows = c.op12_neighbour_votes(spark, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - plain_score(model, texts[r.doc_id] or "")) < 1e-4, r
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = c.op12_neighbour_votes(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    right = (got.predicted == got.quality).groupby(got.quality).mean()
    assert len(got) > 500 and right.min() > 0.95, right
    bad, good = got[got.quality == 0].score, got[got.quality == 1].score
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97


def test_the_sample_bounds_what_teaches(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} number {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, label int")
    model = c.fit(docs, labels, size=64)
    assert len(model.labels) == 64 and model.vectors.shape == (64, 64)
    again = c.fit(docs.repartition(5), labels.repartition(3), size=64)
    assert (model.labels == again.labels).all() and np.allclose(np.abs(model.vectors @ model.vectors.T), np.abs(again.vectors @ again.vectors.T), atol=1e-4)


def test_hard_rows(spark):
    schema = "doc_id long, text string, score string, key int, place int"
    rows = [(1, None, "s", 0, 0), (2, "", "s", 0, 0), (None, "good words", "s", 0, 0), (3, "bad", "s", 0, 0), (4, "good " * 200_000, "s", 0, 0), (5, "good words", "s", 0, 0), (5, "good words", "s", 0, 0), (6, "bad bad", "s", 0, 0), (7, "퟿\U0010ffff", "s", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (3, 0), (3, 1), (None, 1), (4, None), (99, 1)], "doc_id long, label int")
    model = c.fit(docs, labels)
    assert sorted(model.labels) == [0, 0.5, 1]
    out = c.score(docs, model).collect()
    assert len(out) == len(rows) and out[0].score == out[1].score == 0.5 and out[5].score == out[6].score > 0.9
    assert out[2].score == out[5].score and set(out[0].asDict()) == {"doc_id", "text", "score", "key", "place"}
    for r, row in zip(out, rows):
        assert abs(r.score - plain_score(model, row[1] or "")) < 1e-4
    empty = c.fit(docs, labels.limit(0))
    assert {r.score for r in c.score(docs, empty).collect()} == {0.5}
    assert c.score(docs.limit(0), model).collect() == [] and len(c.fit(docs.limit(0), labels).labels) == 0
