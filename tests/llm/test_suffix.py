import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corepick.llm import suffix
from tests.llm.helpers import SF

L = suffix.LENGTH


def plain(texts):
    """n_removed, n_spans, digest of what is left, for each text."""
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + L] for r in raws for i in range(len(r) - L + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - L + 1):
            if starts[r[i : i + L]] > 1:
                gone[i] += 1
                gone[i + L] -= 1
        covered = np.cumsum(gone)[: len(r)] > 0
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(r), int(covered.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~covered])).hexdigest()))
    return out


def query(spark, folder, rows, schema="doc_id long, text string, h long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in suffix.op10_suffix_array_dedup(spark, str(folder)).collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abeé", k=rnd.randrange(1, 7)))
    passage = " ".join(word() for _ in range(70))
    base = " ".join(word() for _ in range(300))
    out = [None, "", "x", passage, base, base, "z" * 1000, "ab" * 700, "z" * 150, "z" * 300 + "y" * 150 + "z" * 300]
    out += [base[:k] + "Q" + base[k + 1 :] for k in (10, 400, 401, 700)]
    out += [" ".join(word() for _ in range(40)) + passage[rnd.randrange(30) :] + word() * 9 for _ in range(30)]
    out += [passage[:199], "p" + passage[:200] + "q", "\0" * 450, base[100:299] + "\0" * 260]
    return out


def test_query_equals_brute_force(spark, tmp_path, texts):
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)]
    assert query(spark, tmp_path, rows) == sorted(((i, *x) for (i, _, _), x in zip(rows, plain(texts))), key=str)


def test_hot_anchors_equal_brute_force(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)
    monkeypatch.setattr(suffix, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(suffix, "BROADCAST_ANCHORS", 0)
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    assert query(spark, tmp_path, rows) == sorted(((i, *x) for (i, _, _), x in zip(rows, plain(texts))), key=str)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix.op10_suffix_array_dedup(spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], plain([r.text for r in docs])))


def test_suffix_array_equals_sorting():
    rnd = random.Random(6)
    for _ in range(300):
        data = bytes(rnd.choices(b"aab\0c", k=rnd.randrange(1, 60))) + b"\xff"
        if rnd.random() < 0.3:
            data += data[: rnd.randrange(len(data))] + b"\xff"
        assert suffix.suffix_array(np.frombuffer(data, np.uint8), 128).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_runs_give_the_same_anchors(monkeypatch):
    data = bytes(random.Random(8).choices(b"abcd", k=5000))
    anchor = lambda: {i: (h, p) for h, p, a, b in zip(*(x.tolist() for x in suffix.anchors_of(data))) for i in range(a, b - L + 1)}
    whole = anchor()
    monkeypatch.setattr(suffix, "RUN", 700)
    assert whole == anchor() and sorted(whole) == list(range(len(data) - L + 1))


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    text = "".join(random.Random(1).choices("abcdef ", k=300))
    df = spark.createDataFrame([(1, text, 2, 3, "c"), (1, text, 2, 3, "c"), (2, None, 2, 3, "d")], "doc_id long, text string, t1 int, row int, runs string")
    out = suffix.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.t1, r.row, r.runs, len(r.kept_bytes), len(r.removed_spans)) for r in out) == [(1, 2, 3, "c", 0, 1)] * 2 + [(2, 2, 3, "d", 0, 0)]
    assert suffix.remove_repeats(df.filter(F.lit(False))).count() == 0
