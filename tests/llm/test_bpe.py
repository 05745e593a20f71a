import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corepick.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def model():
    import json

    return bpe.WordBpe(json.load(open(PATH, encoding="utf-8")))


def test_every_code_point_equals_the_library(library):
    ours = model()
    chars = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"a{c}b {c} {c}{c}1" for c in chars]
    for t, o, e in zip(texts, ours.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert list(o) == e.ids, [hex(ord(c)) for c in t]


def test_random_texts_equal_the_library(library):
    ours, rnd = model(), random.Random(5)
    alphabet = ["a", "B", "th", "ing", " ", "\n", "\x1c", "'s", "'LL", "1", "23", "é", "é", "Σ", "İ", "中", "!", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "̧́", "가", " ", "\U0001f600"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(60))) for _ in range(4000)] + ["", "x" * 5000, "ab" * 4000, "thing" * 999]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(ours.encode(t)) == e.ids, t
        assert ours.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_scan_and_heap_agree():
    ours, rnd = model(), random.Random(7)
    for _ in range(300):
        word = bytes(rnd.choices(b"aeinrsth", k=rnd.randrange(1, 80)))
        assert ours._scan([word])[0] == tuple(ours._heap(word))


def test_query_on_nulls_repeats_and_clashing_columns(spark, library, tmp_path):
    texts = ["The Thing's 12.", None, "", "The Thing's 12.", "x" * 70000]
    rows = [(i if i != 3 else None, t, f"k{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op3_bpe_rank_array(spark, str(tmp_path)).collect()}
    assert len(got) == 5
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
    one = bpe.BpeTokenizer(spark, PATH)
    apart = docs.select("text", one.encode(F.col("text")).alias("ids")).select("ids", one.decode(F.col("ids")).alias("back"), one.decode(F.lit(None).cast("array<int>")).alias("none"))
    both = docs.select(one.round_trip(F.col("text")).alias("x")).select("x.*").collect()
    assert sorted((r.ids, r.back) for r in apart.collect()) == sorted(map(tuple, both)) and {r.none for r in apart.collect()} == {""}
    assert bpe.encode_documents(docs, PATH).filter(F.size("token_ids") > 0).count() == 3


def test_whole_columns_equal_single_texts():
    ours, rnd = model(), random.Random(9)
    alphabet = ["a", "B", "th", "ing", " ", "\n", "\x1c", "\x1f", "\x85", "\u2003", "\u3000", "'s", "1", "é", "Σ", "İ", "\u0301", "!", "&&", "<|"]
    for extra in ([], ["<|endoftext|>"]):
        texts = ["".join(rnd.choices(alphabet + extra, k=rnd.randrange(60))) for _ in range(2000)] + ["", " ", "x" * 5000, None]
        got = bpe._encoded(ours, bpe.pa.array(texts).slice(3))
        assert got.to_pylist() == [list(model_ids) for model_ids in model().encode_many([t or "" for t in texts[3:]])]


def test_common_words_are_merged_once_however_many_rare_ones_come(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 50)
    ours, merged = model(), []
    real = ours._merge
    monkeypatch.setattr(ours, "_merge", lambda words: merged.extend(words) or real(words))
    for i in range(20):
        ours.encode_many([f"the common. The {' '.join(f'rare{i}x{k}' for k in range(60))}"])
    assert merged.count(b"the") == merged.count(b"common") == 1
