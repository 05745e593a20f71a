import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from corepick.llm import decontaminate, langid, near, quality
from tests.llm.helpers import SF
from tests.llm.test_langid import plain_grams, plain_predict
from tests.llm.test_lines import brute
from tests.llm.test_near import plain_groups


def within(a, b):
    from corepick.llm.align import edits_within

    return edits_within(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = {}
    for r in docs.values():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {k: sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE_SIZE] for k, c in counts.items()}
    kept = []
    for i, r in sorted(docs.items()):
        lang, score = plain_predict(r.text, profiles)
        if lang != "und" and score >= cp.MIN_LANG_SCORE:
            kept.append((i, r.text))
    texts = [(i, t) for (i, _), t in zip(kept, brute(kept)) if t.strip()]
    words = [near.words_of(t.lower()) for _, t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if min(len(words[a]), len(words[b])) >= 0.8 * max(len(words[a]), len(words[b])) and within(words[a], words[b])]
    root = plain_groups(len(texts), links)
    texts = [t for k, t in enumerate(texts) if root[k] == k]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    leaks = {r[0] for r in con.execute(decontaminate.OP2_SQL).fetchall()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts:
        if i not in leaks:
            ids = library.encode(t, add_special_tokens=False).ids
            want[i] = (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in cp.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_hard_rows_pass_every_stage(spark, tmp_path):
    text = " ".join(f"word{'abcdefgh'[i % 8]}{'xyz'[i % 3]} and the" for i in range(200))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text + " more", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "%% 12", "en", "s", 5), (5, text.replace("and", "or"), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, None), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.limit(0)):
        for name, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert docs.columns == df.columns
        assert docs.count() <= 3


def test_clashing_columns_pass_every_stage(spark, tmp_path):
    names = ["guess", "hit_key", "hit_text", "tid", "row", "bpe", "root", "v", "id"]
    text = " ".join(f"word{i} and the" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "s", len(text), *names)], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"{c} string" for c in names)]))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert [tuple(r) for r in docs.collect()] == [tuple(r) for r in df.collect()]
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 1


def test_quality_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "h", "x", "y")], "doc_id long, text string, source string, host_of string, hashes_of string")
    assert [tuple(r) for r in quality.remove_frequent_lines(df).collect()] == [(1, "a b", "h", "x", "y")]
