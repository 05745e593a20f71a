import zlib
from collections import Counter

from corepick.llm import langid
from tests.llm.helpers import SF


def plain_grams(text):
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        p = f"_{w}_"
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def plain_ranked(counts):
    # shorter n-grams first among equal counts, then by code points with the blank before any letter
    key = lambda g: (-counts[g], len(g), g.replace("_", "\0"))
    return sorted(counts, key=key)[: langid.PROFILE_SIZE]


def plain_predict(text, profiles):
    own = plain_ranked(plain_grams(text or ""))
    if not own:
        return "und", 0.0
    places = {k: {g: i for i, g in enumerate(v)} for k, v in profiles.items()}
    dist = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE_SIZE for i, g in enumerate(own)) for k, p in places.items()}
    best = min(sorted(dist), key=dist.get)
    return best, 1 - dist[best] / (len(own) * langid.PROFILE_SIZE)


def test_profiles_and_predictions_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = langid.model_of(docs)
    for k, c in counts.items():
        assert profiles[k] == sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE_SIZE]
    got = {r.doc_id: r for r in langid.op8_rank_order_langid(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = plain_predict(r.text, profiles)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-12
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in langid.op8_rank_order_langid(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) > 0.95 * len(got)


def test_hard_rows(spark, tmp_path):
    texts = [None, "", "123 %%%", "the the the", "中文" * 3, "é\0x", "İ", "x" * 300000, "the the the"]
    rows = [(i if i else None, t, "en" if t and t.startswith("the") else None, "clash") for i, t in enumerate(texts)]
    rows += [(100 + i, "the cat and the dog", "en", None) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op8_rank_order_langid(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang_pred for i in (None, 1, 2)] == ["und"] * 3 and got[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty, {}).count() == 0 and langid.model_of(empty) == {}


def test_many_letters_fall_back_to_single_texts():
    wide = "".join(map(chr, range(0x4E00, 0x9FFF)))
    labels, scores = langid.nearest(["the the"] * 70 + [wide], {"en": ["t", "h", "e"], "zh": ["一"]})
    assert labels[:70] == ["en"] * 70 and labels[70] == "zh"
