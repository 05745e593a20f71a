import random
from itertools import combinations

import pytest

import corpus_pipeline
from corepick.llm import decontaminate as dc
from tests.llm.helpers import SF, run_sql, same_rows


def test_query_equals_sql(spark):
    got = dc.op2_spaced_seeds(spark, SF).toPandas()
    same_rows(got, run_sql(dc.OP2_SQL))
    assert len(got)


def plain(docs, items):
    """Every run at every offset of every pair, without seeds and sums."""
    out = {}
    for d, x in docs:
        for b, y in items:
            for shift in range(-len(y) + 1, len(x)):
                lo, hi = max(0, shift), min(len(x), len(y) + shift)
                same = [x[i] == y[i - shift] for i in range(lo, hi)]
                if len(y) < dc.MASKED_FROM and not (same and all(same) and len(same) == len(y)):
                    continue
                for end in range(1, len(same) + 1):
                    # the longest run that ends here and agrees
                    start = next((i for i in range(end) if 5 * sum(same[i:end]) >= 4 * (end - i)), end)
                    if end - start >= min(dc.MIN_TOKENS, len(y)):
                        out[d, b] = max(out.get((d, b), (0, -9999)), (sum(same[start:end]), start - end))
    return {(*k, -n, e) for k, (e, n) in out.items()}


def test_substitutions_are_tolerated(spark, tmp_path):
    """One token in eight is changed: each offset that agrees well has a seed that misses the changes."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, rnd.choices(vocab, k=rnd.randrange(25, 60))) for i in range(12)]
    docs = []
    for i in range(40):
        words = rnd.choices(vocab, k=rnd.randrange(0, 120))
        part = items[i % 12][1][:]
        for j in range(rnd.randrange(8), len(part), 12):
            part[j] = "changed"
        at = rnd.randrange(len(words) + 1)
        docs.append((i, words[:at] + (part if i % 3 else part[: len(part) // 4]) + words[at:]))
    text = [(d, " ".join(w).title() + "!", "x") for d, w in docs]
    spark.createDataFrame([*text, (None, text[1][1], "x"), (1, text[1][1], "x"), (50, None, "x"), (51, "", "x")], "doc_id long, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w), "y") for i, w in items] + [(99, None, "y"), (98, "short", "y")], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dc.op2_spaced_seeds(spark, str(tmp_path)).toPandas()
    same_rows(got, run_sql(dc.OP2_SQL, str(tmp_path)))
    found = {(int(r.doc_id), int(r.item_id), int(r.n_overlap), int(r.n_equal)) for r in got[got.doc_id.notna()].itertuples()}
    assert found == plain(docs, items) and got.doc_id.isna().sum() == 1
    docs_df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = dc.drop_contaminated(docs_df, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.count() == docs_df.count() - len(got) - 1 and kept.columns == docs_df.columns


def test_short_runs_leave_a_mask_whole():
    """Of all ways to change as many tokens of a run as may differ, the share that leaves a mask whole somewhere."""
    for length in range(dc.MIN_TOKENS, 21):
        laid = [{at + i for i, c in enumerate(m) if c == "1"} for m in dc.MASKS for at in range(length - len(m) + 1)]
        ways = list(combinations(range(length), round((1 - dc.SIMILARITY) * 1000) * length // 1000))
        found = sum(any(m.isdisjoint(w) for m in laid) for w in ways)
        assert found >= 0.97 * len(ways), (length, found / len(ways))


def test_short_runs_with_every_change_allowed_are_found(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    items, docs = [], []
    for i in range(240):
        item = rnd.choices(vocab, k=13 + i % 8)
        part = item[:]
        for j in rnd.sample(range(len(part)), len(part) // 5):
            part[j] = "changed"
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(rnd.choices(vocab, k=30) + part + rnd.choices(vocab, k=30))))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id for r in got) and len(got) >= 0.95 * len(docs), len(got)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    whole = dc.op2_spaced_seeds(spark, SF).toPandas()
    monkeypatch.setattr(dc, "TOKENS_AT_ONCE", 300)
    same_rows(whole, dc.op2_spaced_seeds(spark, SF).toPandas())


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        rows = [] if name == empty else [(1, "a b c d e f g h i j k l m n o p q r s t")]
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert dc.op2_spaced_seeds(spark, str(tmp_path)).count() == 0


def test_plan_is_native(spark):
    plan = dc.op2_spaced_seeds(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parts_edits_and_short_items_are_found(spark, tmp_path):
    item = [f"t{i}" for i in range(60)]
    around = [f"x{i}" for i in range(100)]
    few = "just five tokens in all".split()
    texts = [
        around + item[10:40] + around,
        around + item[:30] + ["new"] + item[30:] + around,
        around + item[:29] + item[30:] + around,
        around + item[20:33] + around,
        around + item[20:30] + around,
        around + few + around,
        around + few[:4] + around,
        around + ["changed" if i % 6 == 5 else t for i, t in enumerate(item)] + around,
        around + around,
    ]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    names = ["hit_key", "hit_text", "k_", "t_", "item_", "hit_"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(few))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = dc.op2_spaced_seeds(spark, str(tmp_path)).toPandas()
    same_rows(got, run_sql(dc.OP2_SQL, str(tmp_path)))
    assert {tuple(map(int, r)) for r in got[["doc_id", "item_id", "n_overlap", "n_equal"]].itertuples(index=False)} == plain([(d, t.split()) for d, t in rows], [(1, item), (2, few)])
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {4, 6, 8} and kept.columns == docs.columns


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(None, item), (None, "clean"), (1, item), (1, "clean"), (1, item)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, dc.drop_contaminated(docs, items).collect())) == ["Row(doc_id=1, text='clean')", "Row(doc_id=None, text='clean')"]
