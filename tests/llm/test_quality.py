from corepick.llm import quality
from tests.llm.helpers import SF, run_sql, same_rows


def test_query_equals_sql(spark):
    same_rows(quality.op7_line_frequency(spark, SF).toPandas(), run_sql(quality.OP7_SQL))


def test_hard_rows_equal_sql(spark, tmp_path):
    long = " ".join(f"w{i % 4999}" for i in range(30000))
    rows = [(1, "a b c a b c a b c", "s", 1), (1, "a b c a b c a b c", "s", 1), (None, None, None, None), (2, "", "s", 0), (3, " \n\t\n", None, 0), (4, long, "s", 1), (5, "é# \x0b*x\n\n é# x\né# \x0b*x", "s", 2)]
    rows += [(100 + i, "Cookie  POLICY here and so on for all\n" + " ".join(f"q{i}x{j}" for j in range(i * 5)), "s" if i % 2 else None, 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op7_line_frequency(spark, str(tmp_path)).toPandas()
    same_rows(got, run_sql(quality.OP7_SQL, str(tmp_path)))
    assert got.n_removed_lines.sum() == 40 and len(got) == len(rows)


def test_kept_lines(spark):
    rows = [(i, f"Common line\nown {i}", "h") for i in range(30)]
    out = quality.remove_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.text for r in out} == {f"own {i}" for i in range(30)}


def test_empty_and_plan(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = quality.op7_line_frequency(spark, str(tmp_path))
    assert df.count() == 0
    plan = quality.op7_line_frequency(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
