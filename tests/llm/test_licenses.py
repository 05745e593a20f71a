import textwrap

from corepick.llm import licenses
from tests.llm.helpers import SF, run_sql, same_rows


def test_query_equals_sql(spark):
    got = licenses.op4_license_digest(spark, SF).toPandas()
    same_rows(got, run_sql(licenses.OP4_SQL))
    assert got.n_license_lines.sum() > 0


def test_variants_and_hard_rows(spark, tmp_path):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    changed = "Copyright (c) 2020 Somebody\n  (C) 1999 another\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,\n\t")
    rows = [(1, changed, "x"), (1, changed, "x"), (2, mit + " and more", "x"), (3, None, "x"), (4, "", "x"), (None, "released under THE mit licence", "x"), (5, "a\nLicensed under CC BY-NC 4.0.\nb\nlicensed under CC-BY-NC 4.0\n" + "z " * 90000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, license string").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op4_license_digest(spark, str(tmp_path)).toPandas()
    same_rows(got, run_sql(licenses.OP4_SQL, str(tmp_path)))
    by = {(r.doc_id if r.doc_id == r.doc_id else None): r for r in got.itertuples()}
    assert by[1].license == "MIT" and by[None].license == "MIT" and by[2].license is None
    assert by[5].n_license_lines == 2 and by[5].line_licenses == "CC-BY-NC-4.0"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(df, licenses.known_digests(spark)).count() == 0


def test_every_wrap_and_comment_sign(spark):
    texts = [x for x in licenses.KNOWN if len(x[1]) > 300]
    rows, want = [], []
    for name, body in texts:
        for width in range(12, 131):
            for sign in ("", "# ", " * "):
                wrapped = "\n".join(sign + line for part in body.split("\n") for line in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""])
                rows.append((len(rows), f"{sign}Copyright (c) 2020 A. Person\n{sign}Copyright Some Body\n{sign}(C) 2001-2003 X\n{sign}All rights reserved.\n" + wrapped))
                want.append(name)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.known_digests(spark)).collect()}
    assert [i for i, name in enumerate(want) if got[i] != name] == []


def test_known_from_a_folder(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Do what you like.\nBut not here.")
    df = spark.createDataFrame([(1, "do what YOU like but not here", 1, 2), (2, "x", 1, 2)], "doc_id long, text string, license int, k_ int")
    got = {r.doc_id: r.license for r in licenses.scan(df, licenses.read_known(spark, str(tmp_path))).collect()}
    assert got == {1: "Own-1.0", 2: None}
