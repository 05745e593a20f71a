import hashlib
import zlib

import pytest

from corepick.llm import merkle
from tests.llm.helpers import SF, run_sql, same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, scope string, pos int, path int"


def plain(rows):
    """The contract in plain Python: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row."""
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    ascii_lower = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    groups: dict = {}
    for i, text, lang, source, n, *_ in rows:
        leaf = h("".join(map(field, (i, source, lang, n, text))))
        touched = text is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        other = h("".join(map(field, (i, source, lang, n, text.translate(ascii_lower))))) if touched else leaf
        groups.setdefault(lang, []).append(((i is not None, i or 0, leaf), other))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, k, node):
        seen = ""
        for level in levels[:-1]:
            a = k // 8 * 8
            left, right = "".join(level[a:k]), "".join(level[k + 1 : a + 8])
            seen, node, k = seen + left + right, h(left + node + right), k // 8
        return seen, node

    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: tree([x[0][2] for x in sorted(groups[g])]) for g in names}
    top = tree([own[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for k, ((has, i, leaf), other) in enumerate(sorted(groups[g])):
            a, node = climb(own[g], k, other)
            b, root = climb(top, n, node)
            out.append((i if has else None, leaf, own[g][-1][0], top[-1][0], h(a + b), root, root == top[-1][0]))
    return sorted(out, key=str)


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query_equals_sql(spark):
    got = merkle.op11_merkle_manifest(spark, SF).toPandas()
    same_rows(got, run_sql(merkle.OP11_SQL))
    assert 0 < got.verified.sum() < len(got)


def test_hard_rows_equal_plain_python_and_sql(spark, tmp_path):
    x = ("x", "y", 7, 8)
    rows = [(i, "TEXT É " + str(i) * (i % 5), "hot", f"s{i % 3}", i, *x) for i in range(700)]
    rows += [(5, "Same", "hot", None, None, *x)] * 40 + [(5, "other", "hot", "s", 1, *x)]
    rows += [(None, "A", None, None, None, *x), (None, None, None, None, None, *x), (3, None, "null", "", 0, *x), (6, "", "", "", 0, *x), (9, "LONG " * 200_000, "b", "s", 5, *x)]
    rows += [(i, "Q", f"g{i}", "s", 1, *x) for i in range(60)]
    folder = write(spark, tmp_path, rows)
    got = merkle.op11_merkle_manifest(spark, folder)
    assert rows_of(got) == plain(rows)
    same_rows(got.toPandas(), run_sql(merkle.OP11_SQL, folder))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_of_one_group(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", 1, "", "", 0, 0) for i in range(n)]
    assert rows_of(merkle.op11_merkle_manifest(spark, write(spark, tmp_path, rows))) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert rows_of(merkle.op11_merkle_manifest(spark, write(spark, tmp_path, []))) == []


def test_any_change_of_a_row_is_seen(spark):
    docs = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(100)], "id long, body string, part int")
    changed = merkle.digest(*(merkle.field(c) for c in (docs.id, merkle.F.when(docs.id == 42, "other").otherwise(docs.body))))
    out = merkle.manifest(docs, ["id", "body"], "id", "part", changed)
    assert [r.id for r in out.filter("NOT verified").collect()] == [42]
    assert merkle.manifest(docs, ["id", "body"], "id", "part").filter("NOT verified").count() == 0
