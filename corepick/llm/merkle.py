"""A Merkle manifest of a table: a tree of digests per group and one over the groups, with a proof for every row.

Rows are leaves. Per level, each run of ``FANOUT`` consecutive nodes becomes the digest of its digests; columns at fixed lags
and leads, masked by a node's slot and the length of its run, supply its siblings, and the first child of a run hashes the
parent. Windows span ``BLOCK`` nodes, which no run crosses, so a hot group is dealt out like any other, and each level is an
eighth of the one below. The driver holds the number of levels and the root. The paths are put together from the top
down, so that a run's siblings further up are joined once for all its rows.

Nulls: a null field is ``-``; a null group is one group, before all others; a null id comes first in its group and is never
tampered with. Ties: rows of equal id are ordered by their leaf; equal rows are leaves of their own, each with its own proof.
Empty and very long texts are hashed whole. An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.llm.common import SQL_CRC32, cut, fits, table
from corepick.llm.places import placed, same

FANOUT = 8
#: Nodes in a window, a multiple of FANOUT.
BLOCK = 64
BROADCAST_GROUPS = 10_000


def field(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value, or ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def with_family(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``scope, pos, size, h``) with the digests to the ``left`` and ``right`` in their run, ``run`` and ``parent``
    (at the first child, else null). A node that is alone in its scope has no family."""
    slot, run = F.col("pos") % FANOUT, F.floor(F.col("pos") / FANOUT)
    length = F.least(F.lit(FANOUT), F.col("size") - run * FANOUT)
    near = Window.partitionBy("scope", F.floor(F.col("pos") / BLOCK)).orderBy("pos")
    left = [F.when(slot >= k, F.lag("h", k).over(near)) for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("h", k).over(near)) for k in range(1, FANOUT)]
    nodes = nodes.withColumns({"left": F.concat_ws("", *left), "right": F.concat_ws("", *right), "run": run})
    return nodes.withColumn("parent", F.when((slot == 0) & (F.col("size") > 1), digest(F.col("h"), F.col("right"))))


@dataclass
class Forest:
    """``levels`` from the leaves up and ``tops(scope, h)``, the last node of each scope."""

    levels: list[DataFrame]
    tops: DataFrame

    def leaves(self) -> DataFrame:
        """The leaves with ``path``: the siblings ``left`` and ``right`` level by level up to the top of their scope."""
        above = None
        for level in reversed(self.levels):
            siblings = F.array(F.struct("left", "right"))
            own = level.withColumn("path", F.when(F.col("size") > 1, siblings).otherwise(F.slice(siblings, 1, 0)))
            if above is not None:
                up = above.select(F.col("scope").alias("up_scope"), F.col("pos").alias("up_pos"), F.col("path").alias("up_path"))
                met = same([F.col("scope"), F.col("run")], [F.col("up_scope"), F.col("up_pos")])
                own = own.join(up, met, "left").withColumn("path", F.concat("path", F.coalesce("up_path", F.slice(F.col("path"), 1, 0))))
            above = own.drop("up_scope", "up_pos", "up_path")
        return above


def forest(leaves: DataFrame) -> Forest:
    """The trees over ``leaves``: ``scope, pos`` (from 0), ``size`` of the scope, ``h`` and any others."""
    level = cut(with_family(leaves))
    levels, most = [level], level.agg(F.max("size")).first()[0] or 0
    while most > 1:
        parents = level.filter("parent IS NOT NULL").select("scope", F.col("run").alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size"), F.col("parent").alias("h"))
        level, most = cut(with_family(parents)), -(-most // FANOUT)
        levels.append(level)
    tops = levels[0].filter("size = 1").select("scope", "h")
    for level in levels[1:]:
        tops = tops.union(level.filter("size = 1").select("scope", "h"))
    return Forest(levels, tops)


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: digest(x["left"], h, x["right"]))


def manifest(docs: DataFrame, fields: list[str], key: str, group: str, claimed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``leaf``, ``subroot`` of its group, ``root``, ``path`` (siblings by level, to the
    root), ``proof_sha256``, ``folded_root`` (from ``claimed``, the leaf as found now, if given) and ``verified``."""
    leaf = digest(*(field(F.col(c)) for c in fields))
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("scope"), leaf.alias("h"), (leaf if claimed is None else claimed).alias("claimed"))
    own = forest(placed(rows, ["scope"], ["key", "h"]))
    top = forest(placed(own.tops.select(F.col("scope").alias("group"), "h").withColumn("scope", F.lit(0)), ["scope"], ["group"]))
    first = top.tops.select("h").first()
    groups = top.leaves().select("group", F.col("h").alias("subroot"), F.col("path").alias("top_path"))
    groups = F.broadcast(groups) if fits(groups, BROADCAST_GROUPS) else groups
    rows = own.leaves().join(groups, F.col("scope").eqNullSafe(F.col("group"))).withColumn("path", F.concat("path", "top_path"))
    rows = rows.withColumn("root", F.lit(first.h if first else None).cast("string"))
    rows = rows.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", siblings_digest(F.col("path")).alias("proof_sha256"), fold(F.col("claimed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    found = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    claimed = digest(*(field(found if c == "text" else F.col(c)) for c in FIELDS))
    return manifest(docs, FIELDS, "doc_id", "lang", claimed).drop("path")


def _sql_field(c: str, value: str | None = None) -> str:
    v = f"CAST({value or c} AS VARCHAR)"
    return f"coalesce(strlen({v}) || ':' || {v}, '-')"


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({" || ".join(_sql_field(c) for c in FIELDS)}) AS leaf,
    sha256({" || ".join(_sql_field(c, f"CASE WHEN doc_id IS NOT NULL AND {SQL_CRC32.format('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END" if c == "text" else None) for c in FIELDS)}) AS claimed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM d
), tree(lvl, lang, pos, size, h) AS (
  SELECT 0, lang, pos, size, leaf FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, pos // {FANOUT}, (max(size) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE size > 1 GROUP BY lvl, lang, pos // {FANOUT}
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE size = 1
), top(lvl, pos, size, h) AS (
  SELECT 0, pos, size, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {FANOUT}, (max(size) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE size > 1 GROUP BY lvl, pos // {FANOUT}
), walk(r, lang, lvl, pos, h, proof) AS (
  SELECT r, lang, 0, pos, claimed, '' FROM leaves
  UNION ALL
  SELECT w.r, any_value(w.lang), any_value(w.lvl) + 1, any_value(w.pos) // {FANOUT}, sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.h ELSE t.h END, '' ORDER BY t.pos)),
    any_value(w.proof) || coalesce(string_agg(CASE WHEN t.pos <> w.pos THEN t.h END, '' ORDER BY t.pos), '')
  FROM walk w JOIN tree t ON t.lvl = w.lvl AND t.lang IS NOT DISTINCT FROM w.lang AND t.pos // {FANOUT} = w.pos // {FANOUT} AND t.size > 1 GROUP BY w.r
), reached AS (
  SELECT w.r, w.lang, s.h AS subroot, s.pos, w.h, w.proof FROM walk w JOIN tree t ON t.lvl = w.lvl AND t.lang IS NOT DISTINCT FROM w.lang AND t.size = 1
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
), climb(r, lvl, pos, h, proof) AS (
  SELECT r, 0, pos, h, proof FROM reached
  UNION ALL
  SELECT w.r, any_value(w.lvl) + 1, any_value(w.pos) // {FANOUT}, sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.h ELSE t.h END, '' ORDER BY t.pos)),
    any_value(w.proof) || coalesce(string_agg(CASE WHEN t.pos <> w.pos THEN t.h END, '' ORDER BY t.pos), '')
  FROM climb w JOIN top t ON t.lvl = w.lvl AND t.pos // {FANOUT} = w.pos // {FANOUT} AND t.size > 1 GROUP BY w.r
)
SELECT l.doc_id, l.leaf, x.subroot, root.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = root.h AS verified
FROM leaves l JOIN reached x USING (r) JOIN climb c USING (r) JOIN top root ON root.size = 1 AND c.lvl = root.lvl
"""
