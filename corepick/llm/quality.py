"""Quality rules with a cross-document line frequency, in DataFrame functions only.

Per text: word and symbol counts, repeated lines and words in repeated 3-word windows. Across texts: each normalised line
is hashed, the distinct documents that hold it are counted per host (``source``), lines above both limits are removed, and
a document that loses more than ``max_removed_share`` of its words is rejected. A document is a row; its own repeats of a
line count once. The counts are pre-aggregated before the shuffle, so a hot host or line makes one row a task. Lines above
the limits are few as a rule: they are broadcast if at most ``BROADCAST_LINES``, and joined by a shuffle beyond that.

3-word windows are compared by 64-bit hashes within one text, lines by 64-bit hashes within one host.

Nulls: a null text has no words and no lines, a null source is a host of its own. Empty texts fail the base rules. Repeated
rows each get their own verdict; nothing here depends on an order, so there are no ties. Texts are worked on whole, and one
text's words and lines are held by its task. Columns other than those named are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import cut, fits, fresh, table

SPACE = "[\\x20\\x09-\\x0D]+"
BROADCAST_LINES = 200_000
#: A line is above the limits if more documents of a host hold it than either allows.
MAX_DOCS = 10
MAX_SHARE = 0.01
MAX_REMOVED_SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def with_repeats(docs: DataFrame, words: str, out: str) -> DataFrame:
    """``out``: how many words lie in 3-word windows that occur twice or more, the first occurrence included."""
    w = F.col(words)
    window = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    docs = docs.withColumn("windows_", F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), window)))
    s = F.col("windows_")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    # element j of the sorted windows repeats if either neighbour has its hash; get() gives null beyond the end, and before the start only for j = 0
    repeats = F.filter(s, lambda x, j: same(x, j + 1) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
    docs = docs.withColumn("starts_", F.array_sort(F.transform(repeats, lambda x: x["i"])))
    p = F.col("starts_")
    covered = F.transform(p, lambda v, j: F.least(F.lit(3), F.get(p, j + 1) - v))
    return docs.withColumn(out, F.aggregate(covered, F.lit(0).cast("long"), lambda a, v: a + v)).drop("windows_", "starts_")


def with_base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each text and ``base_failed``."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("words_", words_of(F.col(text)))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    docs = docs.withColumn("lines_", lines)
    docs = with_repeats(docs, "words_", "n_repeat_words")
    docs = docs.withColumns(
        {
            "n_words": F.size("words_").cast("long"),
            "word_chars": F.length(F.array_join("words_", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        }
    ).drop("words_", "lines_")
    return docs.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_structs(text: Column) -> Column:
    """The lines of a text that hold a word: hash of the normalised line and its number of words."""
    normal = lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``(host, h)`` of the lines that more than ``max_docs`` documents and more than ``max_share`` of a host's documents hold."""
    own = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(line_structs(F.col(text)), lambda x: x["h"])).alias("hs"))
    counts = own.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    hosts = docs.groupBy(F.col(host).alias("host_")).agg(F.count("*").alias("docs"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).filter(F.col("n") > max_share * F.col("docs")).select("host", "h")


def line_frequency_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", max_removed_share: float = MAX_REMOVED_SHARE, **limits) -> DataFrame:
    """One row per row of ``docs``: ``key``, the base counts, ``base_failed``, ``n_removed_lines``, ``n_removed_words``, ``kept``."""
    docs = docs.select(F.col(key).alias("k_"), F.col(host).alias("host_"), F.col(text).alias("t_"))
    common = cut(frequent_lines(docs, "t_", "host_", **limits).select(F.col("host").alias("host_c"), F.col("h").alias("h_c")))
    if fits(common, BROADCAST_LINES):
        common = F.broadcast(common)
    row = F.xxhash64("k_", "host_", "t_").alias("row_")
    lines = docs.select("k_", row, "host_", F.explode(line_structs(F.col("t_"))).alias("line")).select("k_", "row_", "host_", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    found = lines.join(common, F.col("host_").eqNullSafe(F.col("host_c")) & (F.col("h") == F.col("h_c")))
    # equal rows fall into one group here; each of them lost the same lines, hence the division by their number below
    lost = found.groupBy(F.col("k_").alias("k_l"), F.col("row_").alias("row_l")).agg(F.count("*").alias("lost_lines"), F.sum("n").alias("lost_words"))
    base = with_base_rules(docs.select("k_", row, "t_"), "t_").drop("t_")
    copies = base.groupBy(F.col("k_").alias("k_c"), F.col("row_").alias("row_c")).agg(F.count("*").alias("copies")).filter("copies > 1")
    lost = lost.join(copies, F.col("k_l").eqNullSafe(F.col("k_c")) & (F.col("row_l") == F.col("row_c")), "left")
    per = F.coalesce(F.col("copies"), F.lit(1))
    lost = lost.select("k_l", "row_l", (F.col("lost_lines") / per).cast("long").alias("n_removed_lines"), (F.col("lost_words") / per).cast("long").alias("n_removed_words"))
    out = base.join(lost, F.col("k_").eqNullSafe(F.col("k_l")) & (F.col("row_") == F.col("row_l")), "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_removed_lines", "n_removed_words")})
    depleted = F.col("n_removed_words") > max_removed_share * F.col("n_words")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words")
    return out.select(F.col("k_").alias(key), *counts, (~F.col("base_failed") & ~depleted).alias("kept"))


def remove_frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` with the lines above the limits taken out of ``text``; the hash lists per host are joined by host.

    A host's list holds at most one line per ``max_docs`` documents and ``1 / max_share`` per line position, so it stays small.
    """
    own, hashes = fresh(docs, "host_of"), fresh(docs, "hashes_of")
    lines = cut(frequent_lines(docs, text, host, **limits))
    common = lines.groupBy(F.col("host").alias(own)).agg(F.collect_list("h").alias(hashes))
    joined = docs.join(F.broadcast(common) if fits(lines, BROADCAST_LINES) else common, F.col(host).eqNullSafe(F.col(own)), "left")
    normal = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(hashes), normal(x)), F.lit(False)))
    return joined.withColumn(text, F.array_join(kept, "\n")).select(*docs.columns)


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


_W = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_W} AS w FROM documents
), l AS (
  SELECT r, source, doc_id, x, lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS y
  FROM (SELECT r, source, doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY r
), g AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), hosts AS (
  SELECT source, count(*) AS docs FROM documents GROUP BY source
), common AS (
  SELECT c.source, c.y FROM (SELECT source, y, count(DISTINCT r) AS n FROM l GROUP BY source, y) c
  JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {MAX_DOCS} AND n > {MAX_SHARE} * docs
), lost AS (
  SELECT r, count(*) AS n_removed_lines, sum(len(string_split(l.y, ' '))) AS n_removed_words
  FROM l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.y = c.y GROUP BY r
), base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= {MAX_REMOVED_SHARE} * n_words AS kept
FROM base
"""
