"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a pattern of token positions of which some are ignored, such as ``1101100111``. Each position of a text gives one
hash a mask, over the tokens that the mask selects; equal hashes in a benchmark item are hits, which a changed token in an
ignored position does not prevent. A hit fixes an offset at which the item is laid along the text, once however many hits it
has. Runs of at least ``min_tokens`` tokens (or the whole item, if shorter) of which ``similarity`` agree make the text
contaminated, so a text that quotes a part of an item is found, and one with tokens put in or left out if a run remains at one
offset; runs at several offsets are not added up. An equal token counts ``1 - similarity`` and another ``-similarity``, so a
run agrees if its sum is not negative: running sums and, for each place, the first place with no greater sum give the longest
such run that ends there. Both are window functions, so the work grows with the length of an overlap, not with its square.

The benchmark is a stated query set: it is dealt into blocks of about ``TOKENS_AT_ONCE`` tokens, whose seeds are broadcast.
Seeds of texts are made and looked up in one stage; what is shuffled are the offsets, and the tokens that items overlap.

Nulls: a null text or item has no tokens and matches nothing; a null id stays a null id. Repeated rows give one hit, since a
hit is a pair of ids; of texts with one id the best overlap counts. Ties: equal best overlaps have equal figures. Items of
fewer than ``MASKED_FROM`` tokens match where all of them stand in a text unchanged. Extra columns, whatever their
names, are ignored or kept. Empty tables give no rows. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corepick.llm.common import cut, fits, fresh, table

#: Spans of 10 and 11 tokens of which 7 count, and one of 7 tokens of which 6 count, for runs too short to leave the others whole:
#: of all ways to change as many tokens of a run as may differ, the three miss fewer than 3 % at 15 tokens and fewer elsewhere.
MASKS = ("1110110011", "11010010111", "1110111")
#: Items of fewer tokens are looked for unchanged.
MASKED_FROM = 10
SIMILARITY = 0.8
MIN_TOKENS = 13
TOKENS_AT_ONCE = 1_000_000
BROADCAST_IDS = 500_000
#: Fractions of an equal token's count are not kept.
SCALE = 1000


def tokens_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def token_hashes(text: Column) -> Column:
    return F.transform(tokens_of(text), lambda t: F.xxhash64(t))


def seed(tokens: str, at: Column, mask: str, number: int) -> Column:
    """Hash of the tokens that ``mask`` selects from place ``at`` (from 0) on; masks do not share hashes."""
    return F.xxhash64(F.lit(number), *(F.get(F.col(tokens), at + i) for i, c in enumerate(mask) if c == "1"))


def places(tokens: str, mask: str) -> Column:
    n = F.size(tokens) - len(mask)
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def seeds(df: DataFrame, tokens: str, masks: tuple[str, ...], lengths: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """A row per place and mask: ``at``, ``seed``, and the columns of ``df``; also for all tokens of runs of ``lengths``, or of texts that are ``whole`` so long."""
    # one explode over places, then one over the masks that fit there
    runs = tuple("1" * n for n in lengths)
    at = df.select("*", F.explode(places(tokens, min((*masks, *runs), key=len))).alias("at"))
    masked = (F.size(tokens) >= MASKED_FROM) if whole else F.lit(True)
    each = [F.when(masked & (F.col("at") + len(m) <= F.size(tokens)), seed(tokens, F.col("at"), m, k)) for k, m in enumerate(masks)]
    each += [F.when(F.size(tokens) == len(m) if whole else F.col("at") + len(m) <= F.size(tokens), seed(tokens, F.col("at"), m, -len(m))) for m in runs]
    return at.select("*", F.explode(F.array(*each)).alias("seed")).filter("seed IS NOT NULL")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _overlaps(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, masks: tuple[str, ...], similarity: float, min_tokens: int) -> DataFrame:
    """``k_, t_, item_, n_, e_``: runs that agree, ``n_`` tokens of which ``e_`` are equal, of texts named by key and hash."""
    items = benchmark.select(F.col(item).alias("item_"), token_hashes(F.col(item_text)).alias("b_")).filter(F.size("b_") > 0)
    blocks = max(1, -(-(items.agg(F.sum(F.size("b_"))).first()[0] or 0) // TOKENS_AT_ONCE))
    short = tuple(sorted(r.n for r in items.select(F.size("b_").alias("n")).filter(F.col("n") < MASKED_FROM).distinct().collect()))
    texts = docs.select(F.col(key).alias("k_"), text_hash(F.col(text)).alias("t_"), F.col(text).alias("x_"))
    found = None
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_"), F.lit(blocks)) == block)
        known = seeds(some, "b_", masks, short, whole=True).select(F.col("item_"), F.col("at").alias("j_"), F.col("seed").alias("seed_"))
        own = seeds(texts.select("k_", "t_", token_hashes(F.col("x_")).alias("d_")), "d_", masks, short)
        hits = own.join(F.broadcast(known), F.col("seed") == F.col("seed_")).select("k_", "t_", "item_", (F.col("at") - F.col("j_")).alias("shift_"))
        hits = hits.distinct()
        found = hits if found is None else found.union(hits)
    hits = cut(found).select(F.col("k_").alias("k2_"), F.col("t_").alias("t2_"), F.col("item_").alias("hit_"), "shift_")
    wanted = hits.select("k2_", "t2_").distinct()
    few = fits(hits, BROADCAST_IDS)
    # the tokens of the texts that are hit, then the overlaps of each with its items, once for equal rows
    hit = texts.join(F.broadcast(wanted) if few else wanted, F.col("k_").eqNullSafe(F.col("k2_")) & (F.col("t_") == F.col("t2_")), "left_semi")
    hit = hit.select("k_", "t_", token_hashes(F.col("x_")).alias("d_"))
    laid = hit.join(F.broadcast(hits) if few else hits, F.col("k_").eqNullSafe(F.col("k2_")) & (F.col("t_") == F.col("t2_")))
    laid = laid.join(F.broadcast(items) if blocks == 1 else items, F.col("hit_").eqNullSafe(F.col("item_")))
    lead = F.greatest("shift_", F.lit(0))
    n = F.least(F.size("d_"), F.size("b_") + F.col("shift_")) - lead
    same = F.zip_with(F.slice("d_", lead + 1, n), F.slice("b_", lead - F.col("shift_") + 1, n), lambda x, y: x == y)
    least = F.least(F.lit(min_tokens), F.size("b_"))
    laid = laid.filter(n >= least).select("k_", "t_", "item_", "shift_", least.alias("least_"), same.alias("same_"))
    one = ["k_", "t_", "item_", "shift_"]
    tokens = laid.dropDuplicates(one).select(*one, "least_", F.posexplode(F.concat(F.array(F.lit(None).cast("boolean")), "same_")).alias("p_", "eq_"))
    by_place, by_sum = Window.partitionBy(*one).orderBy("p_"), Window.partitionBy(*one).orderBy("s_").rangeBetween(Window.unboundedPreceding, 0)
    worth = F.when(F.col("eq_"), SCALE - round(similarity * SCALE)).when(~F.col("eq_"), -round(similarity * SCALE)).otherwise(0)
    tokens = tokens.withColumns({"s_": F.sum(worth).over(by_place), "e_": F.sum(F.coalesce(F.col("eq_").cast("int"), F.lit(0))).over(by_place)})
    runs = tokens.select(*one, "least_", (F.col("p_") - F.min("p_").over(by_sum)).alias("n_"), (F.col("e_") - F.min("e_").over(by_sum)).alias("e_"))
    return runs.filter(F.col("n_") >= F.col("least_")).select("k_", "t_", "item_", F.col("n_").cast("long").alias("n_"), F.col("e_").cast("long").alias("e_"))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``key, item, n_overlap, n_equal``: the best overlap of each text and benchmark item that agree.

    Of the longest runs that end at each place, the best one has most equal tokens, then fewest in all. ``min_tokens`` is
    lowered to an item's length where that is less.
    """
    runs = _overlaps(docs, benchmark, key, text, item, item_text, masks, similarity, min_tokens)
    best = runs.groupBy("k_", "item_").agg(F.max(F.struct("e_", (-F.col("n_")).alias("m_"))).alias("best_"))
    return best.select(F.col("k_").alias(key), F.col("item_").alias(item), (-F.col("best_.m_")).alias("n_overlap"), F.col("best_.e_").alias("n_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item."""
    k, t = fresh(docs, "hit_key"), fresh(docs, "hit_text")
    runs = _overlaps(docs, benchmark, key, text, item, item_text, masks, similarity, min_tokens)
    hits = cut(runs.select(F.col("k_").alias(k), F.col("t_").alias(t)).distinct())
    if fits(hits, BROADCAST_IDS):  # else texts are shuffled once
        hits = F.broadcast(hits)
    return docs.join(hits, F.col(key).eqNullSafe(F.col(k)) & (text_hash(F.col(text)) == F.col(t)), "left_anti")


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_seed(mask: str, number: int) -> str:
    return f"'{number}'" + "".join(f" || ' ' || w[i + {k}]" for k, c in enumerate(mask) if c == "1")


def _sql_seeds(source: str, own: str, least: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT {own}, i, {_sql_seed(m, k)} AS seed FROM (SELECT {own}, w, unnest(range(1, len(w) - {len(m) - 2})) AS i FROM {source} WHERE len(w) >= {max(len(m), least)})" for k, m in enumerate(MASKS))


_SQL_TOKENS = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_EQUAL, _OTHER = SCALE - round(SIMILARITY * SCALE), round(SIMILARITY * SCALE)
OP2_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_TOKENS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_TOKENS} AS w FROM benchmark),
ds AS ({_sql_seeds("d", "r")}), bs AS ({_sql_seeds("b", "item_id", MASKED_FROM)}),
few AS (SELECT item_id, array_to_string(w, ' ') AS t, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {MASKED_FROM - 1}),
hit AS (
  SELECT DISTINCT r, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)
  UNION SELECT r, item_id, i - 1 FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM few) WHERE len(w) >= n)) JOIN few USING (n, t)
),
laid AS (
  SELECT r, doc_id, item_id, shift, least({MIN_TOKENS}, len(b.w)) AS least_, d.w[greatest(shift, 0) + 1 : least(len(d.w), len(b.w) + shift)] AS x, b.w[greatest(-shift, 0) + 1 : least(len(b.w), len(d.w) - shift)] AS y
  FROM hit JOIN d USING (r) JOIN b USING (item_id)
), token AS (
  SELECT r, doc_id, item_id, shift, least_, p, CASE WHEN p = 0 THEN 0 WHEN x[p] = y[p] THEN 1 ELSE 0 END AS eq
  FROM (SELECT *, unnest(range(0, len(x) + 1)) AS p FROM laid WHERE len(x) >= least_)
), summed AS (
  SELECT *, sum(CASE WHEN p = 0 THEN 0 WHEN eq = 1 THEN {_EQUAL} ELSE -{_OTHER} END) OVER w AS s, sum(eq) OVER w AS e FROM token WINDOW w AS (PARTITION BY r, item_id, shift ORDER BY p)
), run AS (
  SELECT doc_id, item_id, least_, p - min(p) OVER w AS n_overlap, e - min(e) OVER w AS n_equal
  FROM summed WINDOW w AS (PARTITION BY r, item_id, shift ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, item_id, CAST(n_overlap AS BIGINT) AS n_overlap, CAST(n_equal AS BIGINT) AS n_equal FROM run
WHERE n_overlap >= least_
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_overlap) = 1
"""
