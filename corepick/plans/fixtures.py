"""Views that the queries work on, derived from the given tables in Spark and, the same way, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.functions.vectors import softmax
from corepick.operators.dynamics import confidence_stats, el2n_scores, epoch_metrics

RATIOS = [0.02, 0.05]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("vec_id") % 5 == 4, "test").when(F.col("vec_id") % 5 == 3, "val").otherwise("train")
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), split.alias("split"))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    raw = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), ((F.col("vec_id") * 7919) % 1009).cast("double").alias("importance"))
    from corepick.functions.scores import min_max_normalize

    return min_max_normalize(raw, "importance")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("epoch"))
    e, i = F.col("epoch"), F.col("id")
    rising = F.log(1 + e) * (0.3 + (i % 7) / 10.0)
    logit = lambda c: 4 * F.get("v", c) + F.when(c == F.col("label"), rising).otherwise(0.0) + 0.8 * F.sin((e * (i % 13 + 1) + c).cast("double"))
    return rows.withColumn("logits", F.transform(F.sequence(F.lit(0), F.lit(9)), logit)).withColumn("probs", softmax(F.col("logits"))).drop("v")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return epoch_metrics(predictions(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """``id, label, el2n, conf_var, conf_mean``"""
    m = metrics(spark, sf)
    return el2n_scores(m).withColumnRenamed("score", "el2n").join(confidence_stats(m).drop("label"), "id")


def results(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return read(spark, sf, "events").select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.col("event_type").alias("dataset"),
        pick(e, "none", "uni", "conch").alias("embedding"),
        pick(F.floor(e / 3), "random", "facility", "graph_a2", "herding").alias("method"),
        pick(F.floor(e / 12), 0.02, 0.05).alias("ratio"),
        (F.floor(e / 24) % 3).cast("long").alias("trial"),
        ((e * 7919) % 1000 / 1000.0).alias("accuracy"),
        ((e * 104729) % 1000 / 1000.0).alias("balanced_accuracy"),
        F.col("value").alias("seconds"),
        (F.floor(e / 72) % 50 * 10).cast("long").alias("step"),
    )


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """Three configurations that each take some of the pool."""
    s = samples(spark, sf).select("id", "label")
    part = lambda name, n: s.filter(F.col("id") % n == 0).select(F.lit(name).alias("config"), "id", "label", (F.floor(F.col("id") / n) + 1).cast("int").alias("rank"))
    return part("a", 3).union(part("b", 5)).union(part("c", 6))


# ------------------------------------------------------------------------------------------------------------ SQL

SAMPLES = "samples AS MATERIALIZED (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 5 = 4 THEN 'test' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'train' END AS split FROM embeddings)"
UNITS = SAMPLES + ", normed AS (SELECT *, sqrt(list_dot_product(v, v)) AS nrm FROM samples), units AS MATERIALIZED (SELECT id, label, split, list_transform(v, lambda x: x / CASE WHEN nrm = 0 THEN 1 ELSE nrm END) AS u FROM normed)"
IMPORTANCE = "raw_imp AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST((vec_id * 7919) % 1009 AS DOUBLE) AS x FROM embeddings), importance AS MATERIALIZED (SELECT id, label, CASE WHEN (SELECT max(x) - min(x) FROM raw_imp) <= 1e-8 THEN 1.0 ELSE (x - (SELECT min(x) FROM raw_imp)) / (SELECT max(x) - min(x) FROM raw_imp) END AS importance FROM raw_imp)"
PREDICTIONS = """epochs AS (SELECT unnest(range(1, 31)) AS epoch), logit AS MATERIALIZED (
  SELECT vec_id AS id, CAST(label AS BIGINT) AS label, epoch, list_transform(range(0, 10), lambda c: 4 * CAST(embedding[c + 1] AS DOUBLE) + CASE WHEN c = label THEN ln(1 + epoch) * (0.3::DOUBLE + (vec_id % 7) / 10.0::DOUBLE) ELSE 0 END + 0.8::DOUBLE * sin(epoch * (vec_id % 13 + 1) + c)) AS logits FROM embeddings, epochs
), raised AS (SELECT *, list_max(logits) AS top FROM logit), raised2 AS (SELECT *, list_transform(logits, lambda x: exp(x - top)) AS ex FROM raised), raised3 AS (SELECT *, list_sum(ex) AS total FROM raised2),
predictions AS MATERIALIZED (SELECT id, label, epoch, logits, list_transform(ex, lambda x: x / total) AS probs FROM raised3),
metrics AS MATERIALIZED (SELECT id, epoch, label, sqrt(list_sum(list_transform(probs, lambda p, i: pow(p - CASE WHEN i = label + 1 THEN 1 ELSE 0 END, 2)))) AS l2, probs[label + 1] - list_max(list_filter(probs, lambda p, i: i <> label + 1)) AS margin, list_position(logits, list_max(logits)) - 1 = label AS correct, probs[label + 1] AS confidence FROM predictions)"""
SCORED = PREDICTIONS + ", scored AS MATERIALIZED (SELECT id, label, avg(l2) FILTER (epoch <= 20) AS el2n, var_pop(confidence) FILTER (epoch BETWEEN 11 AND 20) AS conf_var, avg(confidence) FILTER (epoch BETWEEN 11 AND 20) AS conf_mean FROM metrics GROUP BY id, label)"
RESULTS = "results AS MATERIALIZED (SELECT 'run' || (user_id % 3) AS run_id, event_type AS dataset, ['none', 'uni', 'conch'][event_id % 3 + 1] AS embedding, ['random', 'facility', 'graph_a2', 'herding'][event_id // 3 % 4 + 1] AS method, [0.02::DOUBLE, 0.05::DOUBLE][event_id // 12 % 2 + 1] AS ratio, event_id // 24 % 3 AS trial, (event_id * 7919) % 1000 / 1000.0::DOUBLE AS accuracy, (event_id * 104729) % 1000 / 1000.0::DOUBLE AS balanced_accuracy, value AS seconds, event_id // 72 % 50 * 10 AS step FROM events)"
SELECTIONS = SAMPLES + ", selections AS MATERIALIZED (SELECT 'a' AS config, id, label, CAST(id // 3 + 1 AS INTEGER) AS rank FROM samples WHERE id % 3 = 0 UNION ALL SELECT 'b', id, label, CAST(id // 5 + 1 AS INTEGER) FROM samples WHERE id % 5 = 0 UNION ALL SELECT 'c', id, label, CAST(id // 6 + 1 AS INTEGER) FROM samples WHERE id % 6 = 0)"


def knn_sql(k: int, by_label: bool = False, base: str | None = None) -> str:
    dist = "2 * (1 - list_dot_product(a.u, b.u))"
    on = "a.id <> b.id" + (" AND a.label = b.label" if by_label else "")
    return (base or UNITS) + f", knn AS MATERIALIZED (SELECT src, dst, rank, dist FROM (SELECT a.id AS src, b.id AS dst, {dist} AS dist, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS INTEGER) AS rank FROM units a JOIN units b ON {on}) WHERE rank <= {k})"


ADJ = ", adj AS MATERIALIZED (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, greatest(0, least(1, 1 - dist / 2)) AS w FROM knn UNION ALL SELECT dst, src, greatest(0, least(1, 1 - dist / 2)) FROM knn) GROUP BY src, dst HAVING max(w) > 0)"
SYM = ADJ + ", deg AS (SELECT src, sum(w) AS d FROM adj GROUP BY src), sym AS MATERIALIZED (SELECT a.src, a.dst, a.w / sqrt(x.d * y.d) AS w FROM adj a JOIN deg x ON a.src = x.src JOIN deg y ON a.dst = y.src)"
TRANSITION = ADJ + ", deg AS (SELECT src, sum(w) AS d FROM adj GROUP BY src), tr AS MATERIALIZED (SELECT a.src, a.dst, a.w / d AS w FROM adj a JOIN deg USING (src) WHERE d <> 0)"


def powers_sql(base: str, n: int, name: str = "p") -> str:
    out = f", {name}1 AS MATERIALIZED (SELECT src, dst, w FROM {base})"
    for i in range(2, n + 1):
        out += f", {name}{i} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM {name}{i - 1} a JOIN {base} b ON a.dst = b.src GROUP BY a.src, b.dst)"
    return out


def power_sum_sql(h: int) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, h + 1))
    return SYM + powers_sql("sym", h) + f", kern AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM ({union}) GROUP BY src, dst)"


def heat_sql(t: float = 1.0, terms: int = 12) -> str:
    import math

    union = " UNION ALL ".join(f"SELECT src, dst, w * {math.exp(-t) * t**i / math.factorial(i)!r}::DOUBLE AS w FROM p{i}" for i in range(1, terms + 1))
    return SYM + powers_sql("sym", terms) + f", kern AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT id AS src, id AS dst, {math.exp(-t)!r}::DOUBLE AS w FROM samples UNION ALL {union}) GROUP BY src, dst)"


def reach_sql(walk: int = 5, gamma: float = 0.85) -> str:
    union = " UNION ALL ".join(f"SELECT src, dst, w * {gamma**i!r}::DOUBLE AS w FROM p{i}" for i in range(1, walk + 1))
    return TRANSITION + powers_sql("tr", walk) + f", reach AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT id AS src, id AS dst, 1.0::DOUBLE AS w FROM samples UNION ALL {union}) GROUP BY src, dst)"


def hops_sql(h: int) -> str:
    out = ", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn) WHERE src <> dst), h1 AS MATERIALIZED (SELECT * FROM e)"
    for i in range(2, h + 1):
        out += f", h{i} AS MATERIALIZED (SELECT DISTINCT a.src, b.dst FROM h{i - 1} a JOIN e b ON a.dst = b.src)"
    union = " UNION ".join(f"SELECT * FROM h{i}" for i in range(1, h + 1))
    return out + f", hop AS MATERIALIZED ({union})"


def greedy_sql(base: str, budget: int, per_class: bool, gain: str = "greatest(k.w - s.cov, 0)", after: str = "greatest(st.cov, coalesce(k.w, 0))", start: float = 0.0, kernel: str = "kern", imp: str = "SELECT id, label, 1.0::DOUBLE AS imp FROM samples") -> str:
    """``id, label, rank`` of plain greedy; ``kernel(src, dst, w)``: candidate ``src`` does ``w`` for row ``dst``."""
    order = "ORDER BY coalesce(g.gain, 0) DESC, f.id"
    pick = f"SELECT f.id, f.label FROM free f LEFT JOIN g ON g.id = f.id QUALIFY row_number() OVER ({'PARTITION BY f.label ' if per_class else ''}{order}) = 1"
    join = "LEFT JOIN p ON p.label = st.label" if per_class else "CROSS JOIN p"
    stop = f"st.it < {budget} AND" if per_class else ""
    return f"""WITH RECURSIVE {base}, nodes AS MATERIALIZED ({imp}), walk(it, id, label, imp, cov, rk) AS (
  SELECT 0, id, label, imp, {start}::DOUBLE, 0 FROM nodes
  UNION ALL
  (WITH st AS (SELECT * FROM walk), g AS (SELECT k.src AS id, sum(s.imp * {gain}) AS gain FROM {kernel} k JOIN st s ON k.dst = s.id GROUP BY k.src),
   full_ AS (SELECT label FROM st GROUP BY label HAVING count(*) FILTER (rk > 0) >= {budget}),
   free AS (SELECT id, label FROM st WHERE rk = 0 AND label NOT IN (SELECT label FROM full_)), p AS ({pick})
   SELECT st.it + 1, st.id, st.label, st.imp, {after}, CASE WHEN st.id = p.id THEN st.it + 1 ELSE st.rk END
   FROM st {join} LEFT JOIN {kernel} k ON k.src = p.id AND k.dst = st.id WHERE {stop} true)
) SELECT id, label, CAST(rk AS INTEGER) AS rank FROM walk WHERE rk > 0 AND it = (SELECT max(it) FROM walk)"""


def fps_sql(base: str, budget: int, distance: str, join: str, pool: str = "SELECT id, label FROM samples", seed: int = 42, offset: int = 0, head: str = "") -> str:
    """Farthest points per class; ``distance`` between row ``st`` and pick ``p`` over ``join``."""
    return f"""WITH RECURSIVE {base}, pool AS MATERIALIZED ({pool}), walk(it, id, label, d, rk) AS (
  SELECT 1, id, label, CAST('inf' AS DOUBLE), CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{seed}', CAST(id AS VARCHAR))), id) = 1 THEN 1 ELSE 0 END FROM pool
  UNION ALL
  (WITH st0 AS (SELECT * FROM walk), p AS (SELECT id, label FROM st0 WHERE rk = it),
   st AS (SELECT st.it, st.id, st.label, st.rk, least(st.d, coalesce({distance}, st.d)) AS d FROM st0 st LEFT JOIN p ON p.label = st.label {join}),
   n AS (SELECT id FROM st WHERE rk = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, id) = 1)
   SELECT st.it + 1, st.id, st.label, st.d, CASE WHEN st.id IN (SELECT id FROM n) THEN st.it + 1 ELSE st.rk END FROM st WHERE st.it < {budget})
) {head}SELECT id, label, CAST(rk + {offset} AS INTEGER) AS rank FROM walk WHERE rk > 0 AND it = {budget}"""
