"""Queries of sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corepick.operators.runtime import cut
from corepick.plans import fixtures as x
from corepick.plans.registry import query
from corepick.sources import artifacts, results, samples


def scratch(spark) -> str:
    """A folder of its own below the shared checkpoint folder."""
    cut(spark.range(0))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables-{uuid.uuid4().hex}"


@query("s1_read_samples", f"WITH {x.SAMPLES} SELECT id, label FROM samples WHERE split = 'val'")
def _(s, sf):
    path = f"{scratch(s)}/samples"
    x.samples(s, sf).write.partitionBy("split").parquet(path)
    return samples.read_samples(s, path, "val").select("id", "label")


@query("s2_normalize_labels", "SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings")
def _(s, sf):
    return samples.normalize_labels(x.read(s, sf, "embeddings").select(F.col("vec_id").alias("id"), F.array("label").alias("label")))


@query("s3_load_or_compute", f"WITH {x.SAMPLES} SELECT label, count(*) AS n FROM samples GROUP BY label")
def _(s, sf):
    base, key = scratch(s), {"kind": "embeddings", "dataset": "given", "split": "train"}
    samples.load_or_compute(s, base, key, lambda: x.samples(s, sf))
    again = samples.load_or_compute(s, base, key, lambda: x.samples(s, sf).limit(0))
    return again.groupBy("label").agg(F.count("*").alias("n"))


_DIGEST = f"WITH {x.SELECTIONS} SELECT config, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY rank, id)) AS digest FROM selections GROUP BY config"


@query("s4_selection_digest", _DIGEST)
def _(s, sf):
    return artifacts.digest_of(x.selections(s, sf), ("config",))


def _config(name: str) -> dict:
    return {"dataset": "given", "ratio_bp": "r0500bp", "method": name, "embedding": "base", "seed": 42, "trial": 1}


@query("s5_read_selection", f"WITH {x.SELECTIONS} SELECT id, label, rank FROM selections WHERE config = 'b'")
def _(s, sf):
    base, part = scratch(s), x.selections(s, sf).filter("config = 'b'")
    manifest = artifacts.write_selection(part, base, _config("b"))
    return artifacts.read_selection(s, base, _config("b"), manifest.first().digest)


@query("s6_verify_selections", f"WITH {x.SELECTIONS} SELECT config, CASE config WHEN 'a' THEN 'ok' WHEN 'b' THEN 'count' ELSE 'unlisted' END AS status FROM selections GROUP BY config")
def _(s, sf):
    v = x.selections(s, sf)
    manifests = artifacts.digest_of(v.filter("config = 'a' OR config = 'b' AND rank > 1"), ("config",))
    return artifacts.verify_selections(v, manifests, ("config",))


@query("s7_append_results", f"WITH {x.RESULTS} SELECT method, accuracy, CAST(NULL AS DOUBLE) AS seconds FROM results WHERE trial = 0 UNION ALL SELECT method, accuracy, seconds FROM results WHERE trial > 0", "accuracy seconds")
def _(s, sf):
    path, r = f"{scratch(s)}/results", x.results(s, sf)
    results.append_results(r.filter("trial = 0").select("method", "accuracy"), path)
    results.append_results(r.filter("trial > 0").select("method", "accuracy", "seconds"), path)
    return results.read_results(s, path).select("method", "accuracy", "seconds")


@query("s8_write_history", f"WITH {x.RESULTS} SELECT method, step, accuracy, CAST(NULL AS DOUBLE) AS seconds FROM results WHERE trial = 0 UNION ALL SELECT method, step, NULL, seconds FROM results WHERE trial = 1 UNION ALL SELECT method, step, accuracy, seconds FROM results WHERE trial = 2", "accuracy seconds")
def _(s, sf):
    path, r = f"{scratch(s)}/history", x.results(s, sf)
    columns = (("method", "step", "accuracy"), ("method", "step", "seconds"), ("method", "step", "accuracy", "seconds"))
    results.write_history([r.filter(f"trial = {n}").select(*c) for n, c in enumerate(columns)], path)
    return s.read.csv(path, header=True, schema="method string, step long, accuracy double, seconds double")


@query("s9_selection_map", f"WITH {x.SELECTIONS} SELECT config, array_to_string(list(id ORDER BY id), ',') AS ids FROM selections GROUP BY config")
def _(s, sf):
    path = f"{scratch(s)}/map"
    results.write_selection_map(x.selections(s, sf), path)
    return s.read.json(path, schema="config string, ids array<long>").select("config", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
