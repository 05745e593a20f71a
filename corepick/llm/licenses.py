"""Licence scan by lookup of canonical digests.

A text is made canonical: lower case, copyright lines taken out, everything but letters and digits made a blank, equivalent
spellings made one. So neither line ends nor comment signs at their beginning matter. A copyright line begins with
"copyright", "(c)" or the sign and goes on with a year, a sign or a name; a line of the licence itself that a wrap lets begin
with "copyright holders" and the like stays. A notice that goes on in the next line is taken out only as far as the first.
The SHA-256 of that is joined by hash to the digests of known licence texts and notices, made the same way. The whole
document is looked up, and each of its lines as a text of its own, which finds one-line notices. :func:`read_known` takes a
folder of licence texts where :data:`KNOWN` is not enough.

The known digests are broadcast; their number is that of ``known`` (checked against ``BROADCAST_ROWS``, joined by a shuffle
beyond that). Nulls: a null text is empty, and empty texts match nothing; a null id stays. Ties: of licences with one digest
the least name is given. Rows equal in id and text get equal results. Extra columns are ignored, whatever their names. An
empty table gives no rows. Very long texts are worked on whole, by expressions of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import fits, table

BROADCAST_ROWS = 100_000

# Published licence texts and customary notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Each pattern stands for its equivalent, over words with one blank between them.
SPELLINGS = (
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("non commercial", "noncommercial"),
    ("https ", "http "),
    ("copyright owner", "copyright holder"),
    ("gnu gpl", "gnu general public license"),
)
#: A line that begins like a copyright notice,
COPYRIGHT = "^[^a-z0-9]*(copyright|©|\\(c\\)[^a-z]*[0-9]{4}|\\(c\\)[^a-z]*copyright|all rights reserved)"
#: and how a wrapped line of a licence may begin instead.
OF_THE_TEXT = "^[^a-z0-9]*copyright[^a-z0-9©]*$|^[^a-z0-9]*copyright[^a-z0-9(©]+(and|for|holders?|in|interests?|is|laws?|licen[cs]es?|notices?|of|or|owners?|statements?|to)([^a-z]|$)"


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~x.rlike(COPYRIGHT) | x.rlike(OF_THE_TEXT))
    out = F.regexp_replace(F.array_join(lines, "\n"), "[^\\p{L}\\p{N}]+", " ")
    for pattern, one in SPELLINGS:
        out = F.replace(out, F.lit(pattern), F.lit(one))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", digest(F.col("text")).alias("digest_")).groupBy("digest_").agg(F.min("license").alias("license"))


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """The digests of the licence texts in a folder, one a file; a file's name without ``.txt`` is its licence."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:[.]txt)?$", 1).alias("license"), digest(F.col("value")).alias("digest_"))
    return rows.groupBy("digest_").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, digest, license`` (of the whole text, or null), ``n_license_lines, line_licenses``."""
    known = F.broadcast(known) if fits(known, BROADCAST_ROWS) else known
    rows = docs.select(F.col(key).alias("k_"), F.xxhash64(F.col(text)).alias("x_"), F.col(text).alias("t_"))
    whole = rows.select("k_", "x_", digest(F.col("t_")).alias("digest")).join(known, F.col("digest") == F.col("digest_"), "left").drop("digest_")
    lines = rows.select("k_", "x_", F.posexplode(F.split(F.coalesce("t_", F.lit("")), "\n")).alias("line_", "s_"))
    found = lines.select("k_", "x_", "line_", digest(F.col("s_")).alias("d_")).join(known, F.col("d_") == F.col("digest_"))
    found = found.groupBy(F.col("k_").alias("k_f"), F.col("x_").alias("x_f")).agg(F.count_distinct("line_").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("all"))
    out = whole.join(found, F.col("k_").eqNullSafe(F.col("k_f")) & (F.col("x_") == F.col("x_f")), "left")
    return out.select(F.col("k_").alias(key), "digest", "license", F.coalesce("n", F.lit(0).cast("long")).alias("n_license_lines"), F.coalesce("all", F.lit("")).alias("line_licenses"))


def op4_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql_canonical(text: str) -> str:
    keeps = f"NOT regexp_matches(x, '{COPYRIGHT}') OR regexp_matches(x, '{OF_THE_TEXT}')"
    out = f"array_to_string(list_filter(string_split(lower(coalesce({text}, '')), chr(10)), lambda x: {keeps}), chr(10))"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for pattern, one in SPELLINGS:
        out = f"replace({out}, '{pattern}', '{one}')"
    return f"trim({out})"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
OP4_SQL = f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_sql_canonical("t")}) AS digest FROM (VALUES {_VALUES}) v(license, t)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM documents),
l AS (SELECT r, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM d),
f AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS all_ FROM (SELECT r, sha256({_sql_canonical("s")}) AS digest FROM l) JOIN k USING (digest) GROUP BY r)
SELECT doc_id, digest, license, coalesce(f.n, 0) AS n_license_lines, coalesce(all_, '') AS line_licenses FROM d LEFT JOIN k USING (digest) LEFT JOIN f USING (r)
"""
