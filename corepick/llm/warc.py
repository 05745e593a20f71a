"""Derivatives of web archive responses: linked metadata and plain-text conversion records.

Each response gives two records. Both name it in ``WARC-Refers-To`` and carry its target, date and payload digest; the
metadata record lists what was found in the page and every header line of the source, the conversion record holds the text.
A record id is a UUID made from what the record is derived from, so a task that is run again writes the same ids.
:func:`write_warc` writes records that readers of the format accept: the header lines, an empty line, the block, and two line
ends.

Pages are read by one scan whose time is in proportion to the page. A comment, script or style without an end runs to the end
of the page, as in browsers; a head, title, noscript or template without an end hides nothing; a ``<`` without a later ``>``
is text. Links count where they are visible.

Nothing is shuffled. Nulls: a null body is an empty one, a null target leaves its header out, a null date is that of
:func:`derive`, null source headers are none. Repeated rows give equal records, and nothing depends on an order, so there are
no ties. Extra columns of the responses are dropped except those listed in ``keep``. An empty table gives no records. Very
long pages are worked on whole.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corepick.llm.common import table

#: What the query gives as the date of its records, since ``pages`` has none.
DATE = "2024-01-01T00:00:00Z"

# Elements of the page whose tags end a line.
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
TO_THE_END = frozenset(("script", "style"))
MARKUP = re.compile(r"<(?:!--|!|(/?)([a-z][a-z0-9]*))", re.I)
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "noscript", "template", "title")}
HEAD_END = re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)
TAGS = re.compile(r"</?[a-z][^<>]*>", re.I)
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n[ \n]*")
LANG = re.compile(r"[\s\"'/]lang\s*=\s*[\"']?([\w-]+)", re.I)
LINK = re.compile(r"[\s\"'/]href\s*=", re.I)
STATUS = re.compile(r"HTTP/[0-9.]+[ \t]")
BLANK = re.compile(r"\s")
ENDS_OF_LINES = re.compile(r"[\r\n]+")
FOLDS = re.compile(r"\r?\n[ \t]+")
ZEROS = re.compile(r"&#0+(?=\d)")
LONG_NUMBERS = re.compile(r"&#(\d{8})\d+")


def unescape(text: str) -> str:
    """Character references resolved; numbers too long to be a character are cut first, as Python refuses the longest."""
    return html.unescape(LONG_NUMBERS.sub(r"&#\1", ZEROS.sub("&#", text)) if "&#" in text else text)


def page_facts(body: str) -> tuple[str, str, str, int]:
    """Title, language and text of a page, and how many links it has."""
    out, title, lang, links = [], None, "", 0
    at, head_end, endless = 0, 0, set()
    while m := MARKUP.search(body, at):
        start, name = m.start(), (m[2] or "").lower()
        if start >= head_end:
            out.append(body[max(at, head_end) : start])
        comment = body.startswith("<!--", start)
        end = body.find("-->", start + 4) if comment else body.find(">", m.end())
        if end < 0:
            if not comment:
                at = start
                break  # no tag can end any more
            at = len(body)
            break
        at = end + (3 if comment else 1)
        if not name:
            out.append(" ")
        elif name in BREAKS:
            out.append("\n")
        elif m[1]:
            continue
        elif name == "a":
            links += start >= head_end and LINK.search(body, m.end(), end) is not None
        elif name == "html":
            found = None if lang else LANG.search(body, m.end(), end)
            lang = found[1] if found else lang
        elif name == "head":
            if start >= head_end and name not in endless:
                found = HEAD_END.search(body, at)
                head_end = found.start() if found else head_end
                endless |= set() if found else {name}
                out.append(" ")
        elif name in ENDS and name not in endless:
            found = ENDS[name].search(body, at)
            if found is None:
                endless.add(name)
                if name in TO_THE_END:
                    at = len(body)
                    break
                continue
            if name == "title" and title is None:
                title = body[at : found.start()]
            end = body.find(">", found.end())
            at = end + 1 if end >= 0 else len(body)
            out.append(" ")
    out.append(body[max(at, head_end) :])
    text = LINES.sub("\n", BLANKS.sub(" ", unescape("".join(out)))).strip()
    return " ".join(unescape(TAGS.sub("", title or "")).split()), lang, text, links


def source_fields(headers: str) -> str:
    """A ``source-`` field for the status line and for each header line, in their order; folded lines are made one, and lines
    without a name are left as ``source-line``."""
    out = []
    for line in filter(str.strip, ENDS_OF_LINES.split(FOLDS.sub(" ", headers))):
        name, colon, value = line.partition(":")
        name = name.rstrip(" \t")
        if STATUS.match(line):
            out.append(f"source-status: {line}\r\n")
        elif colon and name and not BLANK.search(name):
            out.append(f"source-{name.lower()}: {value.strip()}\r\n")
        else:
            out.append(f"source-line: {line}\r\n")
    return "".join(out)


def _facts(bodies: pa.Array, headers: pa.Array) -> pa.Array:
    rows = [(*page_facts(b.as_py() or ""), source_fields(h.as_py() or "")) for b, h in zip(bodies, headers)]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, ["title", "lang", "text", "links", "source"])


def sha1_label(data: Column) -> Column:
    """``sha1:`` and the digest in base 32, as is customary in web archives."""
    digest = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def uuid_of(*parts: Column) -> Column:
    hexed = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cuts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses_of(pages: DataFrame, date: str | None = None, key: str = "page_id", url: str = "url", body: str = "html", headers: str | None = None) -> DataFrame:
    """Response records (``key, record_id, target_uri, date, http_headers, payload``) of a table of pages. ``headers`` names
    the column with a response's status line and header lines; without it they are made from the body."""
    payload = F.coalesce(F.col(body), F.lit(""))
    made = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    source = F.col(headers) if headers else made
    identity = uuid_of(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.md5(payload.cast("binary")))
    return pages.select(F.col(key), identity.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).cast("string").alias("date"), source.alias("http_headers"), payload.alias("payload"))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line ends within the value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " "), F.lit("\r\n")), F.lit(""))


def derive(responses: DataFrame, keep: tuple[str, ...] = (), date: str = DATE) -> DataFrame:
    """Two records per response: ``keep``, ``record_type, record_id, refers_to, target_uri, date, source_digest, block_digest,
    content_length, header, block``. ``date`` is that of records whose response has none, as each record must have one."""
    facts = F.arrow_udf(_facts, "title string, lang string, text string, links long, source string")
    r = responses.select(*keep, "record_id", "target_uri", F.coalesce("date", F.lit(date)).alias("date"), sha1_label(F.coalesce("payload", F.lit(""))).alias("source_digest"), facts("payload", "http_headers").alias("f"))
    fields = F.concat(
        header("title", F.col("f.title")),
        header("language", F.when(F.col("f.lang") != "", F.col("f.lang"))),
        header("outlinks", F.col("f.links")),
        header("text-bytes", F.octet_length("f.text")),
        F.col("f.source"),
        header("source-payload-digest", F.col("source_digest")),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("f.text").alias("block")),
    )
    out = r.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", F.explode(kinds).alias("d")).select("*", "d.*").drop("d")
    out = out.withColumns({"record_id": uuid_of(F.col("record_type"), F.col("refers_to")), "block_digest": sha1_label(F.col("block")), "content_length": F.octet_length("block").cast("long")})
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Refers-To", F.col("refers_to")),
        header("WARC-Target-URI", F.col("target_uri")),
        header("WARC-Date", F.col("date")),
        header("WARC-Source-Payload-Digest", F.col("source_digest")),
        header("WARC-Block-Digest", F.col("block_digest")),
        header("Content-Type", F.col("content_type")),
        header("Content-Length", F.col("content_length")),
    )
    return out.withColumn("header", head).select(*keep, "record_type", "record_id", "refers_to", "target_uri", "date", "source_digest", "block_digest", "content_length", "header", "block")


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``header`` and ``block`` of records as WARC files, one a partition, by Spark's text writer."""
    records.select(F.concat("header", F.lit("\r\n"), "block", F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = derive(responses_of(table(spark, sf_dir, "pages"), DATE), keep=("page_id",))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2("header", 256).alias("header_sha256"), F.sha2("block", 256).alias("block_sha256"))
