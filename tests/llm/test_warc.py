import base64
import hashlib
import time
import uuid
from html.parser import HTMLParser

from corepick.llm import warc
from tests.llm.helpers import SF

BLOCKS = "address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split()


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links, self.title, self.in_title, self.lang = [], 0, 0, "", False, ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.links += tag == "a" and "href" in a
        self.lang = a.get("lang", "") if tag == "html" else self.lang
        self.in_title = tag == "title" or self.in_title
        self.hidden += tag in ("script", "style", "head")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        self.hidden -= tag in ("script", "style", "head")
        if tag in ("script", "style", "head"):
            self.out.append(" ")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(data)


def plain(body):
    p = Plain()
    p.feed(body)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return " ".join(p.title.split()), p.lang, "\n".join(x for x in lines if x), p.links


def test_pages_equal_a_parser(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert warc.page_facts(r.html) == plain(r.html), r.page_id


def test_records_are_linked_and_readable(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<html lang=de><title>T &amp; t</title><p>Ünder\r\n<a href=x>li</a>nk"), (1, "http://a/\r\nX: y", "<html lang=de><title>T &amp; t</title><p>Ünder\r\n<a href=x>li</a>nk"), (None, None, None), (3, "u", ""), (4, "v", "x" * 300000)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, header string")
    responses = warc.responses_of(df, date="2024-01-01T00:00:00Z")
    records = warc.derive(responses, keep=("page_id",))
    rows = records.collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    source = {r.record_id: r for r in responses.collect()}
    for r in rows:
        body = source[r.refers_to].payload
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header and "\r\nX: y" not in r.header
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "Ünder\nlink"
    meta = next(r for r in rows if r.page_id == 1 and r.record_type == "metadata")
    assert meta.block.startswith("title: T & t\r\nlanguage: de\r\noutlinks: 1\r\n")
    warc.write_warc(records.coalesce(1), f"{tmp_path}/out")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    seen = 0
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and raw[n : n + 4] == b"\r\n\r\n"
        raw, seen = raw[n + 4 :], seen + 1
    assert seen == 10


def test_hostile_pages():
    facts = warc.page_facts
    assert facts("a <script>hi\nvar x=1;")[2] == "a" and facts("a <!-- b <p>c")[2] == "a"
    assert facts("<head><title>t<p>body") == ("", "", "t\nbody", 0)
    assert facts("1 < 2 <b and")[2] == "1 < 2 <b and"
    assert facts("<head><title>T</title><meta><body>x")[:3] == ("T", "", "x")
    assert facts("<a href=x>1</a><!-- <a href=y> --><noscript><a href=z>2</a></noscript>")[2:] == ("1", 1)
    assert facts("&#" + "9" * 6000 + "; &#" + "0" * 6000 + "65;")[2] == "\ufffd A"
    for piece in ("<!--", "<script", "<script>", "</script ", "<title>", "<head>", "<", "<a ", "<noscript>", "&#", "<title></title ", "\n ", "<p>"):
        start = time.time()
        facts(piece * 200_000)
        assert time.time() - start < 5, piece


def test_source_headers(spark):
    lines = "HTTP/1.1 404 Not Found\r\nServer: x\r\nX-Long: a\r\n\tb\r\nSet-Cookie: 1=2\r\nset-cookie: c: d\r\nodd line\r\n\r\n"
    df = spark.createDataFrame([(1, "u", "b", lines), (2, "u", "b", None)], "page_id long, url string, html string, h string")
    rows = warc.derive(warc.responses_of(df, headers="h"), keep=("page_id",)).filter("record_type = 'metadata'").collect()
    block = {r.page_id: r.block for r in rows}
    want = "source-status: HTTP/1.1 404 Not Found\r\nsource-server: x\r\nsource-x-long: a b\r\nsource-set-cookie: 1=2\r\nsource-set-cookie: c: d\r\nsource-line: odd line\r\n"
    assert block[1].split("text-bytes: 1\r\n")[1].split("source-payload")[0] == want
    assert block[2].split("text-bytes: 1\r\n")[1].startswith("source-payload")
    assert all(f"WARC-Date: {warc.DATE}\r\n" in r.header for r in rows)


def test_query_equals_plain_python(spark):
    label = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda *parts: f"<urn:uuid:{uuid.UUID(hashlib.md5(chr(10).join(parts).encode()).hexdigest())}>"
    want = set()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = (r.html or "").encode()
        source = name("response", str(r.page_id), r.url, hashlib.md5(body).hexdigest())
        title, lang, text, links = plain(r.html or "")
        fields = [f"title: {title}", *([f"language: {lang}"] if lang else []), f"outlinks: {links}", f"text-bytes: {len(text.encode())}", "source-status: HTTP/1.1 200 OK"]
        fields += ["source-content-type: text/html; charset=utf-8", f"source-content-length: {len(body)}", f"source-payload-digest: {label(body)}"]
        for kind, content, block in (("metadata", "application/warc-fields", "".join(f + "\r\n" for f in fields).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
            head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(kind, source)}", f"WARC-Refers-To: {source}", f"WARC-Target-URI: {r.url}", f"WARC-Date: {warc.DATE}"]
            head += [f"WARC-Source-Payload-Digest: {label(body)}", f"WARC-Block-Digest: {label(block)}", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
            digest = hashlib.sha256("".join(h + "\r\n" for h in head).encode()).hexdigest()
            want.add((r.page_id, kind, name(kind, source), source, r.url, label(body), label(block), len(block), digest, hashlib.sha256(block).hexdigest()))
    assert {tuple(r) for r in warc.op9_warc_derivatives(spark, SF).collect()} == want


def test_query_and_empty_table(spark, tmp_path):
    assert warc.op9_warc_derivatives(spark, SF).count() == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op9_warc_derivatives(spark, str(tmp_path)).count() == 0
