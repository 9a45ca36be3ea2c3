import io
import zipfile

import pytest

from lexigrid.operators import crawling
from lexigrid.plans import flows
from lexigrid.sources import files


WEB = [
    ("http://w.example/", '<a href="/a">a</a><a href="b">b</a><a href="/a#x">a</a><a href="mailto:x@y">m</a><a href="#top">t</a>'),
    ("http://w.example/a", '<a href="/">home</a><a href="/c">c</a><a href="/Files/One.PDF">one</a><a href="http://other.example/z">z</a>'),
    ("http://w.example/b", '<a href="/missing">m</a><a href="/d">d</a><a href="/Files/One.PDF">one</a><a href="/two.docx">two</a>'),
    ("http://w.example/c", '<a href="/d">d</a><a href="./e">e</a>'),
    ("http://w.example/d", '<a href="/three.doc">three</a><a href="/a">a</a>'),
    ("http://w.example/e", '<a href="/b">b</a>'),
]


def docx(paragraphs, cells):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in cells)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p(paragraphs[0])}<w:tbl>{rows}</w:tbl>{''.join(map(p, paragraphs[1:]))}</w:body></w:document>")
    return out.getvalue()


def python_bfs(start, web, max_pages):
    from urllib.parse import urldefrag, urljoin, urlparse
    import re

    seen, queue, out = set(), [start], []
    while queue and len(out) < max_pages:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        out.append(url)
        for href in re.findall(r'href="([^"]*)"', web.get(url, "")):
            if href and not href.startswith(("mailto:", "#")):
                to = urldefrag(urljoin(url, href))[0]
                if urlparse(to).netloc == urlparse(start).netloc and not to.lower().endswith((".pdf", ".doc", ".docx")):
                    queue.append(to)
    return out


@pytest.mark.parametrize("most", [1, 3, 6, 50])
def test_bfs_order(spark, most):
    web = spark.createDataFrame(WEB, "url string, html string")
    crawl = crawling.bfs("http://w.example/", crawling.table_fetcher(web), spark, most, 2)
    assert [r.url for r in crawl.visited.orderBy("ord").collect()] == python_bfs("http://w.example/", dict(WEB), most)


def test_bfs_documents_and_failures(spark):
    web = spark.createDataFrame(WEB, "url string, html string")
    crawl = crawling.bfs("http://w.example/", crawling.table_fetcher(web), spark, 50, 2)
    assert [r.url for r in crawl.documents.orderBy("ord").collect()] == ["http://w.example/Files/One.PDF", "http://w.example/two.docx"]
    assert [r.url for r in crawl.visited.filter("not fetched").collect()] == ["http://w.example/missing"]


def test_crawl_to_chunks(spark, tmp_path):
    pages = [("http://w.example/", '<title>Home</title><a href="/a">a</a>'), ("http://w.example/a", "<h1>A</h1><p>Điều 1. Một</p><p>thân</p>"), ("http://w.example/b", "")]
    web = spark.createDataFrame(pages, "url string, html string")
    counts = flows.crawl(spark, "http://w.example/", crawling.table_fetcher(web), str(tmp_path)).first()
    assert (counts.n_visited, counts.n_fetched, counts.n_documents) == (2, 2, 0)
    rows = files.read_manifest(spark, str(tmp_path / "manifest")).orderBy("ord").collect()
    assert [(r.url, r.local_path, r.title) for r in rows] == [("http://w.example/", "pages/index.txt", "Home"), ("http://w.example/a", "pages/a.txt", "A")]
    chunks = flows.chunk_pages(web.withColumn("ord", crawling.F.monotonically_increasing_id())).orderBy("row_idx").collect()
    assert [(r.article_id, r.text) for r in chunks] == [("PB-1", "PB-1.\nHome\na"), ("Điều 1", "Điều 1. Một\nthân")]


def test_crawl_fetches_documents(spark, tmp_path):
    pages = [("http://w.example/", '<title>Home</title><a href="/d/One.PDF">1</a><a href="/a">a</a><a href="/gone.pdf">g</a>'), ("http://w.example/a", '<h1>A</h1><a href="/two.docx">2</a><a href="/d/One.PDF">1</a>')]
    web = spark.createDataFrame(pages, "url string, html string")
    data = [("http://w.example/d/One.PDF", b"%PDF"), ("http://w.example/two.docx", docx(["one", "two"], [["c"]])), ("http://w.example/gone.pdf", None)]
    known = spark.createDataFrame(data, "url string, content binary")
    counts = flows.crawl(spark, "http://w.example/", crawling.table_fetcher(web), str(tmp_path), fetch_files=lambda urls: urls.join(known, "url"), backends=[lambda d: ["p1", "p2"]]).first()
    assert (counts.n_visited, counts.n_fetched, counts.n_documents) == (2, 2, 3)
    rows = files.read_manifest(spark, str(tmp_path / "manifest")).orderBy("ord").collect()
    assert [(r.local_path, r.binary_path, r.title, r.source_kind, r.n_pages, r.n_chars) for r in rows] == [
        ("pages/index.txt", None, "Home", "html", 1, 10),
        ("files/One.PDF.txt", "files/One.PDF", "One", "pdf", 2, 6),
        ("pages/a.txt", None, "A", "html", 1, 5),
        ("files/two.docx.txt", "files/two.docx", "two", "docx", 1, 9),
    ]
    texts = {r.slug: r.text for r in spark.read.parquet(str(tmp_path / "pages")).collect()}
    assert texts["One.PDF"] == "p1\n\np2" and texts["two.docx"] == "one\ntwo\nc" and set(texts) == {"index", "a", "One.PDF", "two.docx"}
    assert {r.name: bytes(r.content) for r in spark.read.parquet(str(tmp_path / "files")).collect()} == {u.rsplit("/", 1)[1]: d for u, d in data if d}


def test_manifest_texts(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "x.pdf.txt").write_text("Điều 2. T\nhai", encoding="utf-8")
    (tmp_path / "texts" / "y.txt").write_text("một", encoding="utf-8")
    (tmp_path / "m.jsonl").write_text('{"url":"u1","local_path":"d/y.txt","title":"Y"}\n\n{"url":"u2","local_path":"d/gone.txt"}\n{"url":"u3","local_path":"d/x.pdf.txt","source_kind":"pdf"}\n')
    chunks = flows.chunk_manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "texts")).orderBy("row_idx").collect()
    assert [(r.source, r.article_id, r.title, r.row_idx) for r in chunks] == [("y", "PB-1", "Y", 0), ("x.pdf", "Điều 2", "T", 1)]
    out = str(tmp_path / "chunks")
    files.write_json_lines(flows.chunk_manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "texts")), out, ["row_idx"])
    assert files.read_chunks(spark, out).count() == 2
    spark.createDataFrame([], "text string").write.json(str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        files.read_chunks(spark, str(tmp_path / "none"))


def test_files(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx(["one", " ", "two"], [["c1", "c2"], ["", "c4"]]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.docx").write_bytes(b"broken")
    blank, good = lambda data: ["", " "], lambda data: ["p1", "p2"]

    def bad(data):
        raise ValueError

    found = files.extract_files(spark.read.format("binaryFile").load(str(tmp_path)), [bad, blank, good])
    got = {r.path.rsplit("/", 1)[1]: (r.pages, r.text) for r in found.collect()}
    assert got == {"a.DOCX": (["one\ntwo\nc1\nc2\nc4"], "one\ntwo\nc1\nc2\nc4"), "b.pdf": (["p1", "p2"], "p1\n\np2"), "c.txt": ([""], ""), "d.docx": ([""], "")}
    assert files.pdf_text(b"", [blank]) == ["", " "] and files.pdf_text(b"", [bad]) == [""] and files.doc_text(b"", "no-such-command") == [""]


def test_plain_pdf():
    """Literal and hexadecimal strings, escapes, kerning, lines, deflated streams; what is no text is left out."""
    import zlib

    from lexigrid.sources.pdf import page_text, plain_pages

    first = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(ke) -20 (rn) -300 (ed)] TJ T* <e9746520> Tj (a \\ b) ' ET"
    second = b"q BT 1 0 0 1 72 700 Tm <FEFF0111006300E2> Tj ET Q"
    stream = lambda head, body: b"1 0 obj <</Length 1 " + head + b">>\nstream\n" + body + b"\nendstream endobj\n"
    data = b"%PDF-1.4\n" + stream(b"", first) + stream(b"/Filter /FlateDecode", zlib.compress(second)) + stream(b"/Filter /DCTDecode", b"BT Tj") + stream(b"", b"\x00\x01") + stream(b"/Filter /FlateDecode", b"broken")
    assert plain_pages(data) == ["Hello (big) world\nkern ed\néte\na \\ b", "đcâ"]
    assert plain_pages(data + b"/Encrypt 5 0 R") == [] and plain_pages(b"%PDF") == [] and page_text(b"BT <00010203> Tj ET") == ""
    assert files.extract_pages("x.PDF", data, files.PDF_BACKENDS) == plain_pages(data)
    assert files.extract_pages("x.pdf", b"%PDF", files.PDF_BACKENDS) == [""]


def test_slug_collision_keeps_the_last(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new"), ("t", 1, "x")], "slug string, ord long, text string")
    files.write_page_texts(rows, str(tmp_path / "p"))
    assert {r.slug: r.text for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"s": "new", "t": "x"}


def test_http(spark):
    import http.server
    import threading

    from lexigrid.sources.http import HttpSource, http_fetcher

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/no" else 200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write("<p>đây</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{base}/yes",), (f"{base}/no",)], "url string")
        assert {r.url[-3:]: r.html for r in http_fetcher(0)(urls).collect()} == {"yes": "<p>đây</p>", "/no": None}
        spark.dataSource.register(HttpSource)
        rows = spark.read.format("http_pages").option("urls", f"{base}/yes {base}/no").load().collect()
        assert {r.url[-3:]: (r.ok, r.content and bytes(r.content).decode()) for r in rows} == {"yes": (True, "<p>đây</p>"), "/no": (False, None)}
    finally:
        server.shutdown()


def test_stream_chunks(spark, tmp_path):
    from lexigrid.operators.chunking import chunk_documents
    from lexigrid.streaming import ingest

    docs = spark.createDataFrame([(0, "s", None, "", "html", "Điều 1\nx\nĐiều 2\ny"), (1, "t", None, "", "html", "z")], ingest.DOCUMENT)
    docs.write.json(str(tmp_path / "in"))
    query = ingest.write_chunks(ingest.stream_chunks(ingest.read_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    rows = lambda df: sorted(map(tuple, df.collect()))
    batch = chunk_documents(docs)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select(*batch.columns)) == rows(batch)


def test_texts_by_path(spark, tmp_path):
    """Texts of one name in several folders, a path from elsewhere, one that is missing, and names that URLs encode."""
    for name in ("a/x.txt", "b/x.txt", "one two+3%.txt"):
        (tmp_path / "texts" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "texts" / name).write_text(f"text of {name}")
    names = ["b/x.txt", "a/x.txt", "x.txt", "elsewhere/a/x.txt", str(tmp_path / "texts" / "b" / "x.txt"), "./one two+3%.txt", "texts/a/x.txt"]
    rows = spark.createDataFrame([(i, f"u{i}", n) for i, n in enumerate(names)], "ord long, url string, local_path string")
    got = {r.ord: r.text for r in files.read_texts(spark, rows, str(tmp_path / "texts")).collect()}
    a, b = "text of a/x.txt", "text of b/x.txt"
    assert got == {0: b, 1: a, 3: a, 4: b, 5: "text of one two+3%.txt", 6: a}


def test_manifest_order_over_files(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS pos", "concat('u', id) AS url", "concat('p/', id) AS local_path")
    rows.repartitionByRange(7, "pos").sortWithinPartitions("pos").drop("pos").write.json(str(tmp_path / "m"))
    got = files.read_manifest(spark, str(tmp_path / "m"))
    assert sorted((r.ord, r.url) for r in got.collect()) == [(i, f"u{i}") for i in range(1000)]
    assert got.columns == ["url", "local_path", "binary_path", "title", "source_kind", "n_pages", "n_chars", "ord"]


def test_text_is_utf8_whatever_the_header_says():
    from lexigrid.sources.http import as_text

    body = "đây".encode()
    assert as_text(body, "text/html", "iso-8859-1") == as_text(body, "application/json", None) == "đây"
    assert as_text(b"\xe9", "application/octet-stream", None) == "é" and as_text(b"\xe9", "application/octet-stream", "no-such") == "�"


def test_scratch_needs_a_shared_folder():
    class Remote:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, other: other)

    with pytest.raises(RuntimeError):
        files.scratch(Remote(), "x")
    Remote.sparkContext.master = "local[2]"
    assert files.scratch(Remote(), "x").startswith("file://")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import json
    import sys
    import types

    from lexigrid import __main__ as cli

    made = types.ModuleType("made_for_test")
    made.encoder = lambda device: lambda texts: [[float(t.count("a")), float(t.count("b")), 0.1] for t in texts]
    made.reranker = lambda device: lambda questions, texts: [float(len(t)) for t in texts]
    monkeypatch.setitem(sys.modules, "made_for_test", made)
    monkeypatch.setattr(cli, "loader", lambda name, device: (lambda f: lambda: f(device))(getattr(made, name.partition(":")[2])))
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "x.txt").write_text("Điều 1. Một\na a a\nĐiều 2. Hai\nb b b and more\nĐiều 3. Ba\na c", encoding="utf-8")
    (tmp_path / "m.jsonl").write_text('{"url":"u1","local_path":"x.txt"}\n')
    where = [str(tmp_path / "m.jsonl"), str(tmp_path / "texts")]
    cli.run(spark, cli.arguments().parse_args(["index", *where, str(tmp_path / "out"), "--encoder", "made_for_test:encoder"]))
    said = json.loads(capsys.readouterr().out)
    assert (said["n_chunks"], said["dim"], said["model"]) == (3, 3, "made_for_test:encoder")
    cli.run(spark, cli.arguments().parse_args(["chunk", *where, str(tmp_path / "chunks")]))
    assert json.loads(capsys.readouterr().out) == {"n_chunks": 3, "n_sources": 1}
    cli.run(spark, cli.arguments().parse_args(["search", str(tmp_path / "out"), "b b", "--encoder", "made_for_test:encoder", "--reranker", "made_for_test:reranker"]))
    assert capsys.readouterr().out.startswith("1. 26.0000 x Điều 2")
    cli.run(spark, cli.arguments().parse_args(["search", str(tmp_path / "chunks"), "b", "--top-k", "1"]))
    assert "Điều 2" in capsys.readouterr().out


def test_loader():
    from lexigrid.__main__ import loader

    assert loader("lexigrid.operators.models:pick_device", "cpu")() == "cpu"


def python_sites(seeds, web, most):
    """Crawls of several sites, one after another."""
    import re
    from collections import deque
    from urllib.parse import urldefrag, urljoin, urlparse

    out = {}
    for site in {urlparse(u).netloc for u in seeds}:
        queue, seen = deque(u for u in seeds if urlparse(u).netloc == site), []
        while queue and len(seen) < most:
            url = queue.popleft()
            if url in seen:
                continue
            seen.append(url)
            for href in re.findall(r'href="([^"]*)"', web.get(url, "")):
                to = urldefrag(urljoin(url, href))[0]
                if urlparse(to).netloc == site and not to.endswith(".pdf"):
                    queue.append(to)
        out |= {(site, k): u for k, u in enumerate(seen)}
    return out


@pytest.fixture(scope="module")
def webs():
    import random

    draw = random.Random(5)
    web = {}
    for site in ("a.example", "b.example:8080", "c.example"):
        for k in range(14):
            links = [f"http://{draw.choice(['a.example', 'b.example:8080', 'c.example'])}/p{draw.randrange(20)}" if draw.random() < 0.3 else f"/p{draw.randrange(20)}" for _ in range(4)]
            web[f"http://{site}/p{k}"] = "".join(f'<a href="{x}">x</a>' for x in [*links, f"/d{k % 5}.pdf"])
    return web


@pytest.mark.parametrize("most", [2, 9, 60])
def test_sites_are_crawled_each_in_its_order(spark, tmp_path, webs, most):
    seeds = ["http://a.example/p3", "http://b.example:8080/p0", "http://a.example/p1", "http://gone.example/"]
    frame = spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, ord long")
    pages = spark.createDataFrame(list(webs.items()), "url string, html string")
    crawl = crawling.crawl_sites(frame, crawling.table_fetcher(pages), str(tmp_path / "c"), most, 3)
    assert {(r.site, r.ord): r.url for r in crawl.visited.collect()} == python_sites(seeds, webs, most)
    assert all(r.fetched == (r.url in webs) for r in crawl.visited.collect())
    counts = {r.site: r.n for r in crawl.documents.groupBy("site").agg(crawling.F.count("*").alias("n")).collect()}
    assert all(n <= 3 for n in counts.values()) and set(counts) <= {"a.example", "b.example:8080"}


def test_stopped_crawl_goes_on(spark, tmp_path, webs):
    """A fetch that fails in the third level leaves two; the next call fetches from the third on and ends as an undisturbed one."""
    pages = spark.createDataFrame(list(webs.items()), "url string, html string")
    seeds = spark.createDataFrame([("http://a.example/p3", 0)], "url string, ord long")
    whole, path = crawling.crawl_sites(seeds, crawling.table_fetcher(pages), str(tmp_path / "whole")), str(tmp_path / "part")
    calls = []

    def stops(urls):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("down")
        return crawling.table_fetcher(pages)(urls)

    with pytest.raises(OSError):
        crawling.crawl_sites(seeds, stops, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "part").rglob("part-*")}
    again = crawling.crawl_sites(seeds, stops, path)
    rows = lambda c: sorted((r.site, r.ord, r.url, r.depth) for r in c.visited.collect())
    assert rows(again) == rows(whole) and max(r[3] for r in rows(whole)) >= 3
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())  # a level is written once


def test_ledger(spark, tmp_path, monkeypatch):
    """Each URL is asked for once, over runs, and a run again asks for its own; also where the filter knows nearly everything."""
    asked = spark.sparkContext.accumulator(0)

    def ask(batches):
        for b in batches:
            asked.add(len(b))
            b["content"] = [None if u.endswith("3") else u.encode() for u in b["url"]]
            yield b

    fetch = lambda urls: urls.mapInPandas(ask, "url string, content binary")
    links = lambda lo, hi: spark.createDataFrame([(f"u{k % hi}",) for k in range(lo, 2 * hi)] + [(None,)], "url string")
    for bits in (1 << 17, 64):
        monkeypatch.setattr(crawling, "FILTER_BITS", bits)
        path, asked.value = str(tmp_path / f"ledger-{bits}"), 0
        first = crawling.fetch_once(links(0, 300), fetch, path, 1)
        assert first.count() == 300 and first.filter("ok").count() == 270 and asked.value == 300
        assert crawling.fetch_once(links(0, 500), fetch, path, 2).count() == 200 and asked.value == 500
        assert crawling.fetch_once(links(0, 500), fetch, path, 3).count() == 0 and asked.value == 500
        assert crawling.fetch_once(links(0, 500), fetch, path, 2).count() == 200
        rows = spark.read.schema(crawling.LEDGER).parquet(path).collect()
        assert len(rows) == len({r.url for r in rows}) == 500


def test_filter_never_misses(spark):
    seen = spark.range(3000).select(crawling.F.concat(crawling.F.lit("http://h/"), "id").alias("url")).withColumn("shard", crawling._shard(crawling.F.col("url")))
    words = crawling.seen_filter(seen)
    marked = lambda df: df.join(words, "shard", "left").select(crawling._maybe_seen(crawling.F.col("url"), crawling.F.col("words")).alias("m"))
    assert marked(seen).filter("m").count() == 3000
    other = spark.range(3000, 6000).select(crawling.F.concat(crawling.F.lit("http://h/"), "id").alias("url")).withColumn("shard", crawling._shard(crawling.F.col("url")))
    assert marked(other).filter("m").count() < 30


def test_hosts_are_asked_politely():
    """Requests to a host lie a delay apart, and hosts take turns: the time is that of the longest host, not of all requests."""
    import pandas as pd

    from lexigrid.sources.http import _politely

    now, said = [0.0], []
    run = _politely(lambda url: said.append((url, now[0])) or url, "html", 2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    batch = pd.DataFrame({"url": ["a0", "b0", "c0", "a1", "b1", "a2"], "host": ["a", "b", "c", "a", "b", "a"]})
    assert pd.concat(run(iter([batch[:2], batch[2:]])))["url"].tolist() == batch["url"].tolist()
    assert dict(said) == {"a0": 0, "b0": 0, "c0": 0, "a1": 2, "b1": 2, "a2": 4}


def test_schedule(spark):
    from lexigrid.sources.http import http_fetcher, schedule

    urls = spark.createDataFrame([("http://a/2",), ("http://a/1",), ("http://B/1",), ("http://b/0",)], "url string")
    assert {r.url: (r.host, r.slot, r.wait) for r in schedule(urls, 1.5).collect()} == {"http://a/1": ("a", 0, 0.0), "http://a/2": ("a", 1, 1.5), "http://B/1": ("b", 0, 0.0), "http://b/0": ("b", 1, 1.5)}
    plan = http_fetcher(0)(urls)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [host" in plan  # a host has one task


def test_broken_manifest_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"url":"u0","local_path":"a.txt"}\n\n{"url":"u1","local_pa\n{"url":"u2"}\n{"url":"u3","local_path":"b.txt"}\nnothing\n')
    path = str(tmp_path / "m.jsonl")
    assert sorted((r.ord, r.url) for r in files.read_manifest(spark, path, "skip").collect()) == [(0, "u0"), (3, "u3")]
    assert sorted((r.ord, r.line, r.file_path.rsplit("/", 1)[1]) for r in files.manifest_rejects(spark, path).collect()) == [(1, '{"url":"u1","local_pa', "m.jsonl"), (2, None, "m.jsonl"), (4, "nothing", "m.jsonl")]
    with pytest.raises(Exception, match="broken manifest line"):
        files.read_manifest(spark, path).collect()


def test_packed_texts_are_read_as_loose_ones(spark, tmp_path):
    """Texts in few files belong to a manifest's rows by the paths they are packed with; of one name, by the folder too."""
    texts = [("a/x.txt", "ax\n"), ("b/x.txt", "bx\n"), ("y.txt", "y"), ("c d/z+1.txt", "z")]
    for name, text in texts:
        (tmp_path / "loose" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / name).write_text(text)
    files.write_texts(spark.createDataFrame(texts, "path string, text string").coalesce(1), str(tmp_path / "packed"))
    named = ["out/b/x.txt", "./a/x.txt", "y.txt", "missing.txt", "c d/z+1.txt", "/x.txt"]
    rows = spark.createDataFrame(list(enumerate(named)), "ord long, local_path string")
    got, want = ({r.ord: (r.source, r.text) for r in files.read_texts(spark, rows, str(tmp_path / f), f == "packed").collect()} for f in ("packed", "loose"))
    assert got == want == {0: ("x", "bx\n"), 1: ("x", "ax\n"), 2: ("y", "y"), 4: ("z+1", "z")}


def test_landed_texts_are_few_files(spark, tmp_path):
    """Pages land in as many files as tasks write, not in one for each."""
    from lexigrid.plans import catalogue

    rows = [(i, f"http://h/{i}", f"<p>text {i}</p>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    path = catalogue._landed(spark, str(tmp_path))
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/texts").count() < 60
    got = [(r.ord, r.url, r.text) for r in catalogue.manifest_texts(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(i, url, f"text {i}\n") for i, url, _ in rows]
