import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.operators import chunking as C
from lexigrid.plans.catalogue import FIXTURE

SCHEMA = "doc_ord long, source string, source_url string, title string, source_kind string, text string"


def python_pack(paragraphs, most=1200):
    done, buf, n = [], [], 0
    for p in paragraphs:
        if n + len(p) > most and buf:
            done.append("\n\n".join(buf))
            buf, n = [], 0
        buf.append(p)
        n += len(p) + 2
    return [*done, "\n\n".join(buf)] if buf else done


@pytest.mark.parametrize("sizes", [[1200, 1], [600, 599, 1], [5000], [], [1, 1, 1], [1200], [598, 600, 2], [5000, 1, 5000]])
def test_pack_edges(spark, sizes):
    paragraphs = ["x" * n for n in sizes]
    got = spark.createDataFrame([(paragraphs,)], "p array<string>").select(C.pack_paragraphs(F.col("p")).alias("x")).first()["x"]
    assert got == python_pack(paragraphs)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 1400), max_size=8), min_size=1, max_size=8))
def test_pack_model(spark, many):
    rows = [(i, ["y" * n for n in sizes]) for i, sizes in enumerate(many)]
    got = spark.createDataFrame(rows, "i int, p array<string>").select("i", C.pack_paragraphs(F.col("p")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: python_pack(p) for i, p in rows}


def python_chunks(text, source):
    """The same segmentation by re."""
    chapter = re.compile(r"^\s*chương\s+([0-9IVXLCDM]+)\s*[:.\-–—]?\s*([^\n]*)$", re.I | re.M)
    article = re.compile(r"^\s*điều\s+(\d{1,3})\s*[:.\-–—]?\s*([^\n]*)", re.I | re.M)
    text = text.strip()
    heads = list(chapter.finditer(text))
    cuts = [("", text[: heads[0].start()] if heads else text)]
    for m, after in zip(heads, [*heads[1:], None], strict=False):
        title = m[2].strip()
        cuts.append((f"Chương {m[1]}" + (f": {title}" if title else ""), text[m.end() : after.start() if after else None]))
    cuts = [(t, b.strip()) for t, b in cuts if b.strip()]
    out = []

    def packed(chapter_title, body):
        paragraphs = [p for p in (x.strip() for x in re.split(r"\n\s*\n", body)) if p]
        out.extend((chapter_title, f"PB-{k}", f"PB-{k}.\n{p}") for k, p in enumerate(python_pack(paragraphs), 1))

    for title, body in cuts:
        found = list(article.finditer(body))
        rows = []
        for m, after in zip(found, [*found[1:], None], strict=False):
            own = body[m.end() : after.start() if after else None].strip()
            if own:
                t = m[2].strip()
                rows.append((title, f"Điều {m[1]}", f"Điều {m[1]}. {t}\n{own}" if t else f"Điều {m[1]}.\n{own}"))
        out.extend(rows) if rows else packed(title, body)
    if not out:
        packed("", text)
    return [(c, a, t, f"{source}__{a}__{hashlib.md5(f'{source}::{a}'.encode()).hexdigest()[:8]}") for c, a, t in out]


TEXTS = [FIXTURE, "Chương I", "Chương 1\nChương 2", "điều 5 - abc\nđoạn\n\nđoạn\nĐiều 6\n\nx", "", "không có mục\n\nhai", "Chương dài một\nthân", "mở\nChương V. Năm\nĐiều 1\nthân\nĐiều 2. Hai\n"]


def test_chunks_against_model(spark):
    docs = spark.createDataFrame([(i, f"s {i}", None, "", "html", t) for i, t in enumerate(TEXTS)], SCHEMA)
    rows = C.numbered(C.chunk_documents(docs)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    want = [(i, *row) for i, t in enumerate(TEXTS) for row in python_chunks(t, f"s {i}")]
    want = [(i, c, a, t, k.replace("s ", "s_", 1)) for i, c, a, t, k in want]
    assert [(r.doc_ord, r.chapter, r.article_id, r.text, r.chunk_id) for r in rows] == want


def test_fixture_splits(spark):
    docs = spark.createDataFrame([(0, FIXTURE)], "doc_ord long, text string")
    chapters = C.chapter_split(docs).orderBy("chapter_pos").collect()
    assert [r.chapter for r in chapters] == ["", "Chương I: QUY ĐỊNH CHUNG", "Chương 2: ABC", "Chương 3: Điều 1."]
    articles = C.article_split(C.chapter_split(docs)).orderBy("article_pos").collect()
    assert [(r.article_id, r.article_title, r.article_body) for r in articles] == [("Điều 1", "Phạm vi", "1. abc\n2. def"), ("Điều 2", "Đối tượng", "xyz")]


def test_titles_and_nulls(spark):
    docs = spark.createDataFrame([(0, "a", None, "T", "html", "x"), (1, "b", "u", None, None, "Điều 1. Tên\ny"), (2, "c", None, None, None, None)], SCHEMA)
    rows = C.chunk_documents(docs).orderBy("doc_ord").collect()
    assert [(r.title, r.source_url) for r in rows] == [("T", ""), ("Tên", "u")]


def test_preamble(spark):
    """Text before a chapter's first article is dropped, or kept as PB-0; a chapter without articles is packed either way."""
    text = "Chương 1: A\nlời dẫn\nĐiều 1. X\nthân\nChương 2: B\nchỉ có lời\nChương 3: C\nĐiều 2. Y\nthân"
    docs = spark.createDataFrame([(0, "s", None, "", "html", text)], SCHEMA)
    ids = lambda structure: [(r.chapter_pos, r.article_id, r.text) for r in C.chunk_documents(docs, structure).orderBy("chapter_pos", "piece_pos").collect()]
    plain = ids(C.DEFAULT)
    assert [x[:2] for x in plain] == [(1, "Điều 1"), (2, "PB-1"), (3, "Điều 2")]
    assert ids(C.Structure(keep_preamble=True)) == [(1, "PB-0", "PB-0.\nlời dẫn"), *plain]
