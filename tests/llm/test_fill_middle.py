import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import fill_middle as M
from lexigrid.llm import queries


def plain(text, doc_id, seed, rate, spm_rate, pattern):
    """All units as a list."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(pattern, text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", "\n", "\n\n\n", "a", "a\nb", "a\nb\n", "é😀\nü\n" * 9, "with <P> marker\nx\n", "<M>", "<", "S>\n<S\n<\nP>M>", "x\r\ny\r\n", "q\n" * 5000 + "end"]


@pytest.mark.parametrize("pattern", [M.LINES, r"(?s).", r"\S+\s*|\s+"])
@pytest.mark.parametrize("rate", [100, 40])
def test_is_plain_version(pattern, rate):
    for doc_id in [None, *range(12)]:
        for text in TEXTS:
            assert M.transform(text, doc_id, re.compile(pattern), 7, rate, 50) == plain(text, doc_id, 7, rate, 50, pattern)


def test_text_between_matches_is_kept():
    for doc_id in range(20):
        n, form, a, m, output = M.transform("  one two  ", doc_id, re.compile(r"\w+"), 7, 100, 50)
        assert n == 2 and form != "plain" and len(output) == len("  one two  ") + 9 and a + m <= 11


def test_no_list_of_units(monkeypatch):
    """Of the matches of a long text no two exist at a time."""
    alive, most = 0, 0

    class Match:
        def __init__(self, end):
            nonlocal alive, most
            alive += 1
            most = max(most, alive)
            self.at = end

        def end(self):
            return self.at

        def __del__(self):
            nonlocal alive
            alive -= 1

    class Units:
        def finditer(self, text):
            return (Match(k + 1) for k in range(len(text)))

    assert M.cuts("x" * 10_000, Units(), 7_000, 3_000) == (10_000, 3_000, 7_000) and most <= 3


def test_table(odd, none):
    got = M.fill_in_middle(odd.withColumn("fim_n", F.lit("mine")).withColumn("FIM_output", F.lit(None).cast("string")))
    rows = got.withColumn("back", M.restored(F.col("_fim_output"), F.col("fim_form"))).collect()
    assert len(rows) == odd.count() and {r.fim_n for r in rows} == {"mine"}
    for r in rows:
        assert (r._fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r._fim_output) == plain(r.text or "", r.doc_id, 7, 100, 50, M.LINES)
        assert r.back == (r.text or "")
    assert M.fill_in_middle(none).count() == 0


def test_query_is_its_sql(spark, sf):
    got = queries.op11_fill_middle(spark, sf)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want)) and len(want) == 200
    assert {r.form for r in got.collect()} >= {"psm", "spm"} and got.filter("output_sha256 = restored_sha256 and form != 'plain'").count() == 0
