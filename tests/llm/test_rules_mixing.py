import math
import re
from collections import Counter

import duckdb
import pytest

from lexigrid.llm import queries as Q
from lexigrid.llm.mixing import copies_drawn, mix_sources, poisson, uniform
from lexigrid.llm.quality import SYMBOLS, quality_rules
from pyspark.sql import functions as F


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in SYMBOLS), len(lines) - len(set(lines)), len(covered), base


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules(docs).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])
        assert r.kept == (not r.base_failed and not r.broken_rules)


def test_measures_odd(odd, none):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = quality_rules(odd).collect()
    assert len(rows) == 13
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])
    assert quality_rules(none).count() == 0


@pytest.mark.parametrize(("text", "rules"), [("the cat and dog of it " * 12, set()), ("qq ww ee rr tt " * 12, {"stop_words"}), ("THE CAT AND DOG IT " * 12, {"shouting"}), ("the## cat$$ and&& it%% " * 15, {"symbols"})])
def test_rules(spark, text, rules):
    words = text.split()
    text = " ".join(w if i % 5 else w + chr(97 + i % 26) * (i // 5 % 3 + 1) for i, w in enumerate(words))
    broken = set(quality_rules(spark.createDataFrame([(0, text)], "doc_id long, text string")).first().broken_rules) - {"repetition"}
    assert rules <= broken and (rules or not broken)


def test_no_python_in_native_plans(spark, sf):
    for name in ("op1_quality_rules", "op5_mix_sources"):
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)


@pytest.mark.parametrize("mean", [0.0, 0.1, 1.0, 3.7, 40.0])
def test_poisson(spark, mean):
    us = [0.0001, 0.3, 0.5, 0.9, 0.999999]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", poisson(F.col("u"), F.lit(mean)).alias("k")).collect()
    for r in got:
        k, p, cdf = 0, math.exp(-mean), math.exp(-mean)
        while r.u > cdf:
            k += 1
            p *= mean / k
            cdf += p
        assert r.k == k


@pytest.mark.parametrize("mean", [500.0, 782.0, 1354.0, 4281.0])
def test_large_rates(spark, mean):
    draws = spark.range(400).select(copies_drawn(3, F.col("id"), F.lit(mean)).alias("k"))
    n, average, variance = draws.agg(F.count("k"), F.avg("k"), F.var_samp("k")).first()
    assert n == 400 and abs(average - mean) < 5 * math.sqrt(mean / 400) and 0.7 * mean < variance < 1.4 * mean
    assert sorted(draws.collect()) == sorted(draws.repartition(3).collect())


def test_mixing_of_a_tiny_source(spark):
    """A source of 10 characters beside one of 22.5 million has rate 1500."""
    docs = spark.createDataFrame([(1, "tiny", "x" * 10), (2, "huge", "y" * 22_500_000)], "doc_id long, source string, text string")
    mixed = mix_sources(docs).groupBy("mix_source", "mix_rate").count().collect()
    (tiny,) = [r for r in mixed if r.mix_source == "tiny"]
    assert tiny.mix_rate > 745 and abs(tiny["count"] - tiny.mix_rate) < 6 * math.sqrt(tiny.mix_rate)


def test_mixing_sql_at_large_rates(spark):
    """Operator and SQL draw alike, also where a rate is the sum of several."""
    docs = spark.createDataFrame([(1, "tiny", "x" * 10), (2, "tiny", "z"), (3, None, "a b" * 40), (4, "huge", "y" * 22_500_000), (5, "huge", None)], "doc_id long, source string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    mixed = mix_sources(docs).selectExpr("doc_id", "mix_source AS source", "mix_copy AS copy_no", "round(mix_rate, 6) AS rate", "mix_key AS shuffle_key")
    want = con.execute(f"SELECT doc_id, source, copy_no, rate, shuffle_key FROM ({Q.OP5_SQL})").fetchall()
    assert sorted(map(tuple, mixed.collect())) == sorted(want) and max(r[3] for r in want) > 1000


def test_mixing_clashing_names(spark):
    docs = spark.createDataFrame([(1, "s", "x" * 50, 77, "k", 5, "z")], "doc_id long, source string, text string, mix_count int, mix_key string, mix_salt int, `a.b` string")
    out = mix_sources(docs)
    assert out.columns == [*docs.columns, "mix_source", "mix_rate", "mix_copy", "_mix_key"]
    assert {tuple(r)[3:7] for r in out.collect()} == {(77, "k", 5, "z")}


def test_mixing_shares(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "a").otherwise("b").alias("source"), F.lit("x" * 10).alias("text"))
    mixed = mix_sources(docs, {"a": 1.0, "b": 1.0})
    n = {r.mix_source: r["count"] for r in mixed.groupBy("mix_source").count().collect()}
    assert all(abs(n[s] - 10_000) < 400 for s in "ab")
    again = mix_sources(docs.repartition(7), {"a": 1.0, "b": 1.0})
    key = ["doc_id", "mix_copy", "mix_key"]
    assert sorted(map(tuple, mixed.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    assert "c" not in n and mix_sources(docs, {"a": 1.0}).filter("source = 'b'").isEmpty()
    order = [r.mix_key for r in mixed.select("mix_key").collect()]
    assert order != sorted(order) and len(set(order)) == len(order)
    u = docs.select(uniform(1, F.col("doc_id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < u[0] and u[1] < 1 and abs(u[2] - 0.5) < 0.01


def test_mixing_salted_is_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: sorted(map(tuple, mix_sources(docs).select("doc_id", "mix_copy", "mix_key").collect()))
    broadcast = rows()
    monkeypatch.setattr("lexigrid.llm.mixing.BROADCAST_SOURCES", 0)
    assert rows() == broadcast


def test_mixing_odd(odd, none):
    mixed = mix_sources(odd)
    assert mixed.columns[: len(odd.columns)] == odd.columns
    assert {r.mix_source for r in mixed.collect()} <= {"", "s"}
    assert mix_sources(none).count() == 0
    blank = odd.filter("text is null or text = ''")
    assert mix_sources(blank).count() == 0  # no characters, so no share to fill


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_mix_sources"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = Q.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def test_stashes_are_dropped(spark):
    import os

    from lexigrid.llm import common

    df = common.stash(spark.range(3).select(F.col("id").alias("doc_id")), "test")
    path = common.STASHED[-1].removeprefix("file://")
    kept = common.stash(df, "test")
    assert df.count() == 3 and os.path.isdir(path)
    common.drop_stashes(spark, common.STASHED[-1:])
    assert not os.path.exists(path) and len(common.STASHED) == 1 and kept.count() == 3
    common.drop_stashes(spark)
    assert not common.STASHED


class Remote:
    """A session of a cluster that names no shared folder."""

    class sparkContext:
        master = "spark://host:7077"

    class conf:
        @staticmethod
        def get(key, other):
            return other


def test_a_cluster_needs_a_shared_folder(spark):
    from lexigrid.llm import common

    with pytest.raises(RuntimeError):
        common.shared_dir(Remote())
    Remote.sparkContext.master = "local[4]"
    assert common.shared_dir(Remote()).startswith("file://")


def test_long_keys_are_not_kept():
    from lexigrid.llm import common

    words, made = common.WordHash(), common.Recent(len)
    for n in (3, common.LONG, common.LONG + 1, 10**6):
        assert words[b"x" * n] == words[b"x" * n] and made[b"x" * n] == n
    assert len(words) == 2 and len(made) == 2
