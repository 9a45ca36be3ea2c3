import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.operators import memory as M
from lexigrid.operators import prompts as P

TURNS = "conv_id long, turn long, role string, text string"


def model(turns, r=2):
    m = M.Memory(recent_turns=r)
    for role, text in turns:
        m.add(role, text)
    return m.summary, m.recent


def test_script(spark):
    turns = [(r, f"{r} {i}") for i in range(1, 4) for r in ("user", "assistant")] + [("user", "user 4")]
    summary, recent = model(turns)
    assert len(recent) == 5 and summary == "- SV hỏi: user 1"


def test_model_and_failures():
    calls = []
    m = M.Memory(recent_turns=1, summarize=lambda s, u, a: calls.append((s, u, a)) or f"[{u}]" * 300, compress=lambda s: s[:10] + " ")
    for role, text in [("user", " q1 "), ("user", "q2"), ("assistant", "a2"), ("user", "q3"), ("assistant", "a3")]:
        m.add(role, text)
    assert calls[0] == ("", "q1", None) and m.summary == "[q2][q2][q"

    def fail(*_):
        raise RuntimeError

    m = M.Memory(recent_turns=1, summarize=fail, compress=fail)
    for k in range(12):
        m.add("user", "w" * 200 + str(k))
        m.add("assistant", "r")
    assert m.summary.count("- SV hỏi: ") == 11 and len(m.summary) > 800
    m.clear()
    assert (m.summary, m.recent) == ("", [])


roles = st.sampled_from(["user", "assistant", "system"])
texts = st.sampled_from(["hi", "  x ", "", "y" * 119 + " z" * 5, "đ\nm", None])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(roles, texts), max_size=10), min_size=1, max_size=6), st.integers(1, 3))
def test_fold_is_the_memory(spark, many, r):
    rows = [(c, t, role, text) for c, turns in enumerate(many) for t, (role, text) in enumerate(turns)]
    if rows:
        got = M.conversation_memory(spark.createDataFrame(rows, TURNS), r).collect()
        for row in got:
            want = model([(a, b) for c, _, a, b in rows if c == row.conv_id], r)
            assert (row.summary, [tuple(x) for x in row.recent]) == want


def test_blocks(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(8)] + [(1, 0, "user", " ")]
    m = M.conversation_memory(spark.createDataFrame(rows, TURNS))
    blocks = {r.conv_id: r.history for r in M.history_block(m).collect()}
    assert blocks[0] == "[Tóm tắt các lượt trước]\n- SV hỏi: t0\n- SV hỏi: t2\n\n[Các lượt gần đây]\nSinh viên: t4\nTrợ lý: t5\nSinh viên: t6\nTrợ lý: t7"
    assert blocks[1] == P.NO_HISTORY
    first = M.prompt_history(m).filter("conv_id = 0").orderBy("pos").first()
    assert (first.role, first.text) == ("system", "Tóm tắt hội thoại trước đó:\n- SV hỏi: t0\n- SV hỏi: t2")


@pytest.mark.parametrize(("source", "article", "want"), [("s", "a", "s - a"), ("s", "", "s"), (None, "a", "a"), ("", None, "không rõ")])
def test_citation(spark, source, article, want):
    df = spark.createDataFrame([(source, article)], "s string, a string")
    assert df.select(P.citation(F.col("s"), F.col("a")).alias("x")).first().x == want


def test_context_prompt_refusal(spark):
    hits = spark.createDataFrame([(0, 2, "s", "a", "", " x "), (0, 1, "s", "", "ch", "y")], "qid long, rank int, source string, article_id string, chapter string, text string")
    q = spark.createDataFrame([(0, " hỏi "), (1, "gì")], "qid long, text string")
    rows = {r.qid: r for r in P.prompts(q, hits, corpus="sổ tay").collect()}
    assert "Đoạn 1 (Nguồn: s | ch):\ny\n\nĐoạn 2 (Nguồn: s - a):\nx" in rows[0].prompt
    assert rows[0].prompt.startswith("[Ngữ cảnh từ sổ tay]\n") and "[Câu hỏi của sinh viên]\nhỏi\n" in rows[0].prompt
    assert rows[0].answer is None and rows[1].answer == P.REFUSAL and P.NO_CONTEXT in rows[1].prompt and P.NO_HISTORY in rows[1].prompt


def test_history_last_n(spark):
    rows = [(0, i, "user" if i % 2 else "system", "" if i == 5 else f"m{i}") for i in range(8)]
    got = P.history_last_n(spark.createDataFrame(rows, TURNS), 4).first().history
    assert got == "Trợ lý: m4\nTrợ lý: m6\nSinh viên: m7"


def test_snippets(spark):
    hits = spark.createDataFrame([(0, 1, "s", "a", None, "u", "l1\nl2" + "x" * 600, None, 0.5, 3, None)], "qid long, rank int, source string, article_id string, chapter string, source_url string, text string, rerank_score double, rrf_score double, bm25_rank int, dense_rank int")
    r = P.source_snippets(hits).first()
    assert r.header == "**[1] s — a**" and r.meta == "RRF: `0.5000` · BM25 rank: 3" and r.snippet == "> l1 l2" + "x" * 495 + "…"


def test_stream_is_the_batch(spark, tmp_path):
    from lexigrid.streaming.conversations import stream_memory

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"c{c} t{t}") for c in range(3) for t in range(9)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], TURNS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream_memory(stream).writeStream.format("memory").queryName("turns_seen").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = spark.sql("SELECT conv_id, max_by(summary, turn) AS summary, max_by(recent, turn) AS recent FROM turns_seen GROUP BY conv_id").collect()
    batch = {r.conv_id: (r.summary, r.recent) for r in M.conversation_memory(spark.createDataFrame(rows, TURNS)).collect()}
    assert {r.conv_id: (r.summary, r.recent) for r in last} == batch and len(batch) == 3
