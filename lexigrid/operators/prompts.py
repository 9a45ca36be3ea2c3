"""Citations, context blocks, histories, prompts and source panels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import strip

# The wordings that results must have.
UNKNOWN = "không rõ"
NO_CONTEXT = "(Không có đoạn ngữ cảnh nào được truy hồi.)"
NO_HISTORY = "(chưa có lịch sử)"
REFUSAL = "Tôi không có đủ dữ liệu để trả lời câu hỏi này."
PASSAGE, SOURCE, USER, ASSISTANT = "Đoạn", "Nguồn", "Sinh viên: ", "Trợ lý: "
CONTEXT_HEAD, HISTORY_HEAD, QUESTION_HEAD = "[Ngữ cảnh từ {corpus}]", "[Lịch sử hội thoại]", "[Câu hỏi của sinh viên]"
CLOSING = "Hãy dựa vào Ngữ cảnh ở trên để trả lời câu hỏi của sinh viên một cách ngắn gọn, đúng trọng tâm và kèm trích dẫn nguồn thích hợp."
NO_SOURCES = "*Không có nguồn trích dẫn.*"
PANEL_HEAD, PANEL_UNIT = "Nguồn trích dẫn", "đoạn"

#: What the prompt calls the corpus.
CORPUS = "tài liệu"
#: What a chat model is told before any prompt.
SYSTEM = (
    "Bạn trả lời câu hỏi về {corpus}.\n"
    "- Chỉ dùng những gì Ngữ cảnh nêu; không thêm, không phỏng đoán.\n"
    '- Khi Ngữ cảnh không có câu trả lời, chỉ viết: "{refusal}"\n'
    "- Kết thúc bằng nguồn, dạng [{source}: <tệp> - <điều>].\n"
    "- Viết ngắn, đúng câu hỏi, giữ nguyên thuật ngữ."
)
MAX_MESSAGES = 6
SNIPPET_CHARS = 500


def _full(c: Column) -> Column:
    return F.when(c != "", c)


def citation(source: Column, article_id: Column) -> Column:
    return F.coalesce(_full(F.concat_ws(" - ", _full(source), _full(article_id))), F.lit(UNKNOWN))


def context_block(hits: DataFrame) -> DataFrame:
    """qid, context, n_hits of hits (qid, rank, source, article_id, chapter, text), in the order of rank."""
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    chapter = F.coalesce(F.concat(F.lit(" | "), _full(F.col("chapter"))), F.lit(""))
    head = F.concat(F.lit(f"{PASSAGE} "), F.col("i").cast("string"), F.lit(f" ({SOURCE}: "), citation(F.col("source"), F.col("article_id")), chapter, F.lit("):\n"))
    lines = hits.withColumn("i", number).withColumn("line", F.concat(head, strip(F.coalesce("text", F.lit("")))))
    return lines.groupBy("qid").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY i)").alias("context"), F.count("*").alias("n_hits"))


def history_last_n(turns: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """conv_id, history: the last messages of each conversation, blank ones skipped; every role but user is the assistant."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    text = strip(F.coalesce("text", F.lit("")))
    kept = turns.withColumn("n", last).filter(F.col("n") <= max_messages)
    label = F.when(F.col("role") == "user", F.lit(USER)).otherwise(F.lit(ASSISTANT))
    lines = kept.select("conv_id", "turn", F.when(text != "", F.concat(label, text)).alias("line"))
    return lines.groupBy("conv_id").agg(F.coalesce(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY turn)"), F.lit(NO_HISTORY)).alias("history"))


def rag_prompt(question: Column, context: Column, history: Column, corpus: str = CORPUS) -> Column:
    return F.concat(
        F.lit(CONTEXT_HEAD.format(corpus=corpus) + "\n"),
        F.coalesce(context, F.lit(NO_CONTEXT)),
        F.lit(f"\n\n---\n{HISTORY_HEAD}\n"),
        F.coalesce(history, F.lit(NO_HISTORY)),
        F.lit(f"\n\n---\n{QUESTION_HEAD}\n"),
        strip(question),
        F.lit(f"\n\n{CLOSING}\n"),
    )


def system_prompt(corpus: str = CORPUS) -> str:
    """The rules for a chat model: only the context, a refusal where it has no answer, and the source at the end."""
    return SYSTEM.format(corpus=corpus, refusal=REFUSAL, source=SOURCE)


def prompts(questions: DataFrame, hits: DataFrame, histories: DataFrame | None = None, corpus: str = CORPUS) -> DataFrame:
    """qid, n_hits, prompt, answer: REFUSAL without a model's say where nothing was found, else null."""
    joined = questions.select("qid", F.col("text").alias("question")).join(context_block(hits), "qid", "left")
    if histories is not None:
        joined = joined.join(histories.select("qid", "history"), "qid", "left")
    else:
        joined = joined.withColumn("history", F.lit(None).cast("string"))
    n = F.coalesce("n_hits", F.lit(0)).cast("long")
    return joined.select("qid", n.alias("n_hits"), rag_prompt(F.col("question"), F.col("context"), F.col("history"), corpus).alias("prompt"), refusal(n).alias("answer"))


def refusal(n_hits: Column) -> Column:
    return F.when(n_hits == 0, F.lit(REFUSAL))


def source_snippets(hits: DataFrame) -> DataFrame:
    """qid, rank, header, meta, url, snippet: the lines of the sources panel."""
    bit = lambda c, text: F.when(F.col(c).isNotNull(), text)
    header = F.concat(
        F.lit("**["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("?")),
        F.coalesce(F.concat(F.lit(" — "), _full(F.col("article_id"))), F.lit("")),
        F.coalesce(F.concat(F.lit(" · "), _full(F.col("chapter"))), F.lit("")), F.lit("**"),
    )
    meta = F.concat_ws(
        " · ",
        bit("rerank_score", F.format_string("rerank: `%.4f`", "rerank_score")),
        bit("rrf_score", F.format_string("RRF: `%.4f`", "rrf_score")),
        bit("bm25_rank", F.format_string("BM25 rank: %d", "bm25_rank")),
        bit("dense_rank", F.format_string("Dense rank: %d", "dense_rank")),
    )
    text = F.coalesce("text", F.lit(""))
    snippet = F.concat(F.lit("> "), F.replace(F.substring(text, 1, SNIPPET_CHARS), F.lit("\n"), F.lit(" ")), F.when(F.length(text) > SNIPPET_CHARS, F.lit("…")).otherwise(F.lit("")))
    return hits.select("qid", "rank", header.alias("header"), meta.alias("meta"), F.col("source_url").alias("url"), snippet.alias("snippet"))


def panel_header(n: Column) -> Column:
    return F.when(n == 0, F.lit(NO_SOURCES)).otherwise(F.concat(F.lit(f"{PANEL_HEAD} · "), n.cast("string"), F.lit(f" {PANEL_UNIT}")))
