"""Structural chunking: chapters, articles, and packed paragraphs where a text has no articles."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import let, normalize_text, strip
from lexigrid.functions.urls import SAFE
from lexigrid.sources.files import scratch

MAX_CHARS = 1200
#: Characters that mark the cuts; they are removed from texts first.
CUT, TITLE, BODY = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Structure:
    """Anchors of chapters and articles (Java patterns with groups: number, title), and their labels."""

    # The patterns and labels that results must have.
    chapter: str = r"(?Uium)^\s*chương\s+([0-9IVXLCDM]+)\s*[:.\-–—]?\s*([^\n]*)$"
    article: str = r"(?Uium)^\s*điều\s+(\d{1,3})\s*[:.\-–—]?\s*([^\n]*)"
    chapter_label: str = "Chương"
    article_label: str = "Điều"
    separator: str = r"(?U)\n\s*\n"
    max_chars: int = MAX_CHARS
    #: Whether the text before a chapter's first article is kept, as the piece PB-0; else it is dropped.
    keep_preamble: bool = False


DEFAULT = Structure()


def stable_id(source: Column, article_id: Column) -> Column:
    """A readable id that stays the same on every run; not unique, as pieces of different chapters may share it."""
    return F.concat(F.regexp_replace(source, f"[^{SAFE}]", "_"), F.lit("__"), article_id, F.lit("__"), F.substring(F.md5(F.concat_ws("::", source, article_id)), 1, 8))


def pack_paragraphs(paragraphs: Column, max_chars: int = MAX_CHARS) -> Column:
    """Paragraphs joined in order while they fit; one that is too long stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("n"))

    def add(a: Column, p: Column) -> Column:
        full = (a["n"] + F.length(p) > max_chars) & (a["n"] > 0)
        return F.when(full, F.struct(F.array_append(a["done"], a["buf"]).alias("done"), p.alias("buf"), (F.length(p) + 2).alias("n"))).otherwise(
            F.struct(
                a["done"].alias("done"),
                F.when(a["n"] > 0, F.concat(a["buf"], F.lit("\n\n"), p)).otherwise(p).alias("buf"),
                (a["n"] + F.length(p) + 2).alias("n"),
            )
        )

    return F.aggregate(paragraphs, start, add, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["buf"])).otherwise(a["done"]))


def paragraphs_of(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{CUT}$1{TITLE}$2{BODY}"), CUT)


def _part(piece: Column, start: str | None, end: str | None) -> Column:
    x = F.substring_index(piece, start, -1) if start else piece
    return F.substring_index(x, end, 1) if end else x


def chapter_split(docs: DataFrame, structure: Structure = DEFAULT) -> DataFrame:
    """docs (with text) -> the same columns without text, chapter_pos, chapter, body: a row per chapter with a body; text before the first is chapter ''."""
    clean = F.translate(normalize_text(F.col("text")), CUT + TITLE + BODY, "")
    cut = docs.withColumn("__pieces", _pieces(clean, structure.chapter)).drop("text")
    rows = cut.select("*", F.posexplode("__pieces").alias("chapter_pos", "__piece")).drop("__pieces")
    head = F.col("chapter_pos") == 0
    title = strip(_part(_part(F.col("__piece"), None, BODY), TITLE, None))
    label = F.concat(F.lit(structure.chapter_label + " "), _part(F.col("__piece"), None, TITLE), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")))
    body = strip(F.when(head, F.col("__piece")).otherwise(_part(F.col("__piece"), BODY, None)))
    return rows.select(*[c for c in rows.columns if c not in ("__piece", "chapter", "body")], F.when(head, F.lit("")).otherwise(strip(label)).alias("chapter"), body.alias("body")).filter("body != ''")


def article_split(chapters: DataFrame, structure: Structure = DEFAULT) -> DataFrame:
    """Chapters -> article_pos, article_id, article_title, article_body of the articles that have a body."""
    rows = chapters.select("*", F.posexplode(_pieces(F.col("body"), structure.article)).alias("article_pos", "__piece"))
    number = F.concat(F.lit(structure.article_label + " "), _part(F.col("__piece"), None, TITLE))
    out = rows.filter("article_pos > 0").withColumns(
        {
            "article_id": number,
            "article_title": strip(_part(_part(F.col("__piece"), None, BODY), TITLE, None)),
            "article_body": strip(_part(F.col("__piece"), BODY, None)),
        }
    )
    return out.drop("__piece").filter("article_body != ''")


def chunk_documents(docs: DataFrame, structure: Structure = DEFAULT, keep: list[str] | None = None) -> DataFrame:
    """docs: doc_ord, source, source_url, title, source_kind, text -> chunks in the order of documents, chapters and pieces, with the columns to keep.

    A chapter becomes its articles, or packed paragraphs if it has none; a document of headings alone is packed whole.
    row_idx numbers the chunks within (doc_ord, chapter_pos, piece_pos); it is assigned by numbered()."""
    keep = keep or []
    meta = ["doc_ord", "source", "source_url", "title", "source_kind", *keep]

    def piece(pos: Column, id_: Column, title: Column, body: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), id_.alias("id"), title.alias("title"), body.alias("body"))

    def articles(body: Column) -> Column:
        number = lambda p: F.concat(F.lit(structure.article_label + " "), _part(p, None, TITLE))
        rows = F.transform(_pieces(body, structure.article), lambda p, i: piece(i, number(p), strip(_part(_part(p, None, BODY), TITLE, None)), strip(_part(p, BODY, None))))
        found = F.filter(rows, lambda a: (a["pos"] > 0) & (a["body"] != ""))
        if not structure.keep_preamble:
            return found
        first = piece(F.lit(0), F.lit("PB-0"), F.lit(""), strip(F.get(_pieces(body, structure.article), F.lit(0))))
        return F.when((F.size(found) > 0) & (first["body"] != ""), F.concat(F.array(first), found)).otherwise(found)

    def packed(text: Column) -> Column:
        rows = pack_paragraphs(paragraphs_of(text, structure.separator), structure.max_chars)
        return F.transform(rows, lambda p, i: piece(i + 1, F.concat(F.lit("PB-"), (i + 1).cast("string")), F.lit(""), p))

    def chapter(p: Column, i: Column) -> Column:
        title = strip(_part(_part(p, None, BODY), TITLE, None))
        label = F.concat(F.lit(structure.chapter_label + " "), _part(p, None, TITLE), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")))
        body = strip(F.when(i == 0, p).otherwise(_part(p, BODY, None)))
        return F.struct(i.cast("int").alias("pos"), F.when(i == 0, F.lit("")).otherwise(strip(label)).alias("title"), body.alias("body"))

    def under(c: Column, rows: Column) -> Column:
        return F.transform(rows, lambda a: F.struct(c["pos"].alias("chapter_pos"), c["title"].alias("chapter"), a.alias("a")))

    # a document's chunks are made within its row: no shuffle, and each pattern runs once
    clean = F.translate(normalize_text(F.col("text")), CUT + TITLE + BODY, "")
    head = F.struct(F.lit(0).alias("pos"), F.lit("").alias("title"))

    def rows_of(text: Column) -> Column:
        chapters = F.filter(F.transform(_pieces(text, structure.chapter), chapter), lambda c: c["body"] != "")
        each = F.flatten(F.transform(chapters, lambda c: under(c, let(articles(c["body"]), lambda found: F.when(F.size(found) > 0, found).otherwise(packed(c["body"]))))))
        return let(each, lambda found: F.when(F.size(found) > 0, found).otherwise(under(head, packed(text))))

    rows = docs.select(*meta, F.explode(let(clean, rows_of)).alias("c")).select(*meta, "c.chapter_pos", "c.chapter", "c.a")
    text = F.when(F.col("a.title") != "", strip(F.concat(F.col("a.id"), F.lit(". "), F.col("a.title"), F.lit("\n"), F.col("a.body")))).otherwise(F.concat(F.col("a.id"), F.lit(".\n"), F.col("a.body")))
    return rows.select(
        "doc_ord",
        "chapter_pos",
        F.col("a.pos").alias("piece_pos"),
        stable_id(F.col("source"), F.col("a.id")).alias("chunk_id"),
        F.col("a.id").alias("article_id"),
        F.col("a.title").alias("article_title"),
        "chapter",
        "source",
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        text.alias("text"),
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("a.title")).alias("title"),
        "source_kind",
        *keep,
    )


def numbered(chunks: DataFrame) -> DataFrame:
    """row_idx from 0 in the order of (doc_ord, chapter_pos, piece_pos): counts per document are summed up, so that no sort of all chunks is
    needed. The running sum is over one small row per block of documents. The chunks are written once and read
    again, so their texts are cut once and counting reads one column."""
    path = scratch(chunks.sparkSession, "chunks")
    chunks.write.parquet(path)
    chunks = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
    block = (F.col("doc_ord") / 4096).cast("long")
    per_doc = chunks.groupBy("doc_ord").agg(F.count("*").alias("n")).withColumn("block", block)
    per_block = per_doc.groupBy("block").agg(F.sum("n").alias("n"))
    before_block = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.select("block", F.coalesce(F.sum("n").over(before_block), F.lit(0)).alias("b0"))
    before_doc = Window.partitionBy("block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_doc.join(blocks, "block").select("doc_ord", (F.col("b0") + F.coalesce(F.sum("n").over(before_doc), F.lit(0))).alias("start"))
    within = Window.partitionBy("doc_ord").orderBy("chapter_pos", "piece_pos")
    return chunks.join(starts, "doc_ord").withColumn("row_idx", F.col("start") + F.row_number().over(within) - 1).drop("start")
