"""The operators put together: crawl to manifest, manifest to chunks, chunks to index, questions to answers."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.text import html_title, html_to_text
from lexigrid.operators import chunking, crawling, hybrid, postings, prompts, vectors
from lexigrid.sources import files


def crawl(spark: SparkSession, start: str, fetch: crawling.Fetcher, out: str, max_pages: int = crawling.MAX_PAGES, max_files: int = crawling.MAX_FILES,
          fetch_files: crawling.FileFetcher | None = None, backends: list[files.PdfBackend] | None = None) -> DataFrame:
    """Crawls from start and writes texts and manifest under out; gives the counts.

    With fetch_files the linked documents are fetched too: their bytes go to out/files (name, content), their texts to the others,
    under the document's name, and their rows into the manifest, each after the page that links it first."""
    found = crawling.bfs(start, fetch, spark, max_pages, max_files)
    slug = crawling.slugify(F.col("url"))
    texts = found.pages.select(slug.alias("slug"), "ord", html_to_text(F.col("html")).alias("text"))
    rows = crawling.manifest(found.pages).join(found.pages.select("url", "ord"), "url").withColumn("pos", F.lit(-1))
    if fetch_files is not None:
        got = crawling.fetch_documents(found, fetch_files)
        order = F.struct("parent", "pos")
        got.groupBy("name").agg(F.max_by("content", order).alias("content")).write.mode("overwrite").parquet(f"{out}/files")
        # a path that is the url and the name: the name may be another document's too, its end tells the kind of file
        asked = got.select(F.concat_ws("\n", "url", "name").alias("path"), "content")
        read = files.extract_files(asked, backends).withColumns({"url": F.split_part("path", F.lit("\n"), F.lit(1)), "name": F.split_part("path", F.lit("\n"), F.lit(2))})
        read = crawling._kept(read.drop("path", "pages").join(got.select("url", "parent", "pos"), "url"))
        last = read.groupBy("name").agg(F.max_by("text", order).alias("text"), F.max("parent").alias("ord"))
        texts = texts.unionByName(last.withColumnRenamed("name", "slug"))
        rows = rows.unionByName(crawling.file_manifest(read).join(read.select("url", F.col("parent").alias("ord"), "pos"), "url"))
    files.write_page_texts(texts, f"{out}/pages")
    files.write_json_lines(rows, f"{out}/manifest", ["ord", "pos"])
    return crawling.crawl_summary(found)


def chunk_pages(pages: DataFrame, structure: chunking.Structure = chunking.DEFAULT) -> DataFrame:
    """Chunks of pages (ord, url, html)."""
    docs = pages.select(
        F.col("ord").alias("doc_ord"), crawling.slugify(F.col("url")).alias("source"), F.col("url").alias("source_url"), html_title(F.col("html")).alias("title"),
        F.lit("html").alias("source_kind"), html_to_text(F.col("html")).alias("text"),
    )
    return chunking.numbered(chunking.chunk_documents(docs.filter("text != ''"), structure))


def chunk_manifest(spark: SparkSession, manifest: str, folder: str, structure: chunking.Structure = chunking.DEFAULT, packed: bool = False) -> DataFrame:
    """Chunks of the texts that a manifest names, in its order; packed: see files.read_texts."""
    rows = files.read_texts(spark, files.read_manifest(spark, manifest), folder, packed)
    docs = rows.select(F.col("ord").alias("doc_ord"), "source", F.col("url").alias("source_url"), "title", "source_kind", "text")
    return chunking.numbered(chunking.chunk_documents(docs, structure))


def ingest(chunks: DataFrame, encode: Callable, model_name: str, out: str) -> DataFrame:
    """Writes the vectors of chunks and their postings as a new version of the index; gives the metadata."""
    index, metadata = vectors.build_index(chunks, encode, model_name)
    files.write_index(index, metadata, out, lambda folder: postings.write_postings(chunks, folder, "row_idx"))
    return metadata


def build(spark: SparkSession, manifest: str, folder: str, encode: Callable, model_name: str, out: str, structure: chunking.Structure = chunking.DEFAULT, packed: bool = False) -> DataFrame:
    """From a manifest and its texts to an index: chunks go to out/chunks, the index to out/index; gives its metadata and chunks_path."""
    path = f"{out}/chunks"
    write_chunks(chunk_manifest(spark, manifest, folder, structure, packed), path)
    return ingest(files.read_chunks(spark, path), encode, model_name, f"{out}/index").withColumn("chunks_path", F.lit(path))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines in their order."""
    files.write_json_lines(chunks.drop("doc_ord", "chapter_pos", "piece_pos"), path, ["row_idx"])


def search(spark: SparkSession, index_path: str, queries: DataFrame, encode: Callable, **knobs) -> DataFrame:
    """Hits of queries (qid, text) in an index that ingest wrote."""
    version = files.latest_version(spark, index_path)
    index = files.open_index(spark, index_path, version)
    chunks = index.select("row_idx", F.col("document").alias("text"), "metadata.chunk_id", "metadata.article_id", "metadata.chapter", "metadata.source", "metadata.source_url")
    asked = queries.withColumn("qvec", encode(F.col("text")))
    return hybrid.hybrid_search(chunks, index.select("row_idx", "embedding"), asked, index=postings.open_postings(spark, f"{index_path}/also/version={version}"), **knobs)


def answer(queries: DataFrame, hits: DataFrame, chat: Callable, histories: DataFrame | None = None, corpus: str = prompts.CORPUS) -> DataFrame:
    """qid, prompt, answer: the refusal where nothing was found, else what chat (a column function of the prompt, see models.chat_model) says."""
    rows = prompts.prompts(queries, hits, histories, corpus)
    said = chat(F.when(F.col("answer").isNull(), F.col("prompt")))
    return rows.select("qid", "prompt", F.coalesce("answer", said).alias("answer"))
