"""Breadth-first crawls of many sites at once as a loop over levels, a ledger of what was fetched, and what a crawl leaves: manifest, documents, counts."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import html_title, html_to_text
from lexigrid.functions.urls import authority, extract_links, file_name, is_doc_link, is_internal, slugify
from lexigrid.sources.files import exists, scratch

MAX_PAGES, MAX_FILES = 200, 80

#: fetch(urls: DataFrame with url) -> DataFrame with url, html; no row, or a null html, where a fetch fails.
Fetcher = Callable[[DataFrame], DataFrame]
#: fetch(urls: DataFrame with url) -> DataFrame with url, content (binary); no row, or a null content, where a fetch fails.
FileFetcher = Callable[[DataFrame], DataFrame]

PAGE = "site string, url string, ord long, fetched boolean, html string, depth int"
LINK = "site string, url string, parent long, pos int, document boolean, depth int"


def table_fetcher(pages: DataFrame) -> Fetcher:
    """A web that has been fetched before: a table (url, html)."""
    known = pages.select("url", "html").dropDuplicates(["url"])
    return lambda urls: urls.select("url").join(known, "url")


@dataclass
class Crawl:
    """visited: site, url, ord, depth, fetched; pages: site, url, ord, html; documents: site, url, ord of the document links to fetch;
    places: site, url, parent (ord of the first page that links it), pos of those. ord counts within a site."""

    visited: DataFrame
    pages: DataFrame
    documents: DataFrame
    places: DataFrame


def crawl_sites(seeds: DataFrame, fetch: Fetcher, path: str, max_pages: int = MAX_PAGES, max_files: int = MAX_FILES) -> Crawl:
    """Pages from the seeds (url, ord) on, of all their sites at once, each in first-in first-out order: by level, by the parent's place, by the
    link's place on its page. A site is a host with its port; seeds of one site start in the order of ord.

    A URL counts against its site's max_pages when its turn comes, also if its fetch fails. Only links within a site are followed, documents are
    not parsed. Each level is appended once, to path/pages/depth=<k> and then path/links/depth=<k>, and nothing is written again; a crawl
    that was stopped goes on after the last level that has its links, if it is called with the same path."""
    spark = seeds.sparkSession
    read = lambda what, schema: spark.read.schema(schema).parquet(f"{path}/{what}")
    depth = 0
    while exists(spark, f"{path}/links/depth={depth}/_SUCCESS"):
        depth += 1
    while True:
        if depth == 0:
            frontier = seeds.select(authority(F.col("url")).alias("site"), "url", F.col("ord").cast("long").alias("parent"), F.lit(0).alias("pos"))
            done = frontier.select("site").distinct().withColumn("done", F.lit(0))
        else:
            frontier = read("links", LINK).filter((F.col("depth") == depth - 1) & ~F.col("document")).select("site", "url", "parent", "pos")
            visited = read("pages", PAGE).filter(F.col("depth") < depth).select("site", "url")
            frontier = frontier.join(visited, ["site", "url"], "left_anti")
            done = visited.groupBy("site").agg(F.count("*").alias("done"))
        fresh = frontier.groupBy("site", "url").agg(F.min(F.struct("parent", "pos")).alias("at"))
        # no more than max_pages rows of a site reach the task that numbers them: tasks keep as many each before
        place = F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))
        level = fresh.withColumn("place", place).filter(F.col("place") <= max_pages).join(done, "site").withColumn("ord", (F.col("done") + F.col("place") - 1).cast("long"))
        level = level.filter(F.col("ord") < max_pages).select("site", "url", "ord")
        got = fetch(level.select("url")).filter("html is not null").select("url", "html")
        rows = level.join(got, "url", "left").select("site", "url", "ord", F.col("html").isNotNull().alias("fetched"), "html")
        rows.write.mode("overwrite").parquet(f"{path}/pages/depth={depth}")
        here = read("pages", PAGE).filter(F.col("depth") == depth)
        if here.isEmpty():
            break
        found = here.filter("fetched").select("site", "ord", "url", "html")
        links = extract_links(found.select("url", "html")).join(found.select(F.col("url").alias("src_url"), "site", F.col("ord").alias("parent")), "src_url")
        document, inside = is_doc_link(F.col("dst_url")), is_internal(F.col("dst_url"), F.col("site"))
        links = links.filter(document | inside).select("site", F.col("dst_url").alias("url"), "parent", "pos", document.alias("document"))
        links.write.mode("overwrite").parquet(f"{path}/links/depth={depth}")
        depth += 1
    pages = read("pages", PAGE).filter(F.col("depth") <= depth)
    listed = read("links", LINK).filter("document") if depth else spark.createDataFrame([], LINK)
    first = listed.groupBy("site", "url").agg(F.min(F.struct("parent", "pos")).alias("at"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("at"))).filter(F.col("place") <= max_files)
    return Crawl(
        pages.select("site", "url", "ord", "depth", "fetched"),
        pages.filter("fetched").select("site", "url", "ord", "html"),
        first.select("site", "url", (F.col("place") - 1).cast("long").alias("ord")),
        first.select("site", "url", F.col("at.parent").alias("parent"), F.col("at.pos").alias("pos")),
    )


def bfs(start: str, fetch: Fetcher, spark: SparkSession, max_pages: int = MAX_PAGES, max_files: int = MAX_FILES, path: str | None = None) -> Crawl:
    """The crawl of one site from one page on; its levels go to path, or to a new folder of the shared one."""
    seeds = spark.createDataFrame([(start, 0)], "url string, ord long")
    return crawl_sites(seeds, fetch, path or scratch(spark, "crawl"), max_pages, max_files)


#: Shards of a ledger, and bits of each shard's filter, of which an entry sets so many.
SHARDS, FILTER_BITS, FILTER_HASHES = 64, 1 << 17, 4
LEDGER = "url string, ok boolean, content binary, run int, shard int"


def _shard(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(3)), F.lit(SHARDS)).cast("int")


def _bits(url: Column) -> Column:
    """The bits of a URL in its shard's filter."""
    return F.transform(F.sequence(F.lit(1), F.lit(FILTER_HASHES)), lambda k: F.pmod(F.xxhash64(url, k), F.lit(FILTER_BITS)).cast("int"))


def seen_filter(seen: DataFrame) -> DataFrame:
    """shard, words: a Bloom filter for each shard of seen (url, shard), by aggregation; SHARDS rows of FILTER_BITS bits, whatever seen holds."""
    bits = seen.select("shard", F.explode(_bits(F.col("url"))).alias("bit"))
    words = bits.groupBy("shard", (F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("word"))
    entries = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("w", "word"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)))
    return entries.select("shard", whole.alias("words"))


def _maybe_seen(url: Column, words: Column) -> Column:
    hit = lambda b: F.shiftright(F.get(words, (b / 64).cast("int")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)) != 0
    return words.isNotNull() & F.forall(_bits(url), hit)


def fetch_once(links: DataFrame, fetch: FileFetcher, path: str, run: int) -> DataFrame:
    """Fetches the URLs of links (url) that the ledger at path does not have, each once, whether the fetch succeeds or not, and adds them
    under run=<run>; gives what this run added. The same run again replaces what it added.

    A URL that its shard's filter doesn't know is new without a look at the ledger; only the others are joined with it, on their shard."""
    spark = links.sparkSession
    asked = links.filter("url is not null").select("url", _shard(F.col("url")).alias("shard")).distinct()
    if exists(spark, path):
        seen = spark.read.schema(LEDGER).parquet(path).filter(F.col("run") != run).select("url", "shard")
        marked = asked.join(F.broadcast(seen_filter(seen)), "shard", "left").withColumn("maybe", _maybe_seen(F.col("url"), F.col("words"))).select("url", "shard", "maybe")
        asked = marked.filter("not maybe").unionByName(marked.filter("maybe").join(seen, ["shard", "url"], "left_anti")).select("url", "shard")
    got = fetch(asked.select("url")).select("url", "content").filter("content is not null")
    rows = asked.join(got, "url", "left").select("url", F.col("content").isNotNull().alias("ok"), "content", F.lit(run).alias("run"), "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "shard").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).filter(F.col("run") == run)


def _kept(df: DataFrame) -> DataFrame:
    """df, written to the folder that all executors share and read again."""
    path = scratch(df.sparkSession, "crawl")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest(pages: DataFrame, folder: str = "pages") -> DataFrame:
    """url, local_path, binary_path, title, source_kind, n_pages, n_chars of pages (url, html) that have text."""
    text = html_to_text(F.col("html"))
    rows = pages.select("url", html_title(F.col("html")).alias("title"), text.alias("text")).filter("text != ''")
    path = F.concat(F.lit(f"{folder}/"), slugify(F.col("url")), F.lit(".txt"))
    return rows.select(
        "url", path.alias("local_path"), F.lit(None).cast("string").alias("binary_path"), "title", F.lit("html").alias("source_kind"),
        F.lit(1).alias("n_pages"), F.length("text").cast("long").alias("n_chars"),
    )


def file_manifest(texts: DataFrame, folder: str = "files") -> DataFrame:
    """The manifest's columns for fetched documents (url, name, n_pages, text), also for those without text."""
    path, kind = F.concat(F.lit(f"{folder}/"), F.col("name")), F.lower(F.regexp_extract("name", r".\.([^.]+)$", 1))
    return texts.select(
        "url", F.concat(path, F.lit(".txt")).alias("local_path"), path.alias("binary_path"), F.regexp_replace("name", r"(?<=.)\.[^.]*$", "").alias("title"),
        kind.alias("source_kind"), F.col("n_pages").cast("int").alias("n_pages"), F.length("text").cast("long").alias("n_chars"),
    )


def fetch_documents(crawl: Crawl, fetch: FileFetcher) -> DataFrame:
    """url, parent, pos, name, content of the crawl's documents that could be fetched; each is asked for once."""
    got = fetch(crawl.places.select("url")).select("url", "content").filter("content is not null")
    return _kept(crawl.places.join(got, "url").select("url", "parent", "pos", file_name(F.col("url")).alias("name"), "content"))


def crawl_summary(crawl: Crawl) -> DataFrame:
    """n_visited, n_fetched, n_documents: one row."""
    counts = crawl.visited.agg(F.count("*").alias("n_visited"), F.count_if("fetched").alias("n_fetched"))
    return counts.join(F.broadcast(crawl.documents.agg(F.count("*").alias("n_documents"))), F.lit(True))
