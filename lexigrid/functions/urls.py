"""URL and link expressions."""

import re
from html import unescape
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexigrid.functions.text import strip, visible

DOC_EXTENSIONS = ("pdf", "docx", "doc")
#: Schemes that lead to no page, as they are written.
SKIPPED = r"^(javascript:|mailto:|tel:|#)"
# Fixed value: the characters that a file name keeps.
SAFE = "A-Za-z0-9_\\-.À-ɏḀ-ỿ"


@F.pandas_udf(StringType())
def resolve_any(url: pd.Series, base: pd.Series) -> pd.Series:
    """RFC 3986 resolution for what the expression in normalize_url doesn't cover."""

    def one(u, b):
        try:
            return urldefrag(urljoin(b or "", u))[0]
        except ValueError:
            return None

    return pd.Series([one(u, b) if u else None for u, b in zip(url, base, strict=True)], dtype=object)


#: Taken once a row: a filter on its result is not pushed below it, which would run it twice.
resolve_once = resolve_any.asNondeterministic()


def normalize_url(url: Column, base: Column, general: bool = True) -> Column:
    """The absolute URL without its fragment; null for empty, script, mail, telephone and fragment links.

    Absolute and root-relative links stay native; other relative ones go through an Arrow function, unless general is False
    (then they are null)."""
    link = strip(url)
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_replace(link, "#.*$", "")
    dots = link.rlike(r"/\.{1,2}(/|$|[?#])")
    absolute = link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]")
    rooted = link.rlike(r"^/(?!/)")
    other = resolve_once(F.when(~(absolute | rooted) | dots, link), base) if general else F.lit(None).cast("string")
    return (
        F.when(link.isNull() | (link == "") | link.rlike(SKIPPED), F.lit(None))
        .when(absolute & ~dots, plain)
        .when(rooted & ~dots, F.concat(host, plain))
        .otherwise(other)
    )


def authority(url: Column) -> Column:
    """Host and port, in lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def is_internal(url: Column, host: Column) -> Column:
    return F.coalesce(authority(url) == host, F.lit(False))


def is_doc_link(url: Column) -> Column:
    return F.coalesce(F.lower(path(url)).rlike(rf"\.({'|'.join(DOC_EXTENSIONS)})$"), F.lit(False))


def slugify(url: Column) -> Column:
    """A file name from a URL's path; the query takes no part."""
    bare = F.regexp_replace(path(url), "^/+|/+$", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(bare, r"(?U)[\s/]+", "_"), f"[^{SAFE}]", ""), 1, 120)
    return F.when(bare == "", F.lit("index")).when(slug == "", F.lit("doc")).otherwise(slug)


def file_name(url: Column) -> Column:
    """The name under which a linked document is kept."""
    name = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    safe = F.regexp_replace(F.when(name == "", F.lit("document")).otherwise(name), f"[^{SAFE}]", "_")
    typed = F.lower(safe).rlike(rf"\.({'|'.join(DOC_EXTENSIONS)})$")
    return F.substring(F.when(typed, safe).otherwise(F.concat(safe, F.lit(".bin"))), 1, 160)


@F.pandas_udf(StringType())
def decode_any(href: pd.Series) -> pd.Series:
    """An attribute's value with its character references decoded; a name without ; before = or a letter or digit is part of a query."""
    reference = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(?:;|(?![=a-zA-Z0-9]))")
    return pd.Series([reference.sub(lambda m: unescape(m[0]), h) if h else h for h in href], dtype=object)


#: As resolve_once.
decode_once = decode_any.asNondeterministic()


def extract_links(pages: DataFrame, general: bool = True) -> DataFrame:
    """src_url, pos, href, dst_url of every link in document order; links that lead to no page are dropped, repeated ones kept. What stands
    in comments, scripts and styles, or in an attribute of another tag, is no link.

    Values may stand in double, single or no quotation marks. References other than &amp; go through an Arrow function, unless
    general is False (then they stay)."""
    # attributes are walked over one by one, values whole; no position is tried twice
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
    valued = rf"""(?is)<a(?=[\s/])(?:(?!href\s*+=)(?:=\s*+{value}|[^>=\s"'/]++|[=\s"'/]))*+href\s*+=\s*+({value})"""
    # other tags go first, as their values may look like links
    bare_page = F.regexp_replace(visible(F.col("html"), "script|style"), r"""(?is)<(?!a[\s/])/?[a-z](?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+>""", "")
    hrefs = F.regexp_extract_all(bare_page, F.lit(valued), 1)
    raw = pages.select(F.col("url").alias("src_url"), F.posexplode(hrefs).alias("pos", "href"))
    bare = raw.withColumn("href", F.regexp_replace("href", r"""(?s)\A(["'])(.*)\1\z""", "$2"))
    plain = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    other = F.col("href").rlike("&(?!amp;)[a-zA-Z#]")
    found = bare.withColumn("href", F.when(other, decode_once(F.when(other, F.col("href")))).otherwise(plain) if general else plain)
    return found.withColumn("dst_url", normalize_url(F.col("href"), F.col("src_url"), general)).filter("dst_url is not null and dst_url != ''")
