"""Text expressions: normalising, folding, tokens, HTML to text. All are columns, inside code generation where Spark allows."""

import html as html_lib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _base(letter: str) -> str:
    return "d" if letter == "đ" else unicodedata.normalize("NFD", letter)[0]


# Fixed value: the lower-case letters with marks.
LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
MARKED = LETTERS + LETTERS.upper()
#: "collapse" sends every marked letter to a (or A); "base" to its own letter.
FOLDED = {"collapse": "a" * len(LETTERS) + "A" * len(LETTERS), "base": "".join(map(_base, LETTERS)) + "".join(map(_base, LETTERS)).upper()}
#: Letters, digits and underscore of any script; plain \w is ASCII in Java and RE2.
WORD = r"[\p{L}\p{N}_]+"
ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def fold(text: Column, how: str = "collapse") -> Column:
    return F.translate(text, MARKED, FOLDED[how])


def tokenize(text: Column, lower: bool = True, fold_marks: str | None = "collapse") -> Column:
    """Tokens of a text in order; null has none."""
    x = F.coalesce(text, F.lit(""))
    x = F.lower(x) if lower else x
    x = fold(x, fold_marks) if fold_marks else x
    return F.regexp_extract_all(x, F.lit(f"({WORD})"), 1)


def normalize_text(text: Column) -> Column:
    """Line ends become \\n, zero-width spaces and soft hyphens go, lines lose trailing white space, runs of blank lines become one."""
    x = F.regexp_replace(text, "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n")
    x = F.regexp_replace(x, "[​­]", "")
    x = F.regexp_replace(x, r"(?U)[^\S\n]+(?=\n|\z)", "")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


#: A character reference that is none of ENTITIES. One without its ; stays as it is, as the SQL of the queries has it.
OTHER_REFERENCE = rf"&(?!(?:{'|'.join(e[1:-1] for e, _ in ENTITIES)});)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"


@F.pandas_udf(StringType())
def unescape_any(text: pd.Series) -> pd.Series:
    """All character references of HTML, for what unescape doesn't cover."""
    reference = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
    return pd.Series([reference.sub(lambda m: html_lib.unescape(m[0]), t) if t else t for t in text], dtype=object)


#: Taken once a row: a filter on its result is not pushed below it, which would run it twice.
unescape_once = unescape_any.asNondeterministic()


def unescape(text: Column) -> Column:
    """Text with its character references decoded, once. Those of ENTITIES stay native, & last, so nothing is decoded twice; a text
    that has others goes through an Arrow function."""
    other = text.rlike(OTHER_REFERENCE)
    plain = text
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(other, unescape_once(F.when(other, text))).otherwise(plain)


# What follows reads a page from left to right as a parser does: a tag starts with a letter or / after <, and a > in a quoted value does not end it.
_QUOTED = r"""=\s*+(?:"[^"]*+"|'[^']*+')"""
TAG = rf"(?is)<(?:/?[a-z](?:{_QUOTED}|[^>])*+>|[!?][^>]*+>|/[^>]*+>)"
#: Comments, and elements whose content is no text; one without an end reaches to the end of the page.
HIDDEN = rf"(?is)<!--.*?(?:--!?>|\z)|<(NAMES)(?=[\s/>])(?:{_QUOTED}|[^>])*+>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
_TITLE = rf"(?is)<title(?:\s(?:{_QUOTED}|[^>])*+)?>((?:[^<]|<(?![a-z/!?]))*+)</title\s*+>"
_H1 = rf"(?is)<h1(?:\s(?:{_QUOTED}|[^>])*+)?>(.*?)</h1\s*+>"


def visible(html: Column, without: str = "script|style|noscript") -> Column:
    """A page without comments and these elements; a line end stands for each."""
    return F.regexp_replace(html, HIDDEN.replace("NAMES", without), "\n")


def html_title(html: Column) -> Column:
    """The title; without one, the text of the first h1; else empty. A title of white space alone is an empty title; one with a tag in it is none."""
    page = visible(html)
    title = F.regexp_extract(page, _TITLE, 1)
    heading = F.regexp_replace(F.regexp_extract(page, _H1, 1), TAG, "")
    return F.coalesce(strip(unescape(F.when(title != "", title).otherwise(heading))), F.lit(""))


def html_to_text(html: Column) -> Column:
    """The text nodes of a page, one or more to a line, without scripts, styles, comments and blank lines."""
    x = unescape(F.regexp_replace(visible(html), TAG, "\n"))
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda line: line != "")
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))
