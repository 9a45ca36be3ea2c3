"""Quality rules: one threshold table compiled into one projection, without user functions.

Edge cases: a null or empty text has no words and fails the base rule; ties and repeated rows are judged
one by one; an empty table gives an empty one; other columns of the input are not looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import words_of

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it with as was on be at by this are or from an a "
    "le la les de des du et un une que qui en dans pour pas sur au est par il ne se ce plus "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "el los las y del por con una su para al lo como más o pero sus"
).split()

#: (rule, measure, least, most): a document that passes the base rule is kept if every measure lies within its bounds.
RULES = [
    ("length", "n_words", 50, None),
    ("mean_word", "mean_word", 1.5, 25.0),
    ("symbols", "symbol_ratio", None, 0.08),
    ("stop_words", "stop_ratio", 0.02, None),
    ("shouting", "upper_ratio", None, 0.4),
    ("duplicate_lines", "dup_line_ratio", None, 0.5),
    ("repetition", "repeat_ratio", None, 0.5),
]


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the document, each word once."""
    last = F.size(words) - 3
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    covered = let(
        windows,
        lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(
            let(F.array_sort(F.transform(v, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), _covered)
        ),
    )
    return F.when(last < 1, F.lit(0)).otherwise(covered)


def _covered(ordered: Column) -> Column:
    """Length of the union of windows of three words at those places whose window equals a neighbour's in the order."""

    def twin(x: Column, k: Column) -> Column:
        before, after = F.get(ordered, k - 1)["w"], F.get(ordered, k + 1)["w"]
        return F.when(F.coalesce(x["w"] == before, F.lit(False)) | F.coalesce(x["w"] == after, F.lit(False)), x["i"])

    places = F.array_sort(F.filter(F.transform(ordered, twin), lambda p: p.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    return F.aggregate(
        places,
        start,
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["at"])).alias("n"), p.alias("at")),
        lambda s: s["n"],
    )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at. Two projections, so that words and lines are made once a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", text.alias("t"), words_of(F.col("text")).alias("ws"), lines.alias("ls"))
    chars = F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    n_words = F.size("ws").cast("long")
    out = base.select(
        "doc_id",
        n_words.alias("n_words"),
        chars.alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").cast("long").alias("n_lines"),
        repeat_words(F.col("ws")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("ws", lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace(F.col("t"), r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return out.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "word_chars"),
            "stop_ratio": share("n_stop", "n_words"),
            "upper_ratio": share("n_upper", "word_chars"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"),
        }
    )


def verdict(rules=RULES) -> Column:
    """Names of the rules that a row of measures() breaks."""
    broken = []
    for name, measure, least, most in rules:
        x = F.col(measure)
        out = (x < least) if most is None else (x > most) if least is None else (x < least) | (x > most)
        broken.append(F.when(out, F.lit(name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: its measures, base_failed, the rules it breaks, and kept."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measures(docs)
        .withColumns({"base_failed": base_failed, "broken_rules": verdict(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )
