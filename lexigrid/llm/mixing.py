"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Every document is repeated k times, k drawn from the Poisson distribution whose mean is the source's
target rate: the uniform number that is inverted is a hash of seed and doc_id, so the draw is the same on
every run, for any partitioning. A rate above MOST_RATE is a sum of several draws of equal smaller rates, each with
a hash of its own. The copies then lie in one global random order.

Edge cases: a null source is the source ''; a null text counts as empty; a source without a weight
keeps rate 0 where explicit weights are given; repeated rows, and rows that share a doc_id, draw alike, as do those without one; a table
without any character gives an empty one, as does an empty one; other columns pass through, and where one has the name of an added column, that one is
added with underscores in front.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import free_name, stash

#: Sources are sampled in proportion to their characters to this power, unless weights are given.
TEMPERATURE = 0.5
SEED = 17
#: Rates that are drawn at once: exp(-rate) is no number above 0 from 746 on, and inexact from 708 on.
MOST_RATE = 500.0
#: Rates are broadcast up to so many sources (some MB); beyond, a source's rows are dealt over so many tasks.
BROADCAST_SOURCES, SALTS = 20_000, 32


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash: the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with u <= CDF(k). Terms are summed until far in the tail; the mean is at most MOST_RATE, as
    exp(-mean) must not vanish: copies_drawn splits larger ones."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))
    step = lambda s, j: F.when(u <= s["cdf"], s).otherwise(
        F.struct((s["p"] * mean / j).alias("p"), (s["cdf"] + s["p"] * mean / j).alias("cdf"), j.alias("k"))
    )
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def copies_drawn(seed: int, doc: Column, rate: Column) -> Column:
    """A Poisson number of mean `rate`, whatever its size: Poisson numbers of parts of the rate add up to one of the whole."""
    parts = F.ceil(rate / MOST_RATE).cast("int")
    part = lambda total, i: (total + poisson(uniform(seed, doc, F.lit("part"), i), rate / parts)).cast("int")
    return F.when(rate <= MOST_RATE, poisson(uniform(seed, doc), rate)).otherwise(F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), part))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """mix_source, rate: how often a document of that source is repeated on average, so that the mixture has
    as many characters as the input and each source its share of them."""
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("size")
    )
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weighted = sizes.withColumn("weight", F.coalesce(F.try_element_at(F.create_map(*pairs), "mix_source"), F.lit(0.0)))
    total = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.coalesce(F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size")), F.lit(0.0))
    # one row, so this is no cross join of tables
    return weighted.join(F.broadcast(total), F.lit(True)).select("mix_source", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as its draw says, with mix_source, mix_rate, mix_copy (from 1) and mix_key,
    dealt out by mix_key and sorted by it within partitions: a global shuffle in one exchange.

    The table of rates has a row per source. It is broadcast if it has at most BROADCAST_SOURCES rows; else the
    rows of each source are dealt over SALTS tasks for the join."""
    source, rate, salt, count, copy, key = (free_name(docs, f"__op5_{c}") for c in ("source", "rate", "salt", "count", "copy", "key"))
    rates = stash(source_rates(docs, weights, temperature).select(F.col("mix_source").alias(source), F.col("rate").alias(rate)), "op5-rates")
    named = docs.withColumn(source, F.coalesce(F.col("source"), F.lit("")))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        drawn = named.join(F.broadcast(rates), source)
    else:
        salted = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = named.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [source, salt])
    copies = (
        drawn.withColumn(count, copies_drawn(seed, F.col("doc_id"), F.col(rate)))
        .filter(F.col(count) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
        .withColumn(key, uniform(seed + 1, F.col("doc_id"), F.col(copy)))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [F.col(c).alias(free_name(docs, n)) for c, n in ((source, "mix_source"), (rate, "mix_rate"), (copy, "mix_copy"), (key, "mix_key"))]
    return copies.repartition(parts, key).sortWithinPartitions(key).select(*[F.col(f"`{c}`") for c in docs.columns], *added)
