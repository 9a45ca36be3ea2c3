"""The queries of this subpackage, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import fill_middle
from lexigrid.llm.byte_bpe import byte_bpe
from lexigrid.llm.html_extract import extract_main_text
from lexigrid.llm.line_dedup import BLOCK_WORDS, line_dedup
from lexigrid.llm.mixing import MOST_RATE, SEED, TEMPERATURE, mix_sources
from lexigrid.llm.near_dedup import near_duplicates
from lexigrid.llm.quality import RULES, STOP_WORDS, SYMBOLS, quality_rules
from lexigrid.llm.substring_dedup import substring_dedup
from lexigrid.llm.suffix_dedup import LENGTH, suffix_dedup
from lexigrid.llm.token_counts import MARK, load_pieces, token_counts
from lexigrid.llm.toxicity import toxicity
from lexigrid.llm.vector_search import nearest
from lexigrid.sources.files import spread


#: How op8 and the pipeline encode: see byte_bpe. On check_s the native style needs more disk than op8 may use.
BPE_STYLE = "arrow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt over all of them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found if name == "labels" else spread(found)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(measure: str, least, most) -> str:
    return " AND ".join([f"{measure} >= {least}"] * (least is not None) + [f"{measure} <= {most}"] * (most is not None))


OP1_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM base WHERE len(ws) > 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, i + k AS at FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
counts AS (
  SELECT base.doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{"".join(chr(92) + c for c in SYMBOLS)}]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}], lower(rtrim(w, '.,;:!?')))))::BIGINT AS n_stop,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM base LEFT JOIN covered USING (doc_id)),
ratios AS (
  SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word, coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_ratio,
    coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) AS stop_ratio, coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0) AS upper_ratio,
    coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_ratio,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(_rule_sql(m, lo, hi) for _, m, lo, hi in RULES)}) AS kept
FROM ratios"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select("doc_id", F.col("dedup_lines").alias("n_lines"), F.col("dedup_removed").alias("n_removed"), F.col("dedup_partners").alias("n_partners"), digest.alias("kept_sha256"))


#: Blocks of five words or more at most one line longer than they need be; of those that an earlier document has, all lines go.
OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, pos, line, words, count(*) FILTER (words > 0) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (
    SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
    FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')))),
solid AS (SELECT doc_id, k, line, words FROM lines WHERE words > 0),
blocks AS (
  SELECT doc_id, s, e, string_agg(line, chr(10) ORDER BY k) AS block FROM (
    SELECT a.doc_id, a.k AS s, b.k AS e, sum(m.words) AS total, any_value(a.words) AS first_words, any_value(b.words) AS last_words
    FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {BLOCK_WORDS} JOIN solid m ON m.doc_id = a.doc_id AND m.k BETWEEN a.k AND b.k
    GROUP BY a.doc_id, a.k, b.k
    HAVING total >= {BLOCK_WORDS} AND (s = e OR total - last_words < {BLOCK_WORDS} OR total - first_words < {BLOCK_WORDS})) x
  JOIN solid USING (doc_id) WHERE k BETWEEN s AND e GROUP BY doc_id, s, e),
firsts AS (SELECT block, min(doc_id) AS first FROM blocks GROUP BY block),
shared AS (SELECT doc_id, s, e, first FROM blocks JOIN firsts USING (block) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS k FROM shared),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.k) FILTER (words > 0) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (g.k IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND greatest(l.k, 1) = g.k GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_partners, 0) AS n_partners, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT first) AS n_partners FROM shared GROUP BY doc_id) USING (doc_id)"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest is taken of the texts after they were shuffled."""
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_copy").alias("copy_no"), F.round("mix_rate", 6).alias("rate"), F.col("mix_key").alias("shuffle_key"), digest)


def _uniform_sql(seed: int, *keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT)::DOUBLE + 0.5) / {1 << 52}.0"


#: A rate above MOST_RATE is drawn in parts, as many as keep each below it; part 0 stands for the single draw of the others.
OP5_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0)::DOUBLE AS n, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
sizes AS (SELECT source, sum(n) AS size, pow(sum(n), {TEMPERATURE}) AS weight FROM docs GROUP BY source),
rates AS (
  SELECT source, coalesce(weight * (SELECT sum(size) FROM sizes) / nullif((SELECT sum(weight) FROM sizes) * size, 0), 0) AS rate FROM sizes),
parts AS (SELECT source, rate, ceil(rate / {MOST_RATE})::INT AS parts, CASE WHEN rate <= {MOST_RATE} THEN rate ELSE rate / ceil(rate / {MOST_RATE})::INT END AS mean FROM rates),
terms AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM terms WHERE k < mean + 12 * sqrt(mean) + 24),
drawn AS (
  SELECT doc_id, docs.source, rate, text_sha256, part, CASE WHEN part = 0 THEN {_uniform_sql(SEED, "doc_id")} ELSE {_uniform_sql(SEED, "doc_id", "'part'", "part")} END AS u
  FROM docs JOIN (SELECT source, rate, unnest(CASE WHEN parts < 2 THEN [0::BIGINT] ELSE range(1, parts + 1) END) AS part FROM parts) p ON docs.source = p.source),
counts AS (SELECT doc_id, drawn.source, rate, text_sha256, count(*) AS n FROM drawn JOIN terms ON drawn.source = terms.source AND terms.cdf < u GROUP BY ALL),
copies AS (SELECT doc_id, source, rate, text_sha256, unnest(range(1, n + 1))::INT AS copy_no FROM counts)
SELECT doc_id, source, copy_no, round(rate, 6) AS rate, {_uniform_sql(SEED + 1, "doc_id", "copy_no")} AS shuffle_key, text_sha256 FROM copies"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def bpe_digests(coded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, BPE_STYLE))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


#: All neighbours, exactly. On tables whose vectors fill one leaf of the index, the search verifies all of them.
OP10_SQL = """
WITH vectors AS (
  SELECT vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 20"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output, form = F.col("fim_output"), F.col("fim_form")
    return made.select(
        "doc_id", F.col("fim_n").alias("n"), form.alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        digest(output).alias("output_sha256"), digest(fill_middle.restored(output, form)).alias("restored_sha256"),
    )


_P, _S, _M = (f"'{x}'" for x in (fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE))
_DRAW = [f"(('0x' || substr(digest, {1 + 8 * k}, 8))::BIGINT)" for k in range(4)]
OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest, regexp_extract_all(coalesce(text, ''), '{fill_middle.LINES}') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, least({_DRAW[0]} % (n + 1), {_DRAW[1]} % (n + 1)) AS low, greatest({_DRAW[0]} % (n + 1), {_DRAW[1]} % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, {_P}) OR contains(t, {_S}) OR contains(t, {_M}) OR {_DRAW[2]} % 100 >= {fill_middle.RATE} THEN 'plain' WHEN {_DRAW[3]} % 100 < {fill_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
parts AS (SELECT *, array_to_string(units[:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN {_P} || p || {_S} || s || {_M} || m WHEN 'spm' THEN {_S} || s || {_P} || p || {_M} || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Strings as hex digits, cut from blocks of a text, so that each takes a short walk.
_BLOCK = 1000
OP12_SQL = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
blocks AS (SELECT doc_id, n, b, substr(x, 2 * b + 1, {2 * (_BLOCK + LENGTH - 1)}) AS part FROM (SELECT doc_id, n, x, unnest(range(0, n - {LENGTH - 1}, {_BLOCK})) AS b FROM docs WHERE n >= {LENGTH})),
strings AS MATERIALIZED (
  SELECT doc_id, pos, md5_number(substr(part, 2 * (pos - b) + 1, {2 * LENGTH})) AS h
  FROM (SELECT doc_id, b, part, unnest(range(b, least(b + {_BLOCK}, n - {LENGTH - 1}))) AS pos FROM blocks)),
firsts AS (SELECT h, min(struct_pack(d := doc_id, p := pos)) AS first FROM strings GROUP BY h HAVING count(*) > 1),
gone AS (SELECT doc_id, pos FROM strings JOIN firsts USING (h) WHERE first.d < doc_id OR (first.d = doc_id AND first.p < pos)),
runs AS (
  SELECT doc_id, run, min(pos) AS a, max(pos) + {LENGTH} AS b FROM (
    SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM gone)) GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM (SELECT runs.*, x, coalesce(lag(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0) AS before FROM runs JOIN docs ON docs.doc_id = runs.doc_id) GROUP BY doc_id)
SELECT docs.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM docs LEFT JOIN pieces USING (doc_id)"""


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Alike by the sets of shingles or, for documents that repeat some, by the probability Jaccard of their counts.
OP3_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s, count(*) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n, sum(w)::BIGINT AS total, max(w) > 1 AS repeats FROM shingles GROUP BY doc_id),
sets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, sum(a.w)::DOUBLE AS wx, sum(b.w)::DOUBLE AS wy FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y, c >= 0.8 * (p.n + q.n - c) AS alike, p.repeats OR q.repeats AS weighted, p.total - wx AS only_x, q.total - wy AS only_y FROM sets JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id),
counted AS (
  SELECT x, y, a.w AS wx, b.w AS wy, only_x, only_y, a.w::DOUBLE / b.w AS ratio
  FROM pairs JOIN shingles a ON a.doc_id = x JOIN shingles b ON b.doc_id = y AND a.s = b.s WHERE weighted AND NOT alike),
rates AS (
  SELECT x, y, (sum(wx) OVER before + only_x) / wx + (sum(wy) OVER (PARTITION BY x, y) - sum(wy) OVER before + only_y) / wy AS rate
  FROM counted WINDOW before AS (PARTITION BY x, y ORDER BY ratio DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
links AS (SELECT x, y FROM pairs WHERE alike UNION ALL SELECT x, y FROM rates GROUP BY x, y HAVING sum(1 / rate) >= 0.8),
both_ways AS MATERIALIZED (SELECT x AS v, y AS u FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT v, u FROM both_ways UNION SELECT r.v, b.u FROM reach r JOIN both_ways b ON r.u = b.v)
SELECT doc_id, least(doc_id, coalesce(lowest, doc_id)) AS class_id FROM docs LEFT JOIN (SELECT v, min(u) AS lowest FROM reach GROUP BY v) ON doc_id = v"""


def op9_sql(pieces: list[str]) -> str:
    """Greedy longest match by the pieces as a literal: the longest piece at each place of each distinct word, then a walk from its start."""
    literal = ", ".join("'" + p.replace("'", "''") + "'" for p in sorted(set(pieces)))
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS MATERIALIZED (SELECT w, '{MARK}' || w AS t FROM (SELECT DISTINCT unnest(ws) AS w FROM docs)),
pieces AS (SELECT unnest([{literal}]) AS piece),
places AS (SELECT w, t, unnest(range(1, length(t) + 1)) AS p FROM words),
found AS (
  SELECT w, p, max(length(piece)) AS k
  FROM (SELECT w, p, substr(t, p, n) AS part FROM places, (SELECT unnest(range(1, {max(map(len, pieces))} + 1)) AS n) WHERE p + n <= length(t) + 1) JOIN pieces ON part = piece GROUP BY w, p),
steps AS MATERIALIZED (SELECT places.w, places.p, coalesce(k, 1) AS k, CASE WHEN k IS NULL THEN octet_length(encode(substr(t, places.p, 1))) ELSE 1 END AS tokens FROM places LEFT JOIN found ON places.w = found.w AND places.p = found.p),
walk AS (SELECT w, 1::BIGINT AS p, 0::BIGINT AS n FROM words UNION ALL SELECT walk.w, walk.p + k, n + tokens FROM walk JOIN steps ON walk.w = steps.w AND walk.p = steps.p),
counts AS (SELECT w, max(n) AS n FROM walk GROUP BY w)
SELECT docs.doc_id, len(ws)::BIGINT AS n_words, coalesce(total, 0)::BIGINT AS n_tokens
FROM docs LEFT JOIN (SELECT doc_id, sum(n) AS total FROM (SELECT doc_id, unnest(ws) AS w FROM docs) JOIN counts USING (w) GROUP BY doc_id) USING (doc_id)"""


_PIECE = r"trim(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
#: The blocks of the article element, for pages that mark it, as those of the tables do. A reference that a cut title ends in counts without its ;.
OP4_SQL = rf"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
    lambda b: regexp_replace(replace(replace(replace({_PIECE}, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')), lambda b: b <> ''), chr(10) || chr(10)) AS text
  FROM pages)"""

OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM windows JOIN firsts USING (h), (SELECT unnest(range(50)) AS k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS at, unnest(ws) AS word FROM docs),
kept AS (SELECT w.doc_id, count(g.at) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.at) FILTER (g.at IS NULL), '') AS text FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.at = g.at GROUP BY w.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_near_duplicates, op4_html_extraction, op5_mix_sources, op6_toxicity, op7_substring_dedup, op8_byte_bpe, op9_token_counts, op10_nearest_neighbours, op11_fill_middle, op12_suffix_dedup)}
SQL = {
    "op1_quality_rules": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op4_html_extraction": OP4_SQL, "op5_mix_sources": OP5_SQL,
    "op7_substring_dedup": OP7_SQL, "op10_nearest_neighbours": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_suffix_dedup": OP12_SQL,
}


def sql() -> dict[str, str]:
    """SQL, with that of op9, whose vocabulary is read when it is asked for."""
    import public_tokenizers

    return SQL | {"op9_token_counts": op9_sql(load_pieces(public_tokenizers.path("piece_bpe_32k.model")))}
