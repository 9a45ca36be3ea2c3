"""SQL for DuckDB, by which the catalogue's results are checked."""

from lexigrid.functions.text import ENTITIES, FOLDED, MARKED
from lexigrid.operators import memory as M
from lexigrid.operators import prompts as P


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fold(x: str, how: str) -> str:
    return f"translate({x}, '{MARKED}', '{FOLDED[how]}')"


TOKENS = rf"regexp_extract_all({fold('''lower(coalesce(text, ''))''', 'collapse')}, '[\p{{L}}\p{{N}}_]+')"
_LINES = r"regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
_TRIMMED = rf"regexp_replace(regexp_replace({_LINES}, '[\x{{200b}}\x{{ad}}]', '', 'g'), '[^\S\n]+(\n|$)', '\1', 'g')"
NORMAL = strip(rf"regexp_replace({_TRIMMED}, '\n{{3,}}', chr(10) || chr(10), 'g')")

# --- retrieval

BM25_CORPUS = f"""
tok AS (SELECT doc_id AS row_idx, {TOKENS} AS tokens FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT row_idx, unnest(tokens) AS term FROM tok) GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM tok),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw)"""


#: Each part is made once, and the mean joins as one row.
TERM_STATS = f"""WITH df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df, (SELECT count(*) AS n FROM documents)),
mean AS MATERIALIZED (SELECT avg(raw_idf) AS mean_idf FROM raw)
SELECT term, df, round(CASE WHEN raw_idf < 0 THEN 0.25 * mean_idf ELSE raw_idf END, 6) AS idf FROM raw, mean"""


def _bm25(queries: str, k: int) -> str:
    return f"""{BM25_CORPUS},
q AS ({queries}),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({TOKENS}) AS term FROM q) GROUP BY qid, term),
tf AS (SELECT row_idx, term, count(*) AS tf FROM (SELECT row_idx, unnest(tokens) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
sc AS (
  SELECT qid, row_idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / (SELECT avgdl FROM st)))) AS score
  FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN tok USING (row_idx) GROUP BY qid, row_idx),
lex AS (
  SELECT qid, row_idx, score, rank::INT AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_idx) AS rank FROM sc) WHERE rank <= {k} AND score > 0)"""


def bm25(queries: str, k: int) -> str:
    return f"WITH {_bm25(queries, k)} SELECT qid, row_idx, round(score, 6) AS score, rank FROM lex"


def unit(v: str) -> str:
    d = f"list_transform({v}, lambda e: e::DOUBLE)"
    return f"list_transform({d}, lambda x: x / (CASE WHEN list_dot_product({d}, {d}) = 0 THEN 1.0 ELSE sqrt(list_dot_product({d}, {d})) END))"


_ASKED = f"SELECT item_id AS qid, {unit('embedding')} AS qv FROM benchmark JOIN embeddings ON vec_id = item_id"


def _dense(where: str, k: int, asked: str = _ASKED) -> str:
    return f"""
vecs AS (SELECT vec_id AS row_idx, {unit('embedding')} AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
asked AS ({asked}),
near AS (SELECT qid, row_idx, list_dot_product(v, qv) AS score FROM vecs, asked {where}),
den AS (
  SELECT qid, row_idx, score, rank::INT AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_idx) AS rank FROM near) WHERE rank <= {k})"""


def dense(where: str, k: int, asked: str = _ASKED) -> str:
    return f"WITH {_dense(where, k, asked)} SELECT qid, row_idx, round(score, 6) AS score, rank FROM den"


_ORDER = "round(rrf_score, 12) DESC, bm25_rank ASC NULLS LAST, dense_rank ASC NULLS LAST, row_idx"


def fused(select: str, wb: float = 1.0, wd: float = 1.0, queries: str = "SELECT item_id AS qid, text FROM benchmark") -> str:
    return f"""WITH {_bm25(queries, 20)}, {_dense('WHERE qid IN (SELECT qid FROM q)', 20)},
joined AS (
  SELECT coalesce(l.qid, d.qid) AS qid, coalesce(l.row_idx, d.row_idx) AS row_idx,
    coalesce({float(wb)}::DOUBLE / (60 + l.rank), 0) + coalesce({float(wd)}::DOUBLE / (60 + d.rank), 0) AS rrf_score,
    l.rank AS bm25_rank, d.rank AS dense_rank, coalesce(l.score, 0) AS bm25_score, coalesce(d.score, 0) AS dense_score
  FROM lex l FULL OUTER JOIN den d ON l.qid = d.qid AND l.row_idx = d.row_idx),
fused AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}))::INT AS rrf_rank FROM joined)
{select}"""


_HIT_COLUMNS = "fused.*, source, text, lang AS chapter, 'PB-' || row_idx AS article_id, 'doc://' || row_idx AS source_url"


def hits(top_k: int, pool: int, wb: float = 1.0, wd: float = 1.0, reranked: bool = True) -> str:
    return fused(
        f"""SELECT qid, rrf_rank AS rank, row_idx, source, round(rrf_score, 6) AS rrf_score, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(dense_rank, 0) AS dense_rank, round(bm25_score, 6) AS bm25_score,
  round(dense_score, 6) AS dense_score, round(rrf_score, 6) AS score, {str(reranked).lower()} AS reranked, NULL::DOUBLE AS rerank_score
FROM fused JOIN documents ON doc_id = row_idx WHERE rrf_rank <= {top_k}""",
        wb,
        wd,
    )


RERANK = fused(
    rf"""SELECT qid, rank, row_idx, rerank_score, rerank_score AS score, true AS reranked FROM (
  SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, {_ORDER}))::INT AS rank FROM (
    SELECT fused.*, len(list_intersect(list_filter(regexp_split_to_array(q.text, '\s+'), lambda w: w <> ''), list_filter(regexp_split_to_array(substr(d.text, 1, 1500), '\s+'), lambda w: w <> '')))::DOUBLE AS rerank_score
    FROM fused JOIN documents d ON doc_id = row_idx JOIN q USING (qid) WHERE rrf_rank <= 20)) WHERE rank <= 5"""
)

# --- chunking

PIECE = "'PB-' || (doc_id % 3 + 1)"


def stable_id(source: str, article: str) -> str:
    return rf"regexp_replace({source}, '[^A-Za-z0-9_\-.\x{{C0}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}]', '_', 'g') || '__' || {article} || '__' || substr(md5({source} || '::' || {article}), 1, 8)"


_CHAPTER = r"(?im)^\s*chương\s+([0-9IVXLCDM]+)\s*[:.\-–—]?\s*([^\n]*)$"
_ARTICLE = r"(?im)^\s*điều\s+(\d{1,3})\s*[:.\-–—]?\s*([^\n]*)"


def _cut(x: str, pattern: str) -> str:
    return f"string_split(regexp_replace({x}, {lit(pattern)}, chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1))"


_SPLIT = "string_split(text, chr(10))"


def _every_third(part: int) -> str:
    return f"array_to_string(list_transform(list_filter(list_zip({_SPLIT}, range(len({_SPLIT}))), lambda z: z[2] % 3 = {part}), lambda z: z[1]), chr(10))"


#: The documents with headings that catalogue._headed makes.
_HEADED = f"""SELECT doc_id AS doc_ord, source || '_' || doc_id AS source,
  source || chr(10) || 'Chương II: ' || upper(lang) || chr(10) || 'lời dẫn' || chr(10) || 'Điều 1. ' || lang || chr(10) || {_every_third(0)} || chr(10) || 'Điều 2. ' || chr(10) || {_every_third(1)}
  || chr(10) || ' CHƯƠNG 3' || chr(10) || source || chr(10) || chr(10) || {_every_third(2)} AS text FROM documents"""


def _chapters() -> str:
    title = strip("split_part(split_part(piece, chr(3), 1), chr(2), 2)")
    return f"""
headed AS ({_HEADED}),
doc AS (SELECT doc_ord, source, {_cut(NORMAL, _CHAPTER)} AS ps FROM headed),
cut AS (SELECT doc_ord, source, unnest(range(len(ps)))::INT AS chapter_pos, unnest(ps) AS piece FROM doc),
chapters AS (
  SELECT * FROM (
    SELECT doc_ord, source, chapter_pos,
      CASE WHEN chapter_pos = 0 THEN '' ELSE 'Chương ' || split_part(piece, chr(2), 1) || CASE WHEN {title} <> '' THEN ': ' || {title} ELSE '' END END AS chapter,
      {strip("CASE WHEN chapter_pos = 0 THEN piece ELSE split_part(piece, chr(3), 2) END")} AS body
    FROM cut) WHERE body <> '')"""


def chapters() -> str:
    return f"WITH {_chapters()} SELECT doc_ord, chapter_pos, chapter, body FROM chapters"


def _articles() -> str:
    return f"""{_chapters()},
art AS (SELECT doc_ord, source, chapter_pos, chapter, unnest(range(len(ps)))::INT AS article_pos, unnest(ps) AS piece FROM (SELECT *, {_cut('body', _ARTICLE)} AS ps FROM chapters)),
articles AS (
  SELECT doc_ord, source, chapter_pos, chapter, article_pos, 'Điều ' || split_part(piece, chr(2), 1) AS article_id,
    {strip("split_part(split_part(piece, chr(3), 1), chr(2), 2)")} AS article_title, {strip("split_part(piece, chr(3), 2)")} AS article_body
  FROM art WHERE article_pos > 0 AND {strip("split_part(piece, chr(3), 2)")} <> '')"""


def articles() -> str:
    return f"WITH {_articles()} SELECT doc_ord, chapter_pos, chapter, article_pos, article_id, article_title, article_body, {stable_id('source', 'article_id')} AS chunk_id FROM articles"


def structured_chunks() -> str:
    """Articles, and the packed lines of chapters without any."""
    return f"""WITH RECURSIVE {_articles()},
bare AS (SELECT doc_ord, source, chapter_pos, chapter, list_filter(list_transform(string_split(body, chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM chapters c
  WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.doc_ord = c.doc_ord AND a.chapter_pos = c.chapter_pos)),
walk AS (
  SELECT doc_ord, chapter_pos, 1 AS i, length(ps[1]) + 2 AS n, 1 AS seg FROM bare WHERE len(ps) > 0
  UNION ALL
  SELECT w.doc_ord, w.chapter_pos, i + 1, CASE WHEN n + length(ps[i + 1]) > 1200 THEN 0 ELSE n END + length(ps[i + 1]) + 2, seg + (n + length(ps[i + 1]) > 1200)::INT
  FROM walk w JOIN bare p ON w.doc_ord = p.doc_ord AND w.chapter_pos = p.chapter_pos WHERE i < len(ps)),
rows AS (
  SELECT doc_ord, source, chapter_pos, article_pos AS piece_pos, chapter, article_id, article_title, article_body AS body FROM articles
  UNION ALL SELECT w.doc_ord, source, w.chapter_pos, seg, chapter, 'PB-' || seg, '', string_agg(ps[i], chr(10) || chr(10) ORDER BY i)
  FROM walk w JOIN bare p ON w.doc_ord = p.doc_ord AND w.chapter_pos = p.chapter_pos GROUP BY ALL)
SELECT doc_ord, chapter_pos, piece_pos, chapter, article_id, article_title, {stable_id('source', 'article_id')} AS chunk_id,
  CASE WHEN article_title <> '' THEN {strip("article_id || '. ' || article_title || chr(10) || body")} ELSE article_id || '.' || chr(10) || body END AS text
FROM rows"""


def _packed(text: str) -> str:
    return f"""
paras AS (SELECT doc_id, source, list_filter(list_transform(string_split({text}, chr(10)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM documents),
walk AS (
  SELECT doc_id, 1 AS i, length(ps[1]) + 2 AS n, 0 AS seg FROM paras WHERE len(ps) > 0
  UNION ALL
  SELECT w.doc_id, i + 1, CASE WHEN n + length(ps[i + 1]) > 1200 THEN 0 ELSE n END + length(ps[i + 1]) + 2, seg + (n + length(ps[i + 1]) > 1200)::INT
  FROM walk w JOIN paras p ON w.doc_id = p.doc_id WHERE i < len(ps)),
packs AS (SELECT w.doc_id, source, seg AS pos, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS chunk FROM walk w JOIN paras p ON w.doc_id = p.doc_id GROUP BY ALL)"""


def packed() -> str:
    return f"WITH RECURSIVE {_packed('text')} SELECT doc_id, pos, chunk FROM packs"


def packed_chunks() -> str:
    name = "(source || '_' || doc_id)"
    return f"""WITH RECURSIVE {_packed(NORMAL)}
SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS row_idx, doc_id AS doc_ord, {stable_id(name, "'PB-' || (pos + 1)")} AS chunk_id, 'PB-' || (pos + 1) AS article_id,
  '' AS article_title, '' AS chapter, {name} AS source, '' AS source_url, 'PB-' || (pos + 1) || '.' || chr(10) || chunk AS text, '' AS title, 'html' AS source_kind
FROM packs"""


def stored_chunks() -> str:
    name = "(source || '_' || doc_id)"
    return f"""WITH RECURSIVE {_packed(NORMAL)}
SELECT doc_id, 0 AS chapter_pos, (pos + 1)::INT AS piece_pos, {stable_id(name.replace('source', 'packs.source').replace('doc_id', 'packs.doc_id'), "'PB-' || (pos + 1)")} AS chunk_id, 'PB-' || (pos + 1) AS article_id,
  '' AS chapter, {name.replace('source', 'packs.source')} AS source, lang, 'PB-' || (pos + 1) || '.' || chr(10) || chunk AS text
FROM packs JOIN documents USING (doc_id)"""


def retrieval_report(k: int) -> str:
    """Hits of each item, and the documents that hold its words in a row."""
    words = "(' ' || array_to_string({}, ' ') || ' ')"
    return f"""WITH {_bm25('SELECT item_id AS qid, text FROM benchmark', k)},
phrases AS (SELECT item_id, {TOKENS} AS ts FROM benchmark),
held AS (SELECT item_id, row_idx FROM (SELECT item_id, {words.format('ts')} AS p FROM phrases WHERE len(ts) > 0), (SELECT row_idx, {words.format('tokens')} AS t FROM tok) WHERE contains(t, p)),
hits AS (SELECT qid AS item_id, rank, lex.row_idx AS doc_id, round(score, 6) AS score, held.item_id IS NOT NULL AS holds, lang FROM lex JOIN documents ON doc_id = lex.row_idx LEFT JOIN held ON held.item_id = qid AND held.row_idx = lex.row_idx),
items AS (
  SELECT b.item_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_holders, 0) AS n_holders, coalesce(n_found, 0) AS n_found, first_rank FROM benchmark b
  LEFT JOIN (SELECT item_id, count(*) AS n_hits, count(*) FILTER (holds) AS n_found, min(rank) FILTER (holds) AS first_rank FROM hits GROUP BY item_id) USING (item_id)
  LEFT JOIN (SELECT item_id, count(*) AS n_holders FROM held GROUP BY item_id) USING (item_id))
SELECT items.*, rank, doc_id, score, holds, lang FROM items LEFT JOIN hits USING (item_id)"""


# --- pages


def _unescape(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)"
_H1 = "regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')"
TITLE = strip(_unescape(f"(CASE WHEN {_TITLE} <> '' THEN {_TITLE} ELSE {_H1} END)"))
_BARE = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<!--.*?-->', chr(10), 'g')"
_TEXT = _unescape(f"regexp_replace({_BARE}, '(?s)<[^>]*>', chr(10), 'g')")
PAGE_TEXT = f"array_to_string(list_filter(list_transform(string_split({_TEXT}, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"


NO_FRAGMENT = "regexp_replace(url, '#.*$', '')"
_SAFE = r"A-Za-z0-9_\-.\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"
_NAME = rf"regexp_replace(regexp_extract({path('dst_url')}, '([^/]*)/*$', 1), '[^{_SAFE}]', '_', 'g')"
FILE_NAME = rf"substr(CASE WHEN regexp_matches(lower({_NAME}), '[.](pdf|docx|doc)$') THEN {_NAME} ELSE {_NAME} || '.bin' END, 1, 160)"
_TRIM = f"regexp_replace({path('url')}, '^/+|/+$', '', 'g')"
_SLUG = rf"substr(regexp_replace(regexp_replace({_TRIM}, '[\s/]+', '_', 'g'), '[^{_SAFE}]', '', 'g'), 1, 120)"
SLUG = f"(CASE WHEN {_TRIM} = '' THEN 'index' WHEN {_SLUG} = '' THEN 'doc' ELSE {_SLUG} END)"
LINKS = r"""WITH hrefs AS (
  SELECT url AS src_url, unnest(range(len(hs)))::INT AS pos, replace(unnest(hs), '&amp;', '&') AS href
  FROM (SELECT url, regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"', 1) AS hs FROM pages)),
links AS (
  SELECT src_url, pos, href, regexp_extract(src_url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || regexp_replace(href, '#.*$', '') AS dst_url
  FROM hrefs WHERE href LIKE '/%')"""



#: Links whose path ends so lead to documents in the crawl's web, as the given pages link none.
DOC_LIKE = '(href="/[^"#?]*[aeiou])"'


def crawl(max_pages: int, select: str, levels: int = 4) -> str:
    """Levels of a crawl of all sites, from all pages on; page_links are the links of the pages that were fetched."""
    web = f"WITH pages AS (SELECT page_id, url, regexp_replace(html, {lit(DOC_LIKE)}, '\\1.pdf\"', 'g') AS html FROM pages), hrefs"
    out = f"""{LINKS.replace('WITH hrefs', web, 1)},
level_0 AS (SELECT site, url, ord FROM (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY first, url) - 1 AS ord FROM (SELECT {host('url')} AS site, url, min(page_id) AS first FROM pages GROUP BY ALL)) WHERE ord < {max_pages})"""
    for k in range(1, levels):
        before = " UNION ALL ".join(f"SELECT site, url FROM level_{j}" for j in range(k))
        out += f""",
level_{k} AS (SELECT site, url, ord FROM (
  SELECT site, url, coalesce(done, 0) + row_number() OVER (PARTITION BY site ORDER BY spot, url) - 1 AS ord FROM (
    SELECT p.site, dst_url AS url, min(struct_pack(a := p.ord, b := l.pos)) AS spot FROM level_{k - 1} p JOIN (SELECT DISTINCT * FROM links) l ON p.url = l.src_url
    WHERE {host('dst_url')} = p.site AND NOT regexp_matches(lower({path('dst_url')}), '[.](pdf|docx|doc)$') AND (p.site, dst_url) NOT IN ({before}) GROUP BY ALL)
  LEFT JOIN (SELECT site, count(*) AS done FROM ({before}) GROUP BY site) USING (site)) WHERE ord < {max_pages})"""
    every = " UNION ALL ".join(f"SELECT site, url, ord, {k} AS depth FROM level_{k}" for k in range(levels))
    return f"""{out},
visited AS (SELECT *, url IN (SELECT url FROM pages WHERE html IS NOT NULL) AS fetched FROM ({every})),
page_links AS (SELECT v.site, v.ord AS parent, l.pos, dst_url AS url, regexp_matches(lower({path('dst_url')}), '[.](pdf|docx|doc)$') AS is_doc FROM visited v JOIN (SELECT DISTINCT * FROM links) l ON v.url = l.src_url WHERE fetched)
{select}"""


# --- memory and prompts

MEMORY = f"""WITH convs AS (SELECT DISTINCT conv_id FROM conversations),
msgs AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role IN ('user', 'assistant')),
state AS (SELECT *, coalesce(max(i) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), 0) - {2 * M.RECENT_TURNS} AS cut FROM msgs),
recent AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS pos, role, text FROM state WHERE i > cut),
summaries AS (
  SELECT conv_id, string_agg({lit(M.ASKED)} || regexp_replace(substr({strip('text')}, 1, {M.ASKED_CHARS}), '\\s+$', ''), chr(10) ORDER BY i) AS summary
  FROM state WHERE i <= cut AND role = 'user' GROUP BY conv_id)
"""


def remembered(summary: str = "coalesce(summary, '')", turns: str = "conversations") -> str:
    return f"""{MEMORY.replace('FROM conversations', f'FROM {turns}').replace(f'FROM {turns})', 'FROM conversations)', 1)} SELECT conv_id, {summary} AS summary, coalesce(said, '') AS said
FROM convs LEFT JOIN summaries USING (conv_id) LEFT JOIN (SELECT conv_id, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS said FROM recent GROUP BY conv_id) USING (conv_id)"""


PROMPT_HISTORY = f"""SELECT conv_id, 0 AS pos, 'system' AS role, {lit(M.SUMMARY_NOTE)} || summary AS text FROM summaries
UNION ALL SELECT r.conv_id, (pos + (summary IS NOT NULL)::INT)::INT, role, text FROM recent r LEFT JOIN summaries s ON r.conv_id = s.conv_id"""
_SAID = f"CASE WHEN role = 'user' THEN {lit(P.USER)} ELSE {lit(P.ASSISTANT)} END || {strip('text')}"
HISTORY_BLOCK = f"""SELECT conv_id, coalesce(nullif(concat_ws(chr(10) || chr(10), {lit(M.SUMMARY_HEAD)} || summary, {lit(M.RECENT_HEAD)} || lines), ''), {lit(P.NO_HISTORY)}) AS history
FROM convs LEFT JOIN summaries USING (conv_id)
LEFT JOIN (SELECT conv_id, string_agg({_SAID}, chr(10) ORDER BY pos) AS lines FROM recent WHERE {strip('text')} <> '' GROUP BY conv_id) USING (conv_id)"""
_LAST = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations"
LAST_N = f"""SELECT conv_id, coalesce(string_agg({_SAID}, chr(10) ORDER BY turn) FILTER ({strip('text')} <> ''), {lit(P.NO_HISTORY)}) AS history
FROM ({_LAST}) WHERE back <= {P.MAX_MESSAGES} GROUP BY conv_id"""


def citation(source: str, article: str) -> str:
    return f"coalesce(nullif(concat_ws(' - ', nullif({source}::VARCHAR, ''), nullif({article}::VARCHAR, '')), ''), {lit(P.UNKNOWN)})"


_CONTEXTS = f"""(SELECT qid, string_agg({lit(P.PASSAGE + ' ')} || rrf_rank || {lit(f' ({P.SOURCE}: ')} || {citation('source', 'article_id')} || ' | ' || chapter || '):' || chr(10) || {strip('text')}, chr(10) || chr(10) ORDER BY rrf_rank) AS context,
  count(*) AS n_hits FROM (SELECT {_HIT_COLUMNS} FROM fused JOIN documents ON doc_id = row_idx WHERE rrf_rank <= 5) GROUP BY qid)"""


def context() -> str:
    return fused(f"SELECT qid, context, n_hits FROM {_CONTEXTS}")


def prompt() -> str:
    head = lit(P.CONTEXT_HEAD.format(corpus=P.CORPUS) + "\n")
    return fused(
        f"""SELECT q.qid, coalesce(n_hits, 0) AS n_hits, {head} || coalesce(context, {lit(P.NO_CONTEXT)}) || {lit(f'{chr(10)}{chr(10)}---{chr(10)}{P.HISTORY_HEAD}{chr(10)}')} || coalesce(history, {lit(P.NO_HISTORY)})
  || {lit(f'{chr(10)}{chr(10)}---{chr(10)}{P.QUESTION_HEAD}{chr(10)}')} || {strip('q.text')} || {lit(f'{chr(10)}{chr(10)}{P.CLOSING}{chr(10)}')} AS prompt,
  CASE WHEN n_hits IS NULL THEN {lit(P.REFUSAL)} END AS answer
FROM q LEFT JOIN {_CONTEXTS} c ON q.qid = c.qid LEFT JOIN ({LAST_N}) h ON q.qid = h.conv_id"""
    )


def refusals() -> str:
    return fused(
        f"""SELECT a.qid, coalesce(n_hits, 0) AS n_hits, CASE WHEN n_hits IS NULL THEN {lit(P.REFUSAL)} END AS answer
FROM (SELECT qid FROM q UNION ALL SELECT -1) a LEFT JOIN {_CONTEXTS} c ON a.qid = c.qid"""
    )


def snippets() -> str:
    return fused(
        f"""SELECT qid, rrf_rank AS rank, '**[' || rrf_rank || '] ' || source || ' — ' || article_id || ' · ' || chapter || '**' AS header,
  concat_ws(' · ', 'RRF: `' || printf('%.4f', rrf_score) || '`', 'BM25 rank: ' || bm25_rank, 'Dense rank: ' || dense_rank) AS meta, source_url AS url,
  '> ' || replace(substr(text, 1, {P.SNIPPET_CHARS}), chr(10), ' ') || CASE WHEN length(text) > {P.SNIPPET_CHARS} THEN '…' ELSE '' END AS snippet
FROM (SELECT {_HIT_COLUMNS} FROM fused JOIN documents ON doc_id = row_idx WHERE rrf_rank <= 5)"""
    )


ENCODE = """SELECT doc_id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS unit
FROM (SELECT doc_id, [length(coalesce(text, ''))::DOUBLE, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE, 1.0::DOUBLE] AS v FROM documents)"""
