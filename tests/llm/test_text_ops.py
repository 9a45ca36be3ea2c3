import hashlib
import html
import random
import re

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from lexigrid.llm import html_extract as H
from lexigrid.llm import toxicity as X
from lexigrid.llm.byte_bpe import byte_bpe, load_ranks, merge
from lexigrid.llm.queries import QUERIES
from lexigrid.llm.token_counts import MARK, Automaton, load_pieces, token_counts
from lexigrid.llm import vector_search as V
from lexigrid.llm.vector_search import chi_square_cdf, chi_square_quantile, nearest
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_merge(library):
    r, ranks = random.Random(1), load_ranks(RANKS)
    for n in [1, 2, 5, 20, 47, 48, 49, 60, 300]:
        for letters in ("ab", "the rain", "éàñ日本"):
            piece = "".join(r.choice(letters) for _ in range(n)).replace(" ", "e")
            assert list(merge(piece.encode(), ranks)) == library._core_bpe.encode_single_piece(piece.encode())


@pytest.mark.parametrize("style", ["arrow", "native"])
def test_bpe_is_the_library(spark, odd, none, sf, library, style):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").select("doc_id", "text")
    docs = docs.union(odd.select("doc_id", "text").filter("doc_id != 7"))
    docs = docs.union(spark.createDataFrame([(900, "<|endoftext|> it's　a  \n\n b12٣!!?")], "doc_id long, text string"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    rows = byte_bpe(docs, RANKS, public_tokenizers.PATTERN, style).collect()
    assert len(rows) == docs.count()
    for r in rows:
        decoded = bytes(r.decoded).decode()
        assert decoded in texts[r.doc_id] and r.ids == library.encode_ordinary(decoded) and r.n_tokens == len(r.ids)
    assert byte_bpe(none, RANKS, public_tokenizers.PATTERN, style).count() == 0


def test_bpe_digests(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op8_byte_bpe"](spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- token counts


def brute_count(word, pieces, most):
    n = i = 0
    while i < len(word):
        for k in range(min(most, len(word) - i), 0, -1):
            if word[i : i + k] in pieces:
                n, i = n + 1, i + k
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_automaton():
    r = random.Random(4)
    for _ in range(400):
        pieces = ["".join(r.choice("abcß") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))]
        automaton = Automaton(pieces)
        for _ in range(10):
            word = "".join(r.choice("abcdß") for _ in range(r.randint(0, 14)))
            assert automaton.count(word) == brute_count(word, set(pieces), 5)


def test_token_counts(spark, odd, none, sf):
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    known, most = set(pieces), max(map(len, pieces))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text").filter("doc_id is not null"))
    texts: dict = {}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        texts.setdefault(r.doc_id, set()).add((len(words), sum(brute_count(MARK + w, known, most) for w in words)))
    for r in token_counts(docs, pieces).collect():
        assert (r.n_words, r.n_tokens) in texts[r.doc_id]
    assert token_counts(none, pieces).count() == 0 and token_counts(odd, pieces).count() == 13


# --- main text


def reference_text(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == reference_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


FULL = """<html><head><title>T</title></head><body class="home menu"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
<div class="wrap"><div class="post"><h2>Head &amp; line</h2><p>First <a href=x>para</a> of the story is long enough to be text.<p>Second&nbsp;para <div class="ad-slot">BUY</div>tail<ul><li>one<li>two</ul></div>
<div class="side-bar sidebar">Links <a>a</a></div><section id=comments><article class=comment><p>Nice article I do love it so very much indeed.</p></article></section></div>
<form>Mail <input> <button>Go</button></form><script>var a = "<p>no</p>";</script><noscript>none</noscript><footer>&copy; x</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (FULL, "Head & line\n\nFirst para of the story is long enough to be text.\n\nSecond para\n\ntail\n\none\n\ntwo"),
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<br>b</p>", "a b"), ("<p>x<!-- y --> z", "x z"), ("a <b", "a"), ("<script>x", ""), ("1 < 2 &lt;b&gt; &#233; &nope;", "1 < 2 <b> é &nope;"),
        ("<article><p>w<b>o</b>rd &#x1F600;</p></article><aside><p>Another story that is long enough to look like text.</p></aside>", "word 😀"),
        ('<div role="navigation">Home About</div><main><p hidden>gone</p><p style="display:none">gone</p><p>Stay.</p></main>', "Stay."),
        ("<nav><ul><li><a href=/>Home</a></ul></nav><p class=a\">q</p>", "q"),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


PROSE = [f"Paragraph {k} of the article runs on for quite a few words, as the running text of a page commonly does, and it ends with a full stop." for k in range(4)]
ASIDE = '<div class="sidebar"><p>Subscribe to our newsletter and get the best of the week by mail, every Friday morning.</p></div>'


@pytest.mark.parametrize("start, end", [
    ('<div class="content-sidebar-wrap"><article>', "</article>" + ASIDE + "</div>"),
    ('<div class="layout has-sidebar"><main>', "</main></div>" + ASIDE),
    ('<div class="no-header"><div>', "</div>" + ASIDE + "</div>"),
    ('<form action="/page.aspx"><div>', "</div>" + ASIDE + "</form>"),
    ('<form><div id="has-sidebar"><article>', "</article></div>" + ASIDE + "</form>"),
    ('<svg width="1" height="1"/><article>', "</article><nav><svg><text>x</text></svg></nav>"),
    ("<article><math/>", "</article>"),
])
def test_main_text_in_a_wrapper(start, end):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    assert H.main_text(f'<body><nav><a href="/">Home</a></nav>{start}{body}{end}<footer>© Us</footer></body>') == "\n\n".join(PROSE)


@pytest.mark.parametrize("name", ['div class="comments"', 'section id="related"', "form"])
def test_main_text_leaves_named_parts_out(name):
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    other = "<p>A reader says at some length what they think of all this, and they go on for a while.</p>" * 2
    assert H.main_text(f"<body><div>{body}</div><{name}>{other}</{name.split()[0]}></body>") == "\n\n".join(PROSE)


def test_cut_is_minimal():
    r = random.Random(7)
    for _ in range(150):
        n = r.randint(1, 9)
        pairs = [(r.random() * 2, r.random() * 2) for _ in range(n)]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a) if r.random() < 0.4]

        def cost(labels):
            return sum(b if x else a for x, (a, b) in zip(labels, pairs, strict=True)) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(H.content_labels(pairs, edges)) - best) < 1e-9


def test_cut_outweighs_costs():
    """A block that is mostly a link, and by its own costs boilerplate, stays among the paragraphs of its parent; in a list of links it goes."""
    line = "Read on in <a href=/2>the second part of this long story about</a> it"
    body = f"<div><p>{PROSE[0]}</p><p>{line}</p><p>{PROSE[1]}</p></div>"
    rows = H.blocks_of(body)
    alone = [a > b for a, b in (H.costs(t, b) for t, b in rows)]
    assert alone == [True, False, True] and H.main_text(body).count("\n\n") == 2
    links = "".join(f"<li>{line}</li>" for _ in range(4))
    assert H.main_text(f"<div><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><ul>{links}</ul>") == "\n\n".join(PROSE[:2])


@pytest.mark.parametrize("start", ['div class="has-sidebar"', 'div id="page" class="layout no-sidebar"', 'div class="single-post comments-open"', 'article class="post tag-legal"', 'main class="no-menu"', 'div class="content search"'])
def test_main_text_of_named_wrappers(start):
    name = start.split()[0]
    assert H.main_text(f"<{start}><p>{PROSE[0]}</p><p>{PROSE[1]}</p></{name}>") == "\n\n".join(PROSE[:2])


def test_main_text_without_a_long_thread():
    """Reader comments go, also if they are three times as long as the article; a body of that name alone stays."""
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    thread = "<p>A reader says at some length what they think of all this, and they go on for a while, as readers do.</p>" * 12
    for start, end in (("<article>", "</article>"), ("<div>", "</div>"), ('<div class="comments-open">', "</div>")):
        assert H.main_text(f"<body>{start}{body}{end}<section id=comments>{thread}</section></body>") == "\n\n".join(PROSE)
        assert H.main_text(f"<body>{start}{body}<div class='comment-list'>{thread}</div>{end}</body>") == "\n\n".join(PROSE)


def test_main_text_keeps_an_articles_own_header():
    page = f"<body><header><a href=/>Site</a></header><article><header><h1>The headline</h1></header><p>{PROSE[0]}</p></article></body>"
    assert H.main_text(page) == f"The headline\n\n{PROSE[0]}"


def test_hard_pages_end():
    for page in ("<div>" * 20_000 + "x y z" + "</div>" * 20_000, "<a " * 50_000, "<!-- " * 50_000, "<script " * 20_000, "<p " + 'a="' * 50_000, "<p>" + "<b>" * 5_000 + "text"):
        H.main_text(page)
    import time
    import tracemalloc

    deep = {name: f"<{name}>x" * 50_000 for name in ("div", 'div class="menu"', "b", "b><div", "i></b")}
    tracemalloc.start()
    began = time.process_time()
    for page in deep.values():
        H.main_text(page)
    assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    many = "".join(f"<p>Sentence number {i} of a very long page.</p>" for i in range(20_000))
    assert H.main_text(many).count("\n\n") == 19_999


def test_pages_odd(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x y z</p>", "t", 1), (1, None, None, "t", 2), (None, "u", "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    rows = H.extract_main_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in rows) == [("", 0), ("", 0), ("x y z", 5)] and H.extract_main_text(pages.filter("false")).count() == 0


# --- toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton():
    r = random.Random(9)
    terms = ["idiot", "worthless", "abcab", "aabbcc", "cabbage"]
    lexicon = X.Lexicon([(t, False) for t in terms])
    for _ in range(4000):
        word = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(word) + 1)
            word[k : k + r.randrange(2)] = r.choice(["", "a", "b", "c", "x"])
        word = "".join(word)
        assert (lexicon.near(word) is not None) == any(edit_distance(word, t) <= 1 for t in terms), word


def test_kinds_and_context():
    lexicon = X.Lexicon([("idiot", False), ("worthless", False), ("lowei", True)])
    kinds = X.Kinds(lexicon)
    assert [lexicon.kind(X.plain(w)) for w in ("Idiot!", "1d1ot", "idiott", "worthles", "loweiab", "low", "fine")] == [1, 1, 4, 3, 2, 0, 0]
    abuse, quote = X.features("you are an idiot indeed", kinds), X.features('he said "you idiot" to them', kinds)
    assert abuse[5] > 0 and abuse[4] == 0 and quote[4] > 0 and quote[5] == 0
    assert X.features(None, kinds) == X.features("", kinds) == [0.0] * 8


def brute_score(text, model):
    """The score by edit distances from every term and plain loops."""
    exact, stems = {t for t, stem in model.terms if not stem}, {t for t, stem in model.terms if stem}

    def kind(word):
        if word in exact:
            return 1
        if any(word.startswith(t) for t in stems):
            return 2
        near = [t for t in exact if len(t) >= X.EDIT_FROM and len(word) >= X.EDIT_FROM - 1 and abs(len(t) - len(word)) < 2 and edit_distance(word, t) <= 1]
        return 0 if not near else 3 if max(map(len, near)) >= 7 else 4

    tokens = [t.decode() for t in (text or "").encode().split()]
    kinds = {t: kind(X.plain(t)) for t in set(tokens)}
    n = [sum(kinds[t] == k for t in tokens) for k in range(5)]
    quoted = directed = 0
    for i, t in enumerate(tokens):
        if kinds[t]:
            around = range(max(0, i - X.WINDOW), min(len(tokens), i + X.WINDOW + 1))
            inside = any(tokens[j][0] in X.QUOTES for j in around if j <= i) and any(tokens[j].rstrip(".,;:!?")[-1:] and tokens[j].rstrip(".,;:!?")[-1] in X.QUOTES for j in around if j >= i)
            near = {X.plain(tokens[j]) for j in around}
            quoted += inside or bool(near & X.REPORTING)
            directed += not inside and bool(near & X.ADDRESS)
    f = [n[1], n[2], len({t for t in tokens if kinds[t] == 3}), len({t for t in tokens if kinds[t] == 4}), quoted, directed]
    f = [float(np.log1p(x)) for x in f] + [min(10.0, 100 * (n[1] + n[2]) / (len(tokens) + 30)), float(n[1] + n[2] > 0)]
    z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], f, strict=True))
    return 1 / (1 + np.exp(-z))


def test_scores_by_brute_force(spark, sf):
    """The whole query against the plain version, with the model that it learns."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.learn(docs, labels.filter(~X.held_out(F.col("doc_id"))))
    model.terms += [("worthlessly", False), ("pathe", True)]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in X.score(docs, model).collect():
        assert abs(r.score - brute_score(texts[r.doc_id], model)) < 1e-9 and r.predicted == int(r.score >= 0.5)
    own = {r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    again = {r.doc_id: r.score for r in X.score(docs, X.learn(docs.repartition(3), labels.filter(~X.held_out(F.col("doc_id"))))).collect()}
    assert own.keys() == texts.keys() and all(abs(own[i] - again[i]) < 1e-9 for i in own)


def test_copies_count_once(spark):
    """A word of one toxic text that many copies repeat is not learned, and rows that share a shingle all count."""
    r = random.Random(8)
    prose = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(40))
    rows = [(i, "quorb " + "in one text only " * 3, 1) for i in range(60)]
    rows += [(100 + i, f"{prose()} zarbine {prose()}", 1) for i in range(60)] + [(200 + i, "the same five words here and " + prose(), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = {t for t, _ in X.learn(docs.drop("toxic"), docs.select("doc_id", "toxic")).terms}
    assert "zarbine" in learned and "quorb" not in learned


def test_toxicity_learns(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = [f"w{r.randrange(300)}" for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(60)] = r.choice([f"zarb{r.choice(['o', 'ine', 'ul', 'at'])}", "moron", "pathetic"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = X.toxicity(docs, marks).collect()
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [(x.predicted, labels[x.doc_id][1]) for x in got if x.held_out]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    flipped = marks.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {x.doc_id: x.score for x in X.toxicity(docs, flipped).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in got)  # held-out labels are not looked at


def test_toxicity_odd(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = X.toxicity(odd, no_labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows) and X.toxicity(none, no_labels).count() == 0
    one = spark.createDataFrame([(1, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    assert X.toxicity(odd, one).count() == 13


# --- nearest neighbours


def test_chi_square():
    assert abs(chi_square_cdf(np.array([7.344]), 8)[0] - 0.5) < 1e-3 and chi_square_cdf(np.array([0.0]), 8)[0] == 0


    assert abs(chi_square_quantile(0.5, 8) - 7.344) < 1e-3


def clustered(n, d=32, seed=3):
    """Unit vectors around 200 centres."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((200, d))[r.integers(0, 200, n)] + 0.25 * r.standard_normal((n, d))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def recall(found, x, queries, k=20):
    """Share of the k nearest of each query, by brute force, that were found."""
    shares = []
    for q, own in zip(queries, found, strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        shares.append(len(set(np.argpartition(-score, k)[:k].tolist()) & set(own)) / k)
    return float(np.mean(shares))


def test_cell_recall_and_share():
    """The index finds nine tenths of the nearest and verifies less than half of the rows: it is no brute force."""
    x = clustered(20_000)
    queries = np.arange(0, 20_000, 100)
    places, verified = V.Cell(x, V.Space(32, 1.0)).search(x[queries], 21)
    found = [sorted(own[own >= 0].tolist(), key=lambda i: -x[i] @ x[q])[1:21] for q, own in zip(queries, places, strict=True)]
    assert recall(found, x, queries) >= 0.9
    assert verified.mean() < 0.5 * len(x)


def test_index_recall_and_cells(spark):
    x = clustered(20_000)
    own = spark.createDataFrame(enumerate(x.tolist()), "vec_id long, v array<double>").withColumn("d", F.size("v"))
    index = V.Index(own, 20, cell_rows=1_000)
    hits = index.nearest(own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "d", "v"), 21)
    best: dict = {}
    for r in sorted(hits.collect(), key=lambda r: (r.q, -r.score)):
        best.setdefault(r.q, []).append(r.vec_id)
    queries = sorted(best)
    assert index.n_cells >= 16 and index.n_rows == 20_000 and len(queries) == 200
    assert recall([best[q][1:21] for q in queries], x, queries) >= 0.9
    assert index.visited.count() < 0.5 * len(queries) * index.n_cells


def brute_neighbours(rows, query_ids, k):
    out = {}
    for q, v in rows:
        if q in query_ids:
            scores = sorted((-float(np.sum(np.array(w) * np.array(v))), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_nearest_recall(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got: dict = {}
    for r in QUERIES["op10_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = [len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for q, found in got.items():
        assert [k for k, _, _ in found] == list(range(1, 21)) and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)


@pytest.mark.parametrize("name", ["op9_token_counts", "op10_nearest_neighbours"])
def test_sql_of_tokens_and_neighbours(spark, sf, name):
    import duckdb

    from lexigrid.llm.queries import sql

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql()[name]})").fetchall())


def test_nearest_odd(spark, monkeypatch):
    r = np.random.default_rng(5)
    same = r.standard_normal(6).tolist()
    rows = [(i, same) for i in range(0, 60)] + [(i, r.standard_normal(6).tolist()) for i in range(60, 200)] + [(i, r.standard_normal(3).tolist()) for i in range(200, 212)]
    bad = [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (380, [float("nan")] * 6), (400, [float("inf")] * 6), (None, same)]
    table = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<double>")
    table = table.withColumns({c: F.lit(1) for c in ("rank", "score", "q", "v", "shard")})
    ids = F.col("vec_id") % 20 == 0
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    for cell, shard, block in ((8_192, 32_768, 16_384), (40, 32_768, 16_384), (40, 15, 3)):
        monkeypatch.setattr(V, "SHARD_ROWS", shard)
        monkeypatch.setattr(V, "BLOCK_ROWS", block)
        got: dict = {}
        for x in nearest(table, ids, 20, sure=1.0, cell_rows=cell).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.vec_id, x.score))
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
        assert len(got[200]) == 11
    assert nearest(table.filter("false"), ids).count() == 0
