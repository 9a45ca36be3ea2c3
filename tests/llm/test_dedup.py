import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lexigrid.llm import near_dedup as N
from lexigrid.llm.line_dedup import common_blocks, line_dedup, patience
from lexigrid.llm.near_dedup import components, near_duplicates, prob_minhash, similarity
from lexigrid.llm.substring_dedup import lengths, substring_dedup
from pyspark.sql import functions as F

DOC = "doc_id long, text string"


# --- substrings


def brute_substrings(docs, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in sorted(split):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def check_substrings(spark, docs, window=50, start=25):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(docs, DOC), window, start).collect()}
    assert got == brute_substrings(docs, window)


def test_substrings_sf(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_substrings(spark, docs)


def test_lengths():
    assert lengths(50, 25) == [25, 50] and lengths(100, 25) == [25, 50, 100] and lengths(7, 1) == [1, 3, 7] and lengths(7, 25) == [7]


@pytest.mark.parametrize("window, start", [(6, 3), (7, 1), (7, 25), (50, 25), (50, 3), (100, 25)])
def test_substrings_random(spark, window, start):
    r = random.Random(window)
    passage = [f"p{i}" for i in range(2 * window)]
    docs = []
    for i in range(60):
        words = [r.choice("abc") if i % 4 == 0 else f"u{r.randrange(40)}" for _ in range(r.randrange(0, 4 * window))]
        if i % 3 == 0:
            a, n = r.randrange(window), r.randrange(window - 2, 2 * window)
            at = r.randrange(len(words) + 1)
            words[at:at] = passage[a : a + n]
        docs.append((i, " ".join(words)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "w " * (3 * window)), (105, "w " * (5 * window)), (106, docs[6][1].replace(" ", "\n"))]
    check_substrings(spark, docs, window, start)


def test_substrings_of_a_shared_doc_id(spark):
    """Rows of one doc_id lose what their own text shares with earlier documents, and nothing to each other."""
    a, b = (" ".join(f"{x}{k}" for k in range(70)) for x in "ab")
    rows = substring_dedup(spark.createDataFrame([(5, a), (5, b), (1, a[: a.index(" a60")])], DOC)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(1, 60, 0), (5, 70, 0), (5, 70, 60)]
    rows = substring_dedup(spark.createDataFrame([(5, a), (5, a + " tail"), (6, a)], DOC)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(5, 70, 0), (5, 71, 0), (6, 70, 70)]


def test_substrings_odd(odd, none):
    rows = substring_dedup(odd).collect()
    assert len(rows) == 13 and substring_dedup(none).count() == 0
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_words, r.n_removed))
    assert by[4] == {(60, 0)} and by[5] == {(60, 60)} and by[6] == {(61, 60)} and by[None] == {(60, 0)} and by[0] == {(0, 0)}


# --- lines


def test_patience():
    shared = [(0, 0, 1), (1, 1, 1), (2, 5, 1), (3, 3, 1), (5, 8, 1), (6, 9, 1)]
    assert patience(shared) in ({0, 1, 3, 5, 6}, {0, 1, 2, 5, 6})
    assert patience([(0, 4, 2), (1, 5, 1), (2, 6, 2), (9, 0, 1)]) == {0, 1, 2, 3}
    assert patience([(0, 4, 1), (1, 4, 1)]) == set() and patience([]) == set()


def split_lines(text):
    return [x for x in (text or "").split("\n") if x.encode().split()]


def brute_lines(docs, least=5):
    """Every document against every earlier one: places of the lines in runs of equal consecutive lines of `least` words in all."""
    split = [(i, split_lines(t)) for i, t in docs if i is not None]
    out = []
    for i, a in split:
        gone = set()
        for j, b in split:
            if j >= i or not set(a) & set(b):
                continue
            for shift in range(-len(b) + 1, len(a)):
                run = []
                for p in range(max(0, shift), min(len(a), len(b) + shift) + 1):
                    if p < min(len(a), len(b) + shift) and a[p] == b[p - shift]:
                        run.append(p)
                        continue
                    if sum(len(a[k].split()) for k in run) >= least:
                        gone |= set(run)
                    run = []
        out.append((i, gone))
    return out


def brute_cut(text, gone):
    """The text without these lines and the blank ones that follow them."""
    kept, place = [], -1
    for line in (text or "").split("\n"):
        place += bool(line.encode().split())
        if max(place, 0) not in gone:
            kept.append(line)
    return "\n".join(kept)


def check_lines(spark, docs):
    got = sorted((x.doc_id, x.dedup_removed, x.text or "") for x in line_dedup(spark.createDataFrame(docs, DOC)).collect())
    cut = brute_lines(docs)
    assert got == sorted((i, len(gone), brute_cut(t, gone)) for (i, t), (_, gone) in zip(docs, cut, strict=True))
    return cut


def test_lines(spark, sf):
    check_lines(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_random(spark, seed):
    r = random.Random(seed)
    pool = [f"line number {k} has five words" for k in range(12)] + ["short", "tiny one", "", "three words here", " \t", "a b c d"]
    check_lines(spark, [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 14)))) for i in range(80)])


def test_lines_of_a_later_holder(spark):
    """Single lines of a block occur earlier elsewhere; repeated and short lines, and moved blocks, go as well."""
    l0, l1, l2 = ("the first line of the block", "the second line of the block", "the third line of the block")
    block = "\n".join([l0, "Contact us", l1, "Read more", l2])
    poem = "\n".join("one\ntwo\nthree\nfour\nfive\nsix".split("\n"))
    docs = [(0, f"{l0}\nContact us\n{l0}"), (7, f"own line of seven is here\n{block}"), (9, f"{block}\nown line of nine is here"), (10, f"x\n{l2}\ny\n{l0}"),
            (11, poem), (12, f"zero\n{poem}\nseven"), (13, "one two three\nfour"), (14, "one two three\nfour")]
    cut = dict(check_lines(spark, docs))
    assert cut[9] == {0, 1, 2, 3, 4} and cut[10] == {1, 3} and cut[12] == {1, 2, 3, 4, 5, 6} and cut[14] == set()


def test_lines_of_a_shared_doc_id(spark):
    """Rows of one doc_id lose what their own text shares with earlier documents, and nothing to each other."""
    a = "line zero with five words\nmore of the text in a"
    b = "line null with five words\nmore of the text in b"
    rows = line_dedup(spark.createDataFrame([(5, a), (5, b), (5, a), (1, "line zero with five words")], DOC)).collect()
    assert sorted(r.text for r in rows if r.doc_id == 5) == sorted(["more of the text in a", b, "more of the text in a"])


def test_lines_text(spark):
    a = "first line of the page\n\nshared block line one two\n\nshared block line three four\nend\nlast"
    b = "other line of the page\n\nshared block line one two\nshared block line three four\nend\nown last"
    rows = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(1, a), (2, b), (3, a)], DOC)).collect()}
    assert rows[1].text == a and rows[2].text == "other line of the page\n\nown last" and rows[3].text == ""
    assert (rows[2].dedup_lines, rows[2].dedup_removed, rows[2].dedup_moved, rows[2].dedup_partners) == (6, 3, 0, 1)


def test_lines_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 77, "x")], "doc_id long, text string, dedup_removed int, `a.b` string")
    out = line_dedup(rows)
    assert out.columns == [*rows.columns, "dedup_lines", "_dedup_removed", "dedup_moved", "dedup_partners"]
    assert tuple(out.first()) == (1, "a", 77, "x", 1, 0, 0, 0)


def test_lines_odd(odd, none):
    out = line_dedup(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() == 13 and line_dedup(none).count() == 0
    rows = out.collect()
    assert {r.text for r in rows if r.doc_id is None} == {" ".join(f"w{i}" for i in range(60))} and [r.text for r in rows if r.doc_id == 0] == [None]
    assert [r.text for r in rows if r.doc_id == 5] == [""] and {r.dedup_removed for r in rows if r.doc_id == 4} == {0}
    assert common_blocks(none).count() == 0


# --- near duplicates


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_classes(docs, least=0.8):
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs if t is not None]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if len(a & b) >= least * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_near_sf(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert got == brute_classes(docs)


def planted(seed, small):
    """Documents with one passage in common, and a group of near copies of which few are alike pairwise."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join([f"u{i}_{k}" for k in range(r.randrange(30, 90))] + passage + [f"v{i}_{k}" for k in range(20)])) for i in range(60)]
    base = [f"b{k}" for k in range(150)]
    for i in range(100, 180):
        words = list(base)
        for _ in range(r.randrange(0, 5)):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words[: r.randrange(130, 151)])))
    return docs


@pytest.mark.parametrize("small", [2, 12])
def test_near_groups(spark, small, monkeypatch):
    monkeypatch.setattr(N, "SMALL", small)
    docs = planted(small, small)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert got == brute_classes(docs)


def test_prefix_filter_is_exact(spark):
    """All pairs that are alike are among the prefix filter's, whatever the buckets are."""
    docs = planted(3, 2)
    near = N.NearDuplicates(spark.createDataFrame(docs, DOC))
    members = spark.createDataFrame([(i, i) for i, _ in docs], "rep long, comp long")
    pairs = {tuple(r) for r in near.prefix_pairs(members, near.docs).distinct().collect()}
    sets = {i: shingles(t) for i, t in docs}
    alike = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= pairs and len(pairs) < len(docs) ** 2 / 4


def test_texts_of_one_passage_make_no_pairs(spark):
    """Documents that share half of their words, a passage, with all others are no candidates of each other."""
    docs = [(i, " ".join([f"u{i}_{k}" for k in range(40)] + [f"p{k}" for k in range(60)] + [f"v{i}_{k}" for k in range(20)])) for i in range(80)]
    docs += [(100 + i, f"{t} more") for i, t in docs[:5]]
    near = N.NearDuplicates(spark.createDataFrame(docs, DOC))
    members = spark.createDataFrame([(i, i) for i, _ in docs], "rep long, comp long")
    pairs = {tuple(r) for r in near.prefix_pairs(members, near.docs).distinct().collect()}
    assert pairs == {(i, 100 + i) for i in range(5)}


def test_pairs_of_a_large_group_are_made_once(spark):
    """Near copies of one text that differ in too much to be alike are no pairs, by sets or by counts; what is alike is one row by each."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(160)]

    def copy(i):
        words = [f"z{i}_{k}" if r.random() < 0.02 else w for k, w in enumerate(base)]
        return " ".join(words + ["again"] * (20 if i % 4 == 0 else 0))

    docs = [(i, copy(i)) for i in range(150)]
    near = N.NearDuplicates(spark.createDataFrame(docs, DOC))
    members = spark.createDataFrame([(i, i) for i, _ in docs], "rep long, comp long")
    found = [tuple(x) for x in near.prefix_pairs(members, near.docs).collect()]
    items = {i: N._weighted(t, 5, N.WordHash()) for i, t in docs}
    alike = {(i, j) for i in items for j in items if i < j and max(similarity(items[i], items[j])) >= 0.8}
    assert alike and alike <= set(found) and len(set(found)) <= 1.3 * len(alike)
    assert len(found) <= 2 * len(set(found))  # under a part of sets, and by counts


def repeating(n):
    """Pairs 2i, 2i + 1 with nearly the same shingle set, of which the second repeats a passage: alike as sets, not by counts."""
    docs = []
    for i in range(n):
        words = [f"r{i}_{k}" for k in range(124)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:5] * 50 + words[5:]))]
    return docs


def test_near_repeated_passage(spark):
    docs = repeating(40)
    items = [N._weighted(t, 5, N.WordHash()) for _, t in docs[:2]]
    by_count, by_set = similarity(*items)
    assert by_count < 0.5 and by_set > 0.9
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert got == brute_classes(docs) == {i: i - i % 2 for i, _ in docs}


def test_near_sql(spark, sf):
    """The SQL states the whole rule: sets, or counts where documents repeat shingles."""
    import duckdb

    from lexigrid.llm.queries import OP3_SQL

    r = random.Random(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(1000 + i, t) for i, t in repeating(5)]
    docs += [(2000, " ".join(f"w{k}" for k in range(80))), (2001, " ".join(f"w{k}" for k in range(80)) + " p q" * 1000)]
    passage = " ".join(f"q{k}" for k in range(9))
    for i in range(12):  # alike by counts, not as sets
        docs.append((3000 + i, " ".join([passage] * 60 + [f"n{i}_{k}" for k in range(r.randrange(8, 20))])))
    documents = spark.createDataFrame(docs, DOC)
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    got = sorted(map(tuple, near_duplicates(documents).collect()))
    assert got == sorted(con.execute(OP3_SQL).fetchall())
    by = dict(got)
    assert by[2001] == 2000 and by[3011] == 3000 != brute_classes(docs)[3011]


def test_near_shared_doc_id(spark):
    """Rows of one doc_id are one document: the texts' classes are one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (1, a + " tail"), (7, b + " tail"), (9, c)]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, DOC)).collect()))
    assert got == [(1, 1), (5, 1), (5, 1), (5, 1), (7, 1), (9, 9)]


@pytest.mark.parametrize("few", [0, 10**6])
def test_near_by_either_join(spark, monkeypatch, few):
    monkeypatch.setattr(N, "BROADCAST_IDS", few)
    docs = planted(7, 2)[::2]
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, DOC)).collect()} == brute_classes(docs)


def test_prefix_filter_finds_repeated_passages(spark):
    docs = repeating(20)
    near = N.NearDuplicates(spark.createDataFrame(docs, DOC))
    members = spark.createDataFrame([(i, i) for i, _ in docs], "rep long, comp long")
    pairs = {tuple(r) for r in near.prefix_pairs(members, near.docs).distinct().collect()}
    assert {(i, i + 1) for i in range(0, 40, 2)} <= pairs


def test_prob_minhash_estimates():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        items = r.integers(0, 2**63, 60).astype(np.uint64)
        a, b = np.sort(items[:50]), np.sort(items[10:])
        wa, wb = r.integers(1, 5, 50).astype(float), r.integers(1, 5, 50).astype(float)
        both = prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 50), 2, 512)
        assert (both[1] == prob_minhash(b, wb, np.zeros(50, dtype=int), 1, 512)[0]).all()
        estimate = (both[0] == both[1]).mean()
        naive = 0.0
        da, db = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
        for i in set(da) & set(db):
            naive += 1 / sum(max(da.get(j, 0) / da[i], db.get(j, 0) / db[i]) for j in set(da) | set(db))
        exact = similarity((a, wa), (b, wb))[0]
        assert abs(exact - naive) < 1e-9
        errors.append(estimate - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert (prob_minhash(np.array([7], dtype=np.uint64), np.array([1.0]), np.array([0]), 1, 80) == 7).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {x.v: x.comp for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_near_odd(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == 13 and near_duplicates(none).count() == 0
    by = {r.doc_id: r.class_id for r in rows}
    assert by[5] == 4 and by[6] == 4 and by[2] == 1 and by[0] == 0 and by[None] is None and by[3] == 3
    assert odd.select(F.count("*")).first()[0] == 13
