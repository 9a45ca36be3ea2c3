import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from lexigrid.llm.byte_bpe import load_ranks
from tests.llm.conftest import CLASHES


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {"": docs}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, sf)
        if k + 1 < len(P.STAGES):
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    texts = {k: {r.doc_id: r.text for r in v.collect()} for k, v in seen.items() if k != "byte_bpe"}
    from lexigrid.llm.toxicity import held_out, learn
    from tests.llm.test_text_ops import brute_score

    model = learn(seen[""], spark.read.parquet(f"{sf}/labels.parquet").filter(~held_out(F.col("doc_id"))))
    bad = {i for i, t in texts[""].items() if brute_score(t, model) >= 0.5}
    assert texts["toxicity"] == {i: t for i, t in texts[""].items() if i not in bad} and bad
    from tests.llm.test_dedup import brute_classes, brute_cut, brute_lines

    firsts = {i for i, c in brute_classes(list(texts["toxicity"].items())).items() if i == c}
    uncut = {i: t for i, t in texts["toxicity"].items() if i in firsts}
    cut = {i: brute_cut(uncut[i], gone) if gone else uncut[i] for i, gone in brute_lines(list(uncut.items()))}
    assert texts["line_dedup"] == cut and len(cut) < len(texts["toxicity"]) and cut != uncut
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    classes = brute_classes(list(texts["line_dedup"].items()))
    assert set(texts["near_dedup"]) == {i for i, c in classes.items() if i == c}
    assert texts["mixing"].items() <= texts["near_dedup"].items()
    again = {r.doc_id: r["count"] for r in P.mix(spark, seen["near_dedup"], sf).groupBy("doc_id").count().collect()}
    assert again == {r.doc_id: r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = seen["byte_bpe"].collect()
    assert len(rows) == seen["mixing"].count()
    assert all(r.round_trip and r.ids == enc.encode_ordinary(texts["mixing"][r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
    digest = lambda df: sorted((r.doc_id, hashlib.sha256(repr(r.ids).encode()).hexdigest()) for r in df.collect())
    assert digest(P.run(spark, sf)) == digest(seen["byte_bpe"])


def test_odd_documents(spark, odd, none, sf):
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        if name == "toxicity":
            assert out.count() == 13
        assert stage(spark, none, sf).count() == 0
    assert P.encode(spark, odd, sf).filter(~F.col("round_trip")).isEmpty() and P.encode(spark, none, sf).count() == 0
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))
    assert ids(P.drop_common_lines(spark, odd, sf)) == ids(P.drop_near_duplicates(spark, odd, sf).unionByName(odd.filter("doc_id = 4").limit(2)))
    for stage in (P.drop_common_lines, P.drop_near_duplicates, P.mix, P.drop_toxic):
        for r in stage(spark, odd, sf).collect():
            assert (r["__toxic"], r["__later"], r["__gone"], r["__op5_rate"], r["__op5_count"], r["__op2_gone"], r["__row"]) == CLASHES
    assert ids(P.drop_near_duplicates(spark, odd, sf)) == [0, 1, 3, 4, 7, 8, 9, None]
    assert P.mix(spark, odd, sf).columns == odd.columns


def test_rows_of_one_doc_id(spark, sf):
    """Of several rows of a doc_id that stays, near_dedup leaves the least."""
    docs = spark.createDataFrame([(1, "b c d e f g"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "x y z"), (3, "x y z"), (None, "a"), (None, "a")], "doc_id long, text string")
    assert sorted(map(str, P.drop_near_duplicates(spark, docs, sf).collect())) == sorted(map(str, spark.createDataFrame([(1, "a b c d e f"), (None, "a"), (None, "a")], docs.schema).collect()))


def test_copies_go_whole(spark, sf):
    """A near copy leaves no scrap; a document made of others' lines and text of its own keeps that."""
    lines = [f"line {k} of the text has seven words" for k in range(10)]
    docs = [(1, "\n".join(lines)), (2, "\n".join([*lines[:9], "another line ends the copy of it"])), (3, "\n".join(lines[:5] + [f"own {k} line of the third text here" for k in range(5)])), (4, "")]
    kept = {r.doc_id: r.text for r in P.drop_common_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    assert set(kept) == {1, 3, 4} and kept[3].count("\n") == 4


def test_text_of_its_own_stays(spark, sf):
    """A document of which four fifths stand in two earlier ones, but near neither of them."""
    lines = lambda name, n: "\n".join(f"{name} {k} is a line of {k * k} words and {k * 7} letters" for k in range(n))
    docs = [(1, lines("first", 90)), (2, lines("second", 90)), (3, "\n".join([lines("first", 90), lines("second", 90), lines("own", 40)]))]
    kept = {r.doc_id: r.text for r in P.drop_common_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    assert kept == {1: docs[0][1], 2: docs[1][1], 3: lines("own", 40)}


def test_near_copies_of_cut_documents_go(spark, sf):
    """The second near copy shares a block with a third document: cut first, it would be no copy any more."""
    own = [f"line {k} of the text has seven words" for k in range(20)]
    edited = [*own[:19], "line nineteen is another one in this copy"]
    docs = [(1, "\n".join(own[:10] + [f"else {k} and nothing more of this" for k in range(30)])), (2, "\n".join(own)), (3, "\n".join(edited))]
    kept = {r.doc_id: r.text for r in P.drop_common_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    assert set(kept) == {1, 2} and kept[2] == "\n".join(own[10:])


def test_run_leaves_only_what_its_result_reads(spark, sf):
    from lexigrid.llm import common

    common.drop_stashes(spark)
    rows = P.run(spark, sf)
    assert len(common.STASHED) == 1 and rows.count() > 0
