"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is a short list of terms of abuse, and what the labels teach: words and word beginnings that are
far commoner in documents labelled toxic. It is kept as a trie; for a word of a text, the automaton that accepts
all strings within one edit runs along the trie's edges, so misspelled terms are found without listing their
spellings. Around each hit, a window of words tells quotation (quotation marks, words of reporting) from abuse (words that
address someone). A logistic regression over counts of such hits gives the score. Its weights are fitted
on documents that the learned terms were not taken from.

Only labelled rows that learn() is given are learned from, at most `rows` of them, taken in the order of a hash of doc_id; texts of the same words
count as one, toxic if any of them is. What is collected from them, terms with evidence and a row of numbers a document, is bounded by `rows`.
Language, source and doc_id are never inputs of a score.

Edge cases: null and empty texts have no hits and get the score of no hits; without labels of both kinds the
default weights hold; rows whose label is null are not learned from; doc_id is passed on as it is; an empty table gives
an empty one; other columns are not looked at.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Recent, WordHash, as_bytes, flat_hashes, mix, small_batches, stash, window_hashes

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 12_000
#: What a term's evidence (a log likelihood ratio) must reach for the lexicon of half the rows, and of all; a learned term is in so many
#: toxic documents or more, and they are this share or more of all that it is in.
EVIDENCE_HALF, EVIDENCE, LEAST_TOXIC, LEAST_SHARE = 10.0, 14.0, 4, 0.85
#: Terms of abuse to begin with.
SEEDS = (
    "idiot idiots moron morons stupid loser losers scum trash clown worthless pathetic disgusting imbecile dumb pig filth vermin "
    "idiota imbécil estúpido basura payaso escoria idiote imbécile ordure clochard dummkopf abschaum trottel vollidiot"
).split()
REPORTING = set("said says called calls quoted quote word term wrote reported dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = set("you your you're u tu te toi vous votre du dich dir ihr euch usted ustedes eres are es bist".split())
QUOTES = "\"'“”„«»‚‘’"
WINDOW = 6
#: Lengths of word beginnings that may be learned.
STEMS = (4, 5, 6)
EDIT_FROM = 5  # terms shorter than this match only as they are
#: Weights before any label is seen: bias first, then as in features().
DEFAULT = [-4.0, 3.0, 2.0, 2.5, 0.2, -1.5, 1.0, 0.2, 2.0]
_STRIP = ".,;:!?()[]{}<>*#$%&|…" + QUOTES
_LEET = str.maketrans("013457@$", "oieastas")


class Lexicon:
    """A trie of terms; a stem's end accepts any continuation."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.exact = {t for t, stem in terms if not stem}
        self.stems = {t for t, stem in terms if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.trie: dict = {}
        self.halves: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for term in self.exact:
            if len(term) >= EDIT_FROM:
                node = self.trie
                for ch in term:
                    node = node.setdefault(ch, {})
                node[""] = term
                half = len(term) // 2  # one edit leaves one of the halves as it is
                self.halves.setdefault(half, set()).add(term[:half])
                self.tails.setdefault(len(term) - half, set()).add(term[half:])

    def near(self, word: str) -> str | None:
        """The longest term within one edit of a word: the automaton's states (place, edits) are carried along the trie."""
        if not (any(word[:k] in s for k, s in self.halves.items()) or any(word[-k:] in s for k, s in self.tails.items())):
            return None
        n, found = len(word), None
        todo = [(self.trie, frozenset({(0, 0), (1, 1)}))]
        while todo:
            node, states = todo.pop()
            if "" in node and any(n - i + e <= 1 for i, e in states):
                found = max(found or "", node[""], key=lambda t: (len(t), t))
            for ch, to in node.items():
                if ch:
                    after = set()
                    for i, e in states:
                        if i < n and word[i] == ch:
                            after.add((i + 1, e))
                        if e == 0:
                            after |= {(i, 1), (min(i + 1, n), 1)}
                            if i + 1 < n and word[i + 1] == ch:
                                after.add((i + 2, 1))
                    if after:
                        todo.append((to, frozenset(after)))
        return found

    def kind(self, word: str) -> int:
        """0: no term; 1: a term; 2: begins like one; 3: a long term misspelled; 4: a short one."""
        if word in self.exact:
            return 1
        if any(word[:k] in self.stems for k in self.stem_sizes if len(word) >= k):
            return 2
        if len(word) >= EDIT_FROM - 1 and (term := self.near(word)):
            return 3 if len(term) >= 7 else 4
        return 0


def plain(token: str) -> str:
    """A word without the marks around it, in lower case, with digits and signs within it read as letters."""
    word = token.strip(_STRIP).lower()
    if word and not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    return word


class Kinds(Recent):
    """kind() of the words of texts, as bytes."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__(lambda token: lexicon.kind(plain(token.decode("utf-8", "surrogatepass"))))


def features(text: str | None, kinds: Kinds) -> list[float]:
    tokens = as_bytes(text).split()
    hits = [(i, k) for i, k in enumerate(map(kinds.__getitem__, tokens)) if k]
    count = [0] * 5
    quoted = directed = 0
    misspelled = len({tokens[i] for i, k in hits if k == 3}), len({tokens[i] for i, k in hits if k == 4})
    for i, k in hits:
        count[k] += 1
        around = [t.decode("utf-8", "surrogatepass") for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
        at = min(i, WINDOW)
        before, after = around[: at + 1], around[at:]
        inside = any(t[0] in QUOTES for t in before) and any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
        near = {plain(t) for t in around}
        quoted += inside or bool(near & REPORTING)
        directed += not inside and bool(near & ADDRESS)
    dense = min(10.0, 100 * (count[1] + count[2]) / (len(tokens) + 30))
    logs = [math.log1p(x) for x in (count[1], count[2], *misspelled, quoted, directed)]
    return [*logs, dense, float(count[1] + count[2] > 0)]


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30, prior: list[float] = DEFAULT) -> list[float]:
    """Weights near the prior where the rows say nothing, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, start, penalty = np.array(prior), np.array(prior), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ (w - start))
    return w.tolist()


def _half(h: np.ndarray) -> int:
    """0 or 1 by the least hash of the text's five-word shingles, so that near copies are mostly in one half."""
    shingles = mix(window_hashes(h, 5)) if len(h) >= 5 else mix(h)
    return int(shingles.min() >> np.uint64(1)) % 2 if len(shingles) else 0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> words (a digest, equal for texts of the same words), toxic, half, terms (w: words, s: beginnings)."""
    cache = WordHash()
    for batch in batches:
        same, half, terms = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = as_bytes(text).split()
            h, _ = flat_hashes([tokens], cache)
            same.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
            half.append(_half(h))
            words = {w for w in (plain(t.decode("utf-8", "surrogatepass")) for t in set(tokens)) if len(w) >= 3}
            terms.append(["w" + w for w in words] + ["s" + w for w in {w[:k] for w in words for k in STEMS if len(w) > k}])
        yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), batch.column("toxic"), pa.array(half, pa.int32()), pa.array(terms, pa.list_(pa.string()))], ["words", "toxic", "half", "terms"])


def _contexts(terms: set[str]):
    """text, toxic -> term, context (a hash of the words before and after), toxic for every place of a term."""

    def own_terms(token: bytes) -> list[str]:
        word = plain(token.decode("utf-8", "surrogatepass"))
        return [t for t in ("w" + word, *("s" + word[:k] for k in STEMS if len(word) > k)) if t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Recent(own_terms)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tokens = as_bytes(text).split()
                for i, own in enumerate(map(known.__getitem__, tokens)):
                    if own:
                        context = xxhash.xxh3_64_intdigest(b" ".join(tokens[max(0, i - 1) : i] + [b"|"] + tokens[i + 1 : i + 2])) >> 1
                        out += [(t, context, toxic) for t in own]
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["term", "context", "toxic"])

    return run


def evidence(bad: Column, good: Column, base: float) -> Column:
    """How much better a term's own share of toxic documents explains where it is than the share of all documents does."""
    share = bad / F.greatest(bad + good, F.lit(1))
    clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    found = (bad + good) * (share * F.log(share / base) + clean)
    return F.when((bad >= LEAST_TOXIC) & (share >= LEAST_SHARE), found).otherwise(F.lit(0.0))


def _learned(rows: list, column: str) -> list[tuple[str, bool]]:
    """The terms with evidence, without beginnings that are of one word only; rows: term, and the column's evidence and number of documents."""
    found = {r.term: r[f"{column}_bad"] for r in rows if r[column]}
    words = [(t[1:], bad) for t, bad in found.items() if t[0] == "w"]
    covered: dict[str, int] = {}  # by each beginning, the most documents that one word has
    for word, n in words:
        for k in STEMS:
            covered[word[:k]] = max(covered.get(word[:k], 0), n)
    return sorted((t[1:], t[0] == "s") for t, bad in found.items() if t[0] == "w" or bad > 1.2 * covered.get(t[1:], 0))


def _features_of(terms: list[tuple[str, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(Lexicon(terms))
        for batch in batches:
            rows = [features(t, kinds) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "f"])

    return run


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic, only rows that may be learned from."""
    small_batches(docs.sparkSession)
    seeds = [(t, False) for t in SEEDS]
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(rows)
    # at most `rows` rows are sent out
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    train = stash(own.select("text", "toxic"), "op6-train")
    # texts of the same words are one document, toxic if any of them is
    terms = train.mapInArrow(_terms, "words binary, toxic int, half int, terms array<string>").groupBy("words").agg(F.max(F.struct("toxic", "half", "terms")).alias("x"))
    terms = stash(terms.select("x.*"), "op6-terms")
    n = {(r["half"], r["toxic"]): r["count"] for r in terms.groupBy("half", "toxic").count().collect()}
    total = lambda bad: n.get((0, bad), 0) + n.get((1, bad), 0)
    if not total(1) or not total(0):
        return Model(seeds, DEFAULT)
    number = lambda half, bad: F.sum(((F.col("half") == half) & (F.col("toxic") == bad)).cast("int"))
    counts = terms.select("half", "toxic", F.explode("terms").alias("term")).groupBy("term").agg(*[number(h, b).alias(f"c{h}{b}") for h in (0, 1) for b in (0, 1)])
    share = {"half": n.get((0, 1), 0) / max(1, n.get((0, 1), 0) + n.get((0, 0), 0)), "whole": total(1) / (total(1) + total(0))}
    enough = {"half": EVIDENCE_HALF, "whole": EVIDENCE}
    bad, good = {"half": F.col("c01"), "whole": F.col("c01") + F.col("c11")}, {"half": F.col("c00"), "whole": F.col("c00") + F.col("c10")}
    # evidence grows with the toxic documents, and contexts only take some away: no term is lost here that would have enough
    sound = lambda name, some: (evidence(some, good[name], share[name]) >= enough[name]) if 0 < share[name] < 1 else F.lit(False)
    likely = stash(counts.filter(sound("half", bad["half"]) | sound("whole", bad["whole"])), "op6-likely")
    asked = {r.term for r in likely.select("term").collect()}
    # copies of a document repeat a word in one context; a term of abuse has many
    found = train.mapInArrow(_contexts(asked), "term string, context long, toxic int").filter("toxic = 1").groupBy("term").agg(F.count_distinct("context").alias("contexts"))
    known = likely.join(found, "term", "left").withColumn("contexts", F.coalesce("contexts", F.lit(0)))
    least = {name: F.least(bad[name], F.col("contexts")) for name in bad}
    rows = known.select("term", *[sound(name, least[name]).alias(name) for name in bad], *[least[name].alias(f"{name}_bad") for name in bad]).collect()
    half, whole = _learned(rows, "half"), _learned(rows, "whole")
    seen = train.select("text", "toxic").mapInArrow(_other_half, "text string, toxic int")
    fitted = seen.mapInArrow(_features_of(seeds + half), "toxic int, f array<double>").collect()
    x, y = np.array([r.f for r in fitted]), np.array([float(r.toxic) for r in fitted])
    if not len(y) or y.min() == y.max():
        return Model(seeds + whole, DEFAULT)
    return Model(seeds + whole, fit_logistic(x, y))


def _other_half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the half that the half lexicon isn't taken from."""
    cache = WordHash()
    for batch in batches:
        yield batch.filter(pa.array([_half(flat_hashes([as_bytes(text).split()], cache)[0]) == 1 for text in batch.column("text").to_pylist()], pa.bool_()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_hits of every document."""
    small_batches(docs.sparkSession)
    terms, weights = model.terms, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds(Lexicon(terms))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                z = weights[0] + sum(a * b for a, b in zip(weights[1:], features(text, kinds), strict=True))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are not looked at."""
    model = learn(docs, labels.filter(~held_out(F.col("doc_id"))), rows)
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
