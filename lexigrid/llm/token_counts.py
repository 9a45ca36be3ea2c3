"""Token counts by a linear longest-match automaton.

Each state of the vocabulary trie holds a failure link and how many pieces are popped on the way there: the
greedy pieces that the state's string begins with are counted once, when the automaton is built, so a
word is read once, character by character, and its pieces are never built. Greedy: from the left, the longest
piece of the vocabulary; a word starts with the mark of word starts; a character that is no piece itself
counts as the bytes of its UTF-8 form, as in a vocabulary with byte fallback.

Edge cases: a null or empty text has no words and no tokens; doc_id is passed on as it is; an empty table gives an
empty one; other columns are not looked at; very long words cost time in proportion to their length.
"""

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import Recent, as_bytes, small_batches

#: What a vocabulary puts before the pieces that start a word.
MARK = "▁"


def load_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """next: state -> {character: state}; fail: state -> state; pops: tokens that are counted when failing there.

    A character that begins a piece without being one is given a state that pops its bytes, so that every
    path can be popped whole."""

    def __init__(self, pieces: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        weight: list[int] = [0]

        def insert(text: str, tokens: int) -> None:
            at = 0
            for ch in text:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    weight.append(0)
                at = to
            weight[at] = weight[at] or tokens

        for piece in pieces:
            insert(piece, 1)
        for ch in {c for piece in pieces for c in piece}:
            insert(ch, len(ch.encode("utf-8", "surrogatepass")))
        # fail: the state of what is left of a state's string once as many of its greedy pieces are popped as
        # leave a string that is a path of the trie
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for ch, to in self.next[at].items():
                todo.append(to)
                if weight[to]:
                    self.pops[to] = weight[to]
                else:
                    z, n = self.fail[at], self.pops[at]
                    while ch not in self.next[z]:
                        z, n = self.fail[z], n + self.pops[z]
                    self.fail[to], self.pops[to] = self.next[z][ch], n

    def count(self, word: str) -> int:
        """Tokens of the greedy longest-match segmentation of a word."""
        nexts, fail, pops = self.next, self.fail, self.pops
        total = at = 0
        for ch in word:
            while (to := nexts[at].get(ch)) is None:
                if not at:
                    total += len(ch.encode("utf-8", "surrogatepass"))
                    break
                total += pops[at]
                at = fail[at]
            else:
                at = to
        while at:
            total += pops[at]
            at = fail[at]
        return total


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens of every document. The vocabulary is sent out once, as a broadcast variable."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shipped.value)
        cache = Recent(lambda word: automaton.count(MARK + word.decode("utf-8", "surrogatepass")))
        for batch in batches:
            words = [as_bytes(t).split() for t in batch.column("text").to_pylist()]
            tokens = [sum(map(cache.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
