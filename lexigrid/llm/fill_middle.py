"""Fill-in-middle transformation by a two-pass streaming matcher of constant memory.

A text is cut into units, the matches of a pattern from left to right. The first pass counts them. A hash of doc_id draws two ranks
among the counts 0 to n; the second pass starts the matcher again and advances it, match by match, to the smaller rank and then to
the larger one. Only the ends of these two matches are kept, so no list of units exists, however long a text is. The rest is string slices.

Draws are the first four groups of eight hex digits of sha256("seed:doc_id"). The first two give the ranks, the third whether
a text is transformed at all, the fourth the order: prefix first (psm) or suffix first (spm).

Edge cases: a null or empty text is plain and comes out as it is, an empty text (n is 0); a text that holds a marker is plain, so each
output can be taken apart again; a rank of 0 cuts before the first unit, a rank of n at the end of the text, and text between or after
matches of another pattern belongs to the unit that follows, or to the suffix; a null doc_id draws as an empty one; repeated
rows get the same result, rows that share a doc_id the same draws; an empty table gives an empty one; other columns pass through, and where
one has the name of an added column, that one is added with underscores in front. Very long texts take memory for the text and its output.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexigrid.llm.common import BATCH_ROWS, free_name, small_batches

#: Lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred texts so many are transformed, and of a hundred of these so many put the suffix first.
RATE, SPM_RATE = 100, 50


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cuts(text: str, units: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle), for draws that are reduced modulo n + 1."""
    n = sum(1 for _ in units.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches = units.finditer(text)

    def end(steps: int, before: int) -> int:
        """Where the match is that lies so many steps ahead."""
        found = next(islice(matches, steps - 1, None), None) if steps else None
        return before if found is None else found.end()

    prefix = end(low, 0)
    middle = end(high - low, prefix)
    return n, len(text) if low == n else prefix, len(text) if high == n else middle


def transform(text: str, doc_id: int | None, units: re.Pattern, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, characters of the prefix, characters of the middle, output)."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n, a, b = cuts(text, units, h1, h2)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def _rows(pattern: str, seed: int, rate: int, spm_rate: int, names: list[str], id_at: int, text_at: int):
    """Batches of the table with n, form, prefix_chars, middle_chars, output behind its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                made = [transform(t.as_py() or "", d.as_py(), units, seed, rate, spm_rate) for d, t in zip(part.column(id_at), part.column(text_at), strict=True)]
                cols = list(zip(*made, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return run


def fill_in_middle(docs: DataFrame, pattern: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with fim_n (units), fim_form (plain, psm, spm), fim_prefix_chars, fim_middle_chars (null where plain) and fim_output."""
    small_batches(docs.sparkSession)
    types = {"fim_n": "long", "fim_form": "string", "fim_prefix_chars": "long", "fim_middle_chars": "long", "fim_output": "string"}
    added = {free_name(docs, k): t for k, t in types.items()}
    schema = StructType(list(docs.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    low = [c.lower() for c in docs.columns]
    run = _rows(pattern, seed, rate, spm_rate, schema.names, low.index("doc_id"), low.index("text"))
    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its markers occur once each, as texts that hold one stay plain."""
    after = lambda x, mark, k: F.split_part(x, F.lit(mark), F.lit(k))
    psm = F.concat(after(after(output, PREFIX, 2), SUFFIX, 1), after(output, MIDDLE, 2), after(after(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(after(after(output, PREFIX, 2), MIDDLE, 1), after(output, MIDDLE, 2), after(after(output, SUFFIX, 2), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
