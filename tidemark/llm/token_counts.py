"""Exact token counts by prefix dynamic programming.

For every prefix of a word the last piece of its encoding is the one piece
that agrees with the last piece of the shorter prefix in front of it; the
count follows. A text's count at any character is the count of the words
before plus the count inside the word, so truncation and budget questions need
no further encoding. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .pieces import load, slices
from .runtime import pick


def text_counts(pieces, text: str | None) -> list[int]:
    """Tokens of text[:0], text[:1], ..., text[:]."""
    if not text:
        return [0]
    out, base = [], 0
    for counts in pieces.count_words(pieces.split(pieces.spaced(text))):
        out += [base + int(c) for c in counts]
        base += int(counts[-1])
    return [0, *out[1:]]


def count(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each whole text, without added tokens.

    One row per input row, repeated rows included, in no order; so there are no
    ties. A null text counts as empty and has no tokens; a null doc_id stays
    null. Whole texts, of any length. An empty table gives an empty result;
    columns beside doc_id and text are not looked at.
    """

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            for start, stop in slices(texts):
                tokens = pieces.count_texts(texts[start:stop])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], sizes[start:stop], pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, counts: the exact token count after 0, 1, 2, ... characters.

    One row per input row; a null or empty text has the count 0 alone, an empty
    table gives an empty result.
    """

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts):
                counts = [text_counts(pieces, t) for t in texts[start:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, counts array<int>")


def truncate(docs: DataFrame, model: str, budget: int) -> DataFrame:
    """doc_id, n_tokens, text: the longest prefix of which no shorter prefix, nor itself, has more than `budget` tokens.

    One row per input row; a null text is cut as the empty one, an empty table
    gives an empty result.
    """

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts):
                kept = []
                for t in texts[start:stop].to_pylist():
                    counts = text_counts(pieces, t)
                    n = max(0, bisect_right(list(accumulate(counts, max)), budget) - 1)
                    kept.append((counts[n], (t or "")[:n]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string())], ["doc_id", "n_tokens", "text"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, n_tokens long, text string")
