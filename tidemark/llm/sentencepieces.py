"""SentencePiece encoding and decoding with a score-ordered agenda.

Every word of a text starts as single characters; an agenda of adjacent pairs
gives the best-scoring pair that the vocabulary holds, the leftmost of equals,
until none is left. Every word that is new to a worker is also encoded by the
sentencepiece library, all such words of a slice of an Arrow batch at a time,
and a difference stops the job. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import load, slices
from .runtime import pick


def encode(docs: DataFrame, model: str, check: bool = True) -> DataFrame:
    """doc_id, ids (decimal ids with the end id, joined by one space), n_tokens, decoded.

    One row per input row, repeated rows included, in no order; so there are no
    ties. A null text is encoded as the empty text, which has the end id alone;
    a null doc_id stays null. Whole texts, of any length. An empty table gives
    an empty result; columns beside doc_id and text are not looked at.
    """

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts = batch.column("text")
            for start, stop in slices(texts):
                ids, sizes, decoded = pieces.encode_texts(texts[start:stop], check)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:stop], ids, sizes, decoded], ["doc_id", "ids", "n_tokens", "decoded"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, ids string, n_tokens long, decoded string")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text: what ids joined by one space stand for.

    Null ids give a null text, empty ones the empty text. One row per input
    row; an empty table gives an empty result.
    """

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts = [None if i is None else pieces.decode(i) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(rows, doc_id="bigint", ids="string").mapInArrow(run, "doc_id long, text string")
