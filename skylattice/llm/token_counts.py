"""Token counts of whole texts by a SentencePiece model, in Arrow batches.

No piece of such a model has a word mark behind another character, so a merge never crosses a
space that follows a character other than a space or the mark. A long text is cut there (the
space becomes the next part's own leading mark), the parts are put together to calls of about
equal bytes, and only lengths are kept.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import per_batch

PART_CHARS = 4_096
CALL_BYTES = 1 << 18
LIMIT = 4_096
_MARKS = frozenset(" ▁")


@lru_cache(maxsize=4)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once per worker; refused where a piece would break the cutting rule."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(len(model))):
        raise ValueError("a piece has a word mark inside: texts of this model cannot be cut")
    return model


def parts(text: str) -> list[str]:
    """The text cut at safe spaces into parts of at least ``PART_CHARS``."""
    out, start = [], 0
    while len(text) - start > PART_CHARS:
        at = text.find(" ", start + PART_CHARS)
        while at > 0 and text[at - 1] in _MARKS:
            at = text.find(" ", at + 1)
        if at < 0 or at + 1 == len(text):
            break
        out.append(text[start:at])
        start = at + 1
    out.append(text[start:])
    return out


def counts(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of every text."""
    model = load(path)
    out = np.zeros(len(texts), np.int64)
    call: list[str] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        np.add.at(out, owner, [len(ids) for ids in model.encode(call, num_threads=1)])

    for row, text in enumerate(texts):
        for part in parts(text):
            call.append(part)
            owner.append(row)
            size += len(part.encode())
            if size >= CALL_BYTES:
                flush()
                call, owner, size = [], [], 0
    if call:
        flush()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = counts(texts, path)
        columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
