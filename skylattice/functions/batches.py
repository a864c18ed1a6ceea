"""Whole groups of sorted rows from Arrow batches, many small ones at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

HELD_ROWS = 60_000  # rows that are worked on at once, more where one group has more


def codes(table: pa.Table, name: str) -> np.ndarray:
    """Numbers of a column that are equal where the values are; NULL counts as a value."""
    return table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether a row differs from the one before in one of the columns."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in names:
        code = codes(table, name)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], held_rows: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups; the rows come sorted by ``names``."""
    enough = HELD_ROWS if held_rows is None else held_rows
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        # the last group may go on in the next batch
        last = int(np.flatnonzero(changes(table, names))[-1])
        if last:
            yield table.slice(0, last).combine_chunks()
        held, n = table.slice(last).to_batches(), 0
    if n or held:
        yield pa.Table.from_batches(held).combine_chunks()
