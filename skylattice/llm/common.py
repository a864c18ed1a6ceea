"""Reading, materialising and small numeric helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from skylattice.session import materialize

__all__ = ["BoundedCache", "materialize", "per_batch", "pieces", "small_batches", "table", "to_bytes", "word_numbers"]


PIECE_ROWS = 512
PIECE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class BoundedCache(dict):
    """Remembers ``compute(key)`` for up to twice ``limit`` keys: beyond ``limit`` the entries become the
    older half, from which a key that is asked for again comes back."""

    def __init__(self, compute: Callable, limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def to_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    raw = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    return raw.to_numpy(zero_copy_only=False).tolist()


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A text column in slices of at most ``PIECE_BYTES``, or of one text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + PIECE_BYTES, side="right")))
        yield texts[start:stop]
        start = stop


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts, cut at ASCII white space: per word the place of its text and its number in the vocabulary; the vocabulary."""
    lists = pc.ascii_split_whitespace(texts)
    cuts = lists.flatten()
    filled = pc.greater(pc.binary_length(cuts), 0)  # white space at an end leaves an empty one
    numbered = cuts.filter(filled).dictionary_encode()
    place = pc.list_parent_indices(lists).filter(filled)
    return place.to_numpy(), numbered.indices.to_numpy(), numbered.dictionary


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session passes at most ``PIECE_ROWS`` rows at a time to Python, which bounds the buffers on both sides."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= PIECE_ROWS:
        conf.set(name, str(PIECE_ROWS))
    return df


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``work`` on every Arrow batch of at most ``PIECE_ROWS`` rows: it must only need its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return small_batches(df).mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
