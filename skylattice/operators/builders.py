"""Named builders, and runs in chunks that report and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skylattice.session import path_exists, scratch_path

POLL_SECONDS = 0.2

_BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Make a compute path available under a name a product can refer to."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _BUILDERS:
            raise ValueError(f"builder {name!r} exists")
        _BUILDERS[name] = fn
        return fn

    return add


def names() -> list[str]:
    return sorted(_BUILDERS)


def build(name: str, *args, **kwargs) -> DataFrame:
    if name not in _BUILDERS:
        raise KeyError(f"no builder {name!r}; known: {', '.join(names())}")
    return _BUILDERS[name](*args, **kwargs)


class Cancelled(RuntimeError):
    """The run was cancelled; what it had finished is in its folder."""


class Progress(NamedTuple):
    """How far a run is: chunks done of all, rows and values of the last one, and its result."""

    done: int
    total: int
    rows: int
    values: int
    result: DataFrame


def run_chunks(
    spark: SparkSession, chunks: Sequence[DataFrame], value: str, on_chunk: Callable[[Progress], None] | None = None, cancel: threading.Event | None = None, folder: str | None = None
) -> DataFrame:
    """The results of ``chunks`` (frames of one schema), run and written one after the other.

    ``on_chunk`` hears of each as it lands, with the counts gathered while it ran. ``cancel`` may be set from any
    thread: a chunk that runs is interrupted by the tag of its jobs, no other starts, and ``Cancelled`` is raised. A chunk
    found whole in ``folder`` is not run again, so a cancelled run goes on from there.
    """
    if not chunks:
        raise ValueError("no chunks to run")
    path = folder or scratch_path(spark, "chunks")
    sc, tag, over = spark.sparkContext, f"chunks-{uuid.uuid4().hex}", threading.Event()
    cancel = cancel or threading.Event()

    def watch() -> None:
        while not over.wait(POLL_SECONDS):
            if cancel.is_set():
                sc.cancelJobsWithTag(tag)

    if cancel.is_set():
        raise Cancelled("cancelled before the first chunk")
    schema = chunks[0].schema
    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        for i, chunk in enumerate(chunks):
            if cancel.is_set():
                raise Cancelled(f"cancelled after {i} of {len(chunks)} chunks")
            own = f"{path}/chunk={i}"
            if path_exists(spark, f"{own}/_SUCCESS"):
                done = spark.read.schema(schema).parquet(own)
                counts = done.agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("values")).first().asDict()
            else:
                seen = Observation(f"{tag}-{i}")
                try:
                    chunk.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(value).alias("values")).write.mode("overwrite").parquet(own)
                except Exception as error:
                    if cancel.is_set():
                        raise Cancelled(f"cancelled in chunk {i + 1} of {len(chunks)}") from error
                    raise
                counts = seen.get
            if on_chunk is not None:
                on_chunk(Progress(i + 1, len(chunks), counts["rows"], counts["values"], spark.read.schema(schema).parquet(own)))
    finally:
        over.set()
        sc.removeJobTag(tag)
        watcher.join()
    return spark.read.schema(schema).parquet(*[f"{path}/chunk={i}" for i in range(len(chunks))])
