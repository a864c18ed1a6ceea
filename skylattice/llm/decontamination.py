"""Passages of benchmark items inside documents, by one Aho-Corasick automaton.

Items and texts are folded to words joined by single spaces. Every ``size`` consecutive words of an
item are a pattern, and so is a whole item of fewer words. The automaton over all patterns reads a
text once; what it finds is mapped back to code points of the text as it was.

The patterns are measured before they are sent to the tasks: up to ``PART_BYTES`` of them make one
automaton. A larger benchmark is dealt into parts, each with an automaton and a pass of its own
over the texts, and the parts of a row are put together again, so no bound on the benchmark is needed.

Defined results: null and empty texts have no words and no passages, items without words no
patterns. Items that share an id count once; an item without an id marks words but is not
named. Repeated documents are treated alike; documents without an id keep their rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from skylattice.llm.common import materialize, per_batch, to_bytes
from skylattice.llm.plain_words import FOLD, plain_words

SIZE = 10
PART_BYTES = 2 << 20  # folded patterns of one automaton, about 60 bytes of memory each
ENTRY_BYTES = 16  # what one more item of a pattern adds

SPAN = StructType().add("start", IntegerType()).add("end", IntegerType()).add("first_word", IntegerType()).add("last_word", IntegerType())
FOUND = StructType().add("n_words", LongType()).add("spans", ArrayType(SPAN)).add("items", ArrayType(StringType()))


def item_patterns(items: DataFrame, item_id: str, text: str, size: int = SIZE) -> DataFrame:
    """(pattern, n, item): the distinct windows of every item, ``n`` words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, lengths, owners = [], [], []
            for item, raw in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                words = plain_words(raw)
                n = min(size, len(words))
                for at in range(len(words) - n + 1 if n else 0):
                    patterns.append(b" ".join(words[at : at + n]).decode())
                    lengths.append(n)
                    owners.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array(lengths, pa.int32()), pa.array(owners, pa.string())], ["pattern", "n", "item"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "pattern string, n int, item string").distinct()


@lru_cache(maxsize=1)
def _automaton(key: str, shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of one part, once per worker. A pattern starts and ends at the spaces around its words."""
    items: dict[str, tuple[int, set[str]]] = {}
    for pattern, n, item in shared.value:
        own = items.setdefault(f" {pattern} ".encode().decode("latin-1"), (n, set()))[1]
        if item is not None:
            own.add(item)
    automaton = ahocorasick.Automaton()
    for plain, (n, owners) in items.items():
        automaton.add_word(plain, (n, len(plain.rstrip(" ")), tuple(owners)))
    if items:
        automaton.make_automaton()
    return automaton


def passages(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """(words, runs of hit words as (start, end, first word, last word), items found) of one text."""
    folded = text.translate(FOLD)
    words = folded.split()
    if not words or not len(automaton):
        return len(words), [], []
    plain = b" " + b" ".join(words) + b" "
    found = [(end, n, owners) for end, (n, _, owners) in automaton.iter(plain.decode("latin-1"))]
    if not found:
        return len(words), [], []
    ends = np.array([f[0] for f in found])
    sizes = np.array([f[1] for f in found])
    last = np.searchsorted(np.flatnonzero(np.frombuffer(plain, np.uint8) == 32), ends) - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - sizes + 1, 1)
    np.add.at(change, last + 1, -1)
    hit = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)
    steps = np.diff(hit)
    first_words, last_words = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) - 1
    # the same words in the text itself, in code points
    inside = np.concatenate([[0], np.frombuffer(folded, np.uint8) != 32, [0]]).astype(np.int8)
    edge = np.diff(inside)
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spans = zip(points[begins[first_words]].tolist(), points[stops[last_words]].tolist(), first_words.tolist(), last_words.tolist(), strict=True)
    return len(words), list(spans), sorted(set().union(*(f[2] for f in found)))


def _scan(shared: Broadcast, key: str, column: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([(name, pa.int32()) for name in ("start", "end", "first_word", "last_word")]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = _automaton(key, shared)
        found = [passages(t or b"", automaton) for t in to_bytes(batch.column(column))]
        spans = [[dict(zip(("start", "end", "first_word", "last_word"), s, strict=True)) for s in f[1]] for f in found]
        added = pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array(spans, spans_type), pa.array([f[2] for f in found], pa.list_(pa.string()))], ["n_words", "spans", "items"]
        )
        return pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != column] + [added], [n for i, n in enumerate(batch.schema.names) if i != column] + ["found"])

    return work


def _pass(rows: DataFrame, patterns: list[tuple]) -> DataFrame:
    """``rows`` (…, _text) with ``found`` in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(patterns)
    names = [c for c in rows.columns if c != "_text"]
    schema = StructType([rows.schema[c] for c in names]).add("found", FOUND)
    return per_batch(rows.select(*names, "_text"), _scan(shared, uuid.uuid4().hex, len(names)), schema)


def _united(spans: list) -> list:
    """Runs of several parts as runs of their union; neighbouring words belong to one run."""
    out: list[list[int]] = []
    for start, end, first, last in sorted(((s["start"], s["end"], s["first_word"], s["last_word"]) for s in spans), key=lambda s: s[2]):
        if out and first <= out[-1][3] + 1:
            if last > out[-1][3]:
                out[-1][1], out[-1][3] = end, last
        else:
            out.append([start, end, first, last])
    return out


def benchmark_passages(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` and ``found``: its number of words, the ``spans`` of
    words that stand inside an item's pattern (code points, end exclusive, and word numbers), and the
    ids of those ``items`` as sorted strings."""
    patterns = materialize(item_patterns(items, item_id, item_text, size), "patterns")
    total = patterns.agg(F.sum(F.octet_length("pattern") + ENTRY_BYTES)).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    if parts == 1:
        rows = docs.select(*keep, F.col(text).alias("_text"))
        return _pass(rows, [tuple(r) for r in patterns.collect()])
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text")), "rows")
    part = F.pmod(F.xxhash64("pattern", "item"), F.lit(parts))
    found = None
    for p in range(parts):
        own = materialize(_pass(rows.select("_row", "_text"), [tuple(r) for r in patterns.where(part == p).collect()]), "found")
        found = own if found is None else found.unionByName(own)
    unite = F.udf(_united, ArrayType(SPAN))
    merged = found.groupBy("_row").agg(
        F.max("found.n_words").alias("n_words"), F.flatten(F.collect_list("found.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items")
    )
    merged = merged.select("_row", F.struct("n_words", F.when(F.size("spans") > 1, unite("spans")).otherwise(F.col("spans")).alias("spans"), "items").alias("found"))
    return rows.drop("_text").join(merged, "_row").drop("_row")


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    found = benchmark_passages(docs, items, size=size)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without any passage of an item, all columns as they are."""
    marked = benchmark_passages(docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_checked")), items, ("_doc",), "_checked", size=size)
    return marked.where(F.size("found.spans") == 0).select("_doc.*")
