"""Shards of equal bytes from a k-d tree over document metadata.

The dimensions are the text's size and 16-bit codes of language and source. All nodes of a level
are split in the same passes: each node takes its widest dimension (relative to the root's
width), and distributed histograms over the node's interval, narrowed until one value is left,
give the weighted median; rows of that very value are divided by their number in the order of
document id and checksum in the same way, at the number that leaves the sides nearest to their targets. A node that stands for several shards is
cut in proportion to the shards on either side, down to one each, so every shard gets the target
bytes up to a document or so. Only histograms and split points reach the driver: at most
``HISTOGRAM_ROWS``, or ``LEAST_BINS`` per shard, whatever the number of rows.

Defined results: a null text has size 8 and checksum 0; null languages and sources share code 0;
rows without an id come first among equals; rows that agree in all dimensions and id follow by the
text's checksum, and rows equal in that too are cut by their number; an empty table has no shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.ranks import numbered
from skylattice.llm.common import materialize

HISTOGRAM_ROWS = 65_536
LEAST_BINS = 16
ROW_BYTES = 8
SLOT_ROWS = 5_000  # rows that one window numbers, about
DIMENSIONS = ("d_source", "d_lang", "d_size")


def _code(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(65_536)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, dimensions, row_no) of every row; the row's number only tells equal rows apart."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        _code("source").cast("long").alias("d_source"), _code("lang").cast("long").alias("d_lang"), size.alias("d_size"),
        F.monotonically_increasing_id().alias("row_no"),
    )


@dataclass
class Cut:
    """A node's search: the interval that holds the cut, the size below it and the size wanted on the left."""

    node: int
    lo: int
    hi: int
    target: int
    before: int = 0
    upto: int = 0


def _narrow(rows: DataFrame, cuts: list[Cut]) -> None:
    """Narrows every cut to the smallest key at which the running size reaches its target.

    ``rows`` has (node, key, size)."""
    bins = max(LEAST_BINS, HISTOGRAM_ROWS // len(cuts))
    open_cuts = cuts
    while open_cuts:
        width = {c.node: -(-(c.hi - c.lo + 1) // bins) for c in open_cuts}
        state = rows.sparkSession.createDataFrame([(c.node, c.lo, c.hi, width[c.node]) for c in open_cuts], "node int, lo long, hi long, width long")
        inside = rows.join(F.broadcast(state), "node").where("key BETWEEN lo AND hi")
        # exact whole numbers: the quotient is below 2^53
        place = ((F.col("key") - F.col("lo")).cast("decimal(25,0)") / F.col("width").cast("decimal(25,0)"))
        found = inside.groupBy("node", F.floor(place).cast("long").alias("bin")).agg(F.sum("size").alias("size")).collect()
        histogram: dict[int, list[tuple[int, int]]] = {}
        for node, at, size in found:
            histogram.setdefault(node, []).append((at, size))
        for c in open_cuts:
            upto = c.before
            for at, size in sorted(histogram[c.node]):
                below, upto = upto, upto + size
                if upto >= c.target:
                    break
            c.lo += at * width[c.node]
            c.hi = min(c.hi, c.lo + width[c.node] - 1)
            c.before, c.upto = below, upto
        open_cuts = [c for c in open_cuts if c.lo < c.hi]


def _picked() -> Column:
    """The value of a row's split dimension."""
    value = F.col(DIMENSIONS[0])
    for i, d in enumerate(DIMENSIONS[1:], 1):
        value = F.when(F.col("dim") == i, F.col(d)).otherwise(value)
    return value


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text, lang, source).

    The number of shards is given, or follows from the bytes that a shard should have."""
    spark = docs.sparkSession
    told = materialize(measured(docs), "measured").withColumn("_o", F.struct("doc_id", "text_crc32", "row_no"))
    rows = materialize(numbered(told, (), "_o", "tie").drop("_o", "row_no"), "numbered")
    total = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *(F.max(d).alias(f"w_{d}") for d in DIMENSIONS), *(F.min(d).alias(f"l_{d}") for d in DIMENSIONS)).first()
    if shards is None:
        if not target_bytes:
            raise ValueError("give shards or target_bytes")
        shards = max(1, -(-(total["size"] or 0) // target_bytes))
    root = {d: max(1, (total[f"w_{d}"] or 0) - (total[f"l_{d}"] or 0)) for d in DIMENSIONS}
    # a node is its first shard; ``span`` shards follow from it
    placed = rows.withColumn("node", F.lit(0)).withColumn("span", F.lit(shards))
    widest = shards
    while widest > 1:
        seen = placed.where("span > 1").groupBy("node", "span").agg(
            F.sum("size").alias("size"), *(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), *(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS)
        )
        cuts, dims, left = [], {}, {}
        for n in seen.collect():  # a row per node
            node = n["node"]
            dims[node] = max(range(len(DIMENSIONS)), key=lambda i: ((n[f"hi_{DIMENSIONS[i]}"] - n[f"lo_{DIMENSIONS[i]}"]) / root[DIMENSIONS[i]], -i))
            left[node] = n["span"] // 2
            d = DIMENSIONS[dims[node]]
            cuts.append(Cut(node, n[f"lo_{d}"], n[f"hi_{d}"], max(1, round(n["size"] * left[node] / n["span"]))))
        if not cuts:
            break
        chosen = spark.createDataFrame(list(dims.items()), "node int, dim int")
        valued = placed.join(F.broadcast(chosen), "node").withColumn("value", _picked())
        _narrow(valued.select("node", F.col("value").alias("key"), "size"), cuts)
        border = spark.createDataFrame([(c.node, c.lo) for c in cuts], "node int, value long")
        equal = valued.join(F.broadcast(border), ["node", "value"]).select("node", F.col("tie").alias("key"), "size")
        ends = {r["node"]: r for r in equal.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        ties = [Cut(c.node, ends[c.node]["lo"], ends[c.node]["hi"], c.target - c.before) for c in cuts]
        _narrow(equal, ties)
        # the row at the cut goes to the side that it leaves nearer to its target
        splits = [(c.node, dims[c.node], left[c.node], c.lo, t.lo if t.upto - t.target <= t.target - t.before else t.lo - 1) for c, t in zip(cuts, ties, strict=True)]
        at = placed.join(F.broadcast(spark.createDataFrame(splits, "node int, dim int, left int, at long, last long")), "node", "left")
        goes_left = (_picked() < F.col("at")) | ((_picked() == F.col("at")) & (F.col("tie") <= F.col("last")))
        stays = F.col("span") == 1
        placed = at.select(
            *rows.columns, F.when(stays | goes_left, F.col("node")).otherwise(F.col("node") + F.col("left")).alias("node"),
            F.when(stays, F.lit(1)).when(goes_left, F.col("left")).otherwise(F.col("span") - F.col("left")).alias("span"),
        )
        placed = materialize(placed, "placed")
        widest = -(-widest // 2)
    parts = -(-total["n"] // (shards * SLOT_ROWS)) or 1
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("node", "part").agg(F.count("*").alias("rows")).select("node", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    placed = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("node", "part").orderBy("tie")) - 1)
    return placed.join(starts, ["node", "part"]).select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), (F.col("start") + F.col("inside")).alias("slot"))
