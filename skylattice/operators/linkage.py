"""Average linkage of unit vectors and best centres, by products of blocks.

The average correlation of two clusters is the product of their mean unit vectors, so a cluster is one row: its sum
and its size. Every cluster looks for its closest one, block against block, and only the closest of each leaves a task;
links are never listed. Clusters that are each other's closest merge, all at once, which gives the clusters of
merging one closest pair at a time. A merged cluster is no closer to a third than the closer of its parts, so
only clusters whose closest one is gone look again, and one with none within the limit is finished.
The last ``FINISH_ROWS`` clusters of a shape are merged in one task, one pair at a time.

Distances that decide are sums over the components in one order, the same from both sides and in every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.joins import salted_join
from skylattice.operators.components import connected_components
from skylattice.session import materialize

BLOCK_ROWS = 2_048  # rows of a block, about; a product holds SLICE_ROWS x this many numbers
SLICE_ROWS = 256
BATCH_PAIRS = 16  # pairs of blocks that go to Python together
FINISH_ROWS = 4_096  # clusters of a shape that one task may hold; it keeps all their distances
CLOSE = 1e-11  # products this near to the best, beyond the rounding of single precision, are compared exactly
PAIRS = 1 << 15  # exact comparisons at once


def _blocks(rows: DataFrame, shape: str, name: str, fields: list[str], vector: str, block_rows: int) -> DataFrame:
    """(shape, _k, _b, and per field an array): blocks of about ``block_rows`` rows; ``_k`` blocks make a shape."""
    sizes = rows.groupBy(shape).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_k"))
    placed = salted_join(rows, sizes, [shape], [name]).withColumn("_b", F.pmod(F.xxhash64(name), F.col("_k")).cast("int"))
    member = F.struct(name, *fields, vector)
    made = placed.groupBy(shape, "_b").agg(F.first("_k").alias("_k"), F.collect_list(member).alias("_m"))
    part = lambda f: F.transform("_m", lambda s: s[f])
    return made.select(shape, "_k", "_b", part(name).alias(name), *[part(f).alias(f) for f in fields], F.flatten(part(vector)).alias(vector))


def _facing(left: DataFrame, right: DataFrame, shape: str) -> DataFrame:
    """Every block of ``left`` beside every block of ``right`` of its shape.

    Tasks pair files of one side with files of the other, so no block is copied into a shuffle; both sides should be written tables.
    """
    named = lambda df, side: df.select(shape, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in (shape, "_b", "_k")])
    left.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_PAIRS))
    return named(left, "l").join(named(right, "r").hint("shuffle_replicate_nl"), shape)


def _matrix(vector: pa.ListScalar, rows: int) -> np.ndarray:
    return vector.values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _distances(sums: np.ndarray, n: np.ndarray, others: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 - average correlation, row by row; the same from both sides."""
    return 1.0 - (sums * others).sum(axis=1) / (n * m)


def _closest_in_blocks(limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per cluster of a left block its closest one in the right block, where one is within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for row in range(batch.num_rows):
                own, other, n, m = (column[c][row].values.to_numpy(zero_copy_only=False) for c in ("l_cluster", "r_cluster", "l_n", "r_n"))
                left, right = _matrix(column["l_sum"][row], len(own)), _matrix(column["r_sum"][row], len(other))
                mean, asked = (right / m[:, None]).astype(np.float32).T, (left / n[:, None]).astype(np.float32)
                # twice the error of a product of vectors no longer than 1, in single precision
                close = np.float32(2 * (left.shape[1] + 2) * np.finfo(np.float32).eps + CLOSE)
                _, same, itself = np.intersect1d(own, other, return_indices=True)
                for at in range(0, len(own), SLICE_ROWS):
                    product = asked[at : at + SLICE_ROWS] @ mean
                    here = (same >= at) & (same < at + len(product))
                    product[same[here] - at, itself[here]] = -np.inf
                    best = np.fmax.reduce(product, axis=1)
                    least = np.maximum(best - close, np.float32(1.0 - limit) - close)
                    i, j = np.divmod(np.flatnonzero(product >= least[:, None]), len(other))
                    i += at
                    found = []
                    for some in range(0, len(i), PAIRS):
                        a, b = i[some : some + PAIRS], j[some : some + PAIRS]
                        found.append(_distances(left[a], n[a], right[b], m[b]))
                    dist = np.concatenate(found) if found else np.zeros(0)
                    low, high = np.minimum(own[i], other[j]), np.maximum(own[i], other[j])
                    order = np.lexsort((high, low, dist, i))
                    first = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
                    first = first[dist[first] <= limit]
                    yield pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (own[i], dist, low, high)], ["cluster", "dist", "a", "b"])

    return run


def _merge_in_task(limit: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The merges (a, b) of the clusters of one shape, the closest pair first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        name, n, sums = pdf["cluster"].to_numpy(), pdf["n"].to_numpy(float), np.vstack(pdf["sum"].to_numpy())
        size = len(name)
        away = np.empty((size, size))
        for i in range(size):
            away[i] = _distances(sums, n, sums[i], n[i])
        away[np.isnan(away)] = np.inf
        np.fill_diagonal(away, np.inf)
        to, dist = away.argmin(axis=1), away.min(axis=1)
        out = []
        while True:
            i = int(dist.argmin())  # the first of equal ones, as names are in order
            if not dist[i] <= limit:
                break
            j = int(to[i])
            i, j = min(i, j), max(i, j)
            out.append((name[i], name[j]))
            sums[i], n[i] = sums[i] + sums[j], n[i] + n[j]
            gone = np.isinf(away[i]) & np.isinf(away[j])
            fresh = _distances(sums, n, sums[i], n[i])
            fresh[np.isnan(fresh) | gone] = np.inf
            fresh[[i, j]] = np.inf
            away[i] = away[:, i] = fresh
            away[j] = away[:, j] = np.inf
            again = np.flatnonzero((to == i) | (to == j))
            again = np.union1d(again, [i, j])
            to[again], dist[again] = away[again].argmin(axis=1), away[again].min(axis=1)
            closer = (fresh < dist) | ((fresh == dist) & (i < to))
            to[closer], dist[closer] = i, fresh[closer]
        return pd.DataFrame(out, columns=["src", "dst"]) if out else pd.DataFrame({"src": name[:0], "dst": name[:0]})

    return run


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays centred and scaled to unit length, so that products are correlations."""
    for batch in batches:
        rows = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(2)]
        centred = [v - v.mean() if len(v) else v for v in rows]
        units = [v / (np.sqrt((v * v).sum()) + 1e-9) for v in centred]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64())), pa.array(np.ones(len(rows)))], ["shape", "cluster", "sum", "n"])


def unit_vectors(tiles: DataFrame, name: str, vector: str) -> DataFrame:
    """Tiles (shape, name, array) as clusters of one: shape, cluster, sum, n."""
    rows = tiles.select("shape", F.col(name).cast("long").alias("cluster"), F.col(vector).cast("array<double>").alias("sum"))
    kind = rows.schema["shape"].dataType.simpleString()
    return rows.mapInArrow(_unit_rows, f"shape {kind}, cluster bigint, sum array<double>, n double")


def average_linkage(units: DataFrame, limit: float, block_rows: int = BLOCK_ROWS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """(node, component) of every member of a cluster of two or more; a cluster is named after its smallest member.

    ``units``: shape, cluster (long), sum (unit vector; equal lengths within a shape), n. Clusters merge while their average distance is at most ``limit``.
    """
    live = materialize(units.select("shape", "cluster", "sum", F.col("n").cast("double").alias("n")), "clusters")
    merges: list[DataFrame] = []
    known: DataFrame | None = None  # (cluster, dist, a, b): the closest one of clusters that need not look again
    while True:
        sizes = materialize(live.groupBy("shape").agg(F.count("*").alias("_c")), "sizes")
        n_few, n_many = sizes.agg(F.count_if(F.col("_c") <= finish_rows), F.count_if(F.col("_c") > finish_rows)).first()
        if n_few:
            few = salted_join(live, sizes.where(F.col("_c") <= finish_rows).drop("_c"), ["shape"], ["cluster"])
            merges.append(materialize(few.groupBy("shape").applyInPandas(_merge_in_task(limit), "src bigint, dst bigint"), "merged"))
            live = materialize(salted_join(live, sizes.where(F.col("_c") > finish_rows).drop("_c"), ["shape"], ["cluster"]), "clusters")
        if not n_many:
            break
        asking = live if known is None else live.join(known.select("cluster"), "cluster", "left_anti")
        facing = [materialize(_blocks(df, "shape", "cluster", ["n"], "sum", block_rows), "blocks") for df in (asking, live)]
        found = _facing(*facing, "shape").drop("shape").mapInArrow(_closest_in_blocks(limit), "cluster bigint, dist double, a bigint, b bigint")
        found = found.groupBy("cluster").agg(F.min(F.struct("dist", "a", "b")).alias("l")).select("cluster", "l.dist", "l.a", "l.b")
        if known is not None:
            found = found.unionByName(known.join(live.select("cluster"), "cluster", "left_semi"))
        closest = materialize(found, "closest")
        mutual = materialize(closest.groupBy("a", "b").agg(F.count("*").alias("_e")).where("_e = 2").select("a", "b"), "merged")
        if mutual.isEmpty():
            if known is None:
                break
            known = None  # rounding of equal distances: all look again
            continue
        merges.append(mutual.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        # clusters with none within the limit are finished; of the others those that merge take one name and meet by it
        named = closest.select("cluster").join(mutual.select(F.col("b").alias("cluster"), F.col("a").alias("into")), "cluster", "left")
        met = live.join(named, "cluster").groupBy("shape", F.coalesce("into", "cluster").alias("cluster")).agg(F.collect_list("sum").alias("_s"), F.sum("n").alias("n"))
        both = F.zip_with(F.col("_s")[0], F.try_element_at("_s", F.lit(2)), lambda x, y: x + y)
        live = materialize(met.select("shape", "cluster", F.when(F.size("_s") == 2, both).otherwise(F.col("_s")[0]).alias("sum"), "n"), "clusters")
        kept = closest
        taken = mutual.select(F.explode(F.array("a", "b")).alias("cluster"))
        for end in "ab":
            kept = kept.join(taken.select(F.col("cluster").alias(end)), end, "left_anti")
        known = materialize(kept.select("cluster", "dist", "a", "b"), "closest")
    if not merges:
        return live.select(F.col("cluster").alias("node"), F.col("cluster").alias("component")).limit(0)
    return connected_components(reduce(DataFrame.unionByName, merges))


def _best_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per tile its best centre of the block by correlation; of equal ones the smaller name."""
    for batch in batches:
        column = {c: batch.column(c) for c in batch.schema.names}
        for row in range(batch.num_rows):
            tile, centre = (column[c][row].values.to_numpy(zero_copy_only=False) for c in ("l_tile_id", "r_cluster"))
            order = np.argsort(centre, kind="stable")
            left, right = _matrix(column["l_v"][row], len(tile)), _matrix(column["r_u"][row], len(centre))[order]
            left, right = (x - x.mean(axis=1, keepdims=True) for x in (left, right))
            with np.errstate(divide="ignore", invalid="ignore"):
                left, right = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (left, right))
            for at in range(0, len(tile), SLICE_ROWS):
                corr = left[at : at + SLICE_ROWS] @ right.T
                corr[~np.isfinite(corr)] = -np.inf
                best = corr.argmax(axis=1)
                value = corr[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[at : at + SLICE_ROWS]), pa.array(centre[order][best]), pa.array(value, mask=np.isinf(value))], ["tile_id", "cluster", "corr"])


def best_centres(tiles: DataFrame, centres: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(tile_id, cluster, corr): the centre of its shape that a tile correlates with best; of equal ones the smaller name.

    ``tiles``: tile_id, shape, v. ``centres``: cluster, shape, u. A tile without variance has no correlation and takes the smallest name.
    """
    left = materialize(_blocks(tiles, "shape", "tile_id", [], "v", block_rows), "blocks")
    right = materialize(_blocks(centres, "shape", "cluster", [], "u", block_rows), "centres")
    scored = _facing(left, right, "shape").drop("shape").mapInArrow(_best_centres, "tile_id bigint, cluster bigint, corr double")
    return scored.groupBy("tile_id").agg(F.max_by("cluster", F.struct(F.col("corr"), -F.col("cluster"))).alias("cluster"), F.max("corr").alias("corr"))
