"""Writers for series, raster windows, detections and per-detection arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.display import null_if_not_finite
from skylattice.operators.morphology import pack

# Fixed value.
WINDOW_PX = 1024


def write_series(series: DataFrame, path: str, fmt: str, unit: str) -> None:
    """Daily series as parquet or CSV; the unit travels as a column."""
    out = series.select(F.col("date").cast("string").alias("date"), "value", "count").withColumn("unit", F.lit(unit)).orderBy("date")
    if fmt == "parquet":
        out.write.parquet(path)
    elif fmt == "csv":
        out.write.csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def tag_windows(pixels: DataFrame, size: int = WINDOW_PX) -> DataFrame:
    """Adds the window row and column of each pixel."""
    return pixels.withColumns({"win_row": F.floor(F.col("y") / size), "win_col": F.floor(F.col("x") / size)})


def write_windows(pixels: DataFrame, path: str, size: int = WINDOW_PX, keys: Sequence[str] = ()) -> None:
    """Raster in bounded windows; one with more rows than a task's share is written by several, in the order of its pixels."""
    tagged = tag_windows(pixels, size)
    where = [*keys, "win_row", "win_col"]
    tagged.repartitionByRange(*where, "y", "x").sortWithinPartitions(*where, "y", "x").write.partitionBy(*where).parquet(path)


def detection_rows(results: DataFrame) -> DataFrame:
    """Headline numbers as columns, everything as JSON; NaN and infinities become NULL, the outline only with a plume."""
    numbers = {c: null_if_not_finite(F.col(c)) for c, t in results.dtypes if t == "double"}
    clean = results.withColumns(numbers)
    payload = F.to_json(F.struct(*[c for c in results.columns if c != "outline"]))
    return clean.withColumns({"outline": F.when(F.col("n_pixels") > 0, F.col("outline")), "result_json": payload})


def write_detections(results: DataFrame, path: str) -> None:
    detection_rows(results).write.mode("append").parquet(path)


def detection_arrays(pixels: DataFrame, keys: Sequence[str], values: Sequence[str], height: int, width: int) -> DataFrame:
    """One row per detection with a dense float array per layer (a chip is bounded)."""
    return pack(pixels, keys, values, height, width)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Union with the higher-ordered row kept per key."""
    both = existing.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
