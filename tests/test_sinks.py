"""Windows are written whole, whatever their depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.sources import sinks


def test_deep_window_is_written_by_several_tasks(spark, tmp_path):
    pixels = spark.range(40_000).select((F.col("id") % 64).alias("y"), F.expr("id div 64 % 64").alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_windows(pixels, f"{tmp_path}/w", 1024)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(f"{tmp_path}/w")
    assert back.select("id").distinct().count() == back.count() == 40_000
    files = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(files) > 1 and max(files) < 30_000
