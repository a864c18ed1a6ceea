"""Limits and peaks that must not hang on the order in which rows are added."""

from __future__ import annotations

import os
from datetime import datetime

import check_queries
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skylattice.operators import composites
from skylattice.plans import raster_queries
from skylattice.sources import scans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """The smallest tables with a hundred thousand readings on one chip, many a pixel, in no order."""
    out = tmp_path_factory.mktemp("dense")
    for t in check_queries.TABLES:
        if t != "lineitem":
            os.symlink(f"{SF}/{t}.parquet", out / f"{t}.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (l_suppkey % 4 + 4 * i AS l_suppkey, TIMESTAMP '1998-03-17' + to_days(CAST(l_linenumber % 3 AS INTEGER)) AS l_shipdate)
        FROM '{SF}/lineitem.parquet', (SELECT unnest(range(17)) AS i) ORDER BY hash(l_orderkey, l_linenumber, i)) TO '{out}/lineitem.parquet' (ROW_GROUP_SIZE 20000)""")
    return str(out)


@pytest.mark.parametrize("name", [
    "flt07_vegetation_water_mask", "flt08_single_scene", "prj11_source_class", "wn08_peak_pixel", "nb01_binary_opening", "nb02_components", "nb03_dilation_ring",
    "nb04_component_selection", "nb08_mask_outline",
])
def test_dense_pixels_match_sql(spark, dense, name):
    ok, message, _ = check_queries.compare(spark, check_queries.connect(dense), name, entry.queries()[name], entry.oracle_sql()[name], dense)
    assert ok, message


def test_mask_limit_is_exact(spark):
    rows = [(1, 0, 0, 0.1, b4, b8) for b4, b8 in ((0.3, 0.1), (0.2, 0.2), (0.1, 0.3))]
    base = spark.createDataFrame(rows, "tile_id int, y int, x int, B3 double, B4 double, B8 double").coalesce(1)
    pixels = spark.createDataFrame([(1, 0, 0, 7.0)], "tile_id int, y int, x int, value double")
    # both means are 0.2; added as doubles in this order they are not equal
    assert composites.vegetation_water_mask(pixels, base, ndvi_max=0.0, water=False).first().value == 7.0


def test_masked_reading_hides_no_valid_one(spark):
    rows = [(1, 0, 0, "a", None), (1, 0, 0, "a", 0.4), (1, 0, 0, "a", 0.3), (1, 0, 1, "a", None), (1, 0, 2, "b", 0.1), (1, 0, 2, "a", 0.2)]
    df = spark.createDataFrame(rows, "tile_id int, y int, x int, scene_id string, value double").withColumn("ts", F.lit("1998-03-17").cast("timestamp_ntz"))
    got = {r.x: r.value for r in scans.single_image(df, datetime(1998, 3, 17)).collect()}
    assert got == {0: 0.3, 1: None, 2: 0.2}


def test_blob_limit_is_exact(spark, tmp_path):
    # every mean is 0.234 exactly, which is not above it; as doubles some orders of addition exceed it
    lines = [(chip * 4, 1, 1, 1, float(q), 20.0, 0.0, 0.0) for chip, qs in enumerate([(34,), (33, 34, 35), (35, 34, 33), (31, 34, 37), (30, 34, 38, 34), (50, 18, 34), (18, 34, 50), (44, 24, 34, 34, 34), (39, 25, 36, 33, 37), (41, 36, 25, 47, 21), (29, 38, 37, 33, 33), (28, 34, 49, 19, 40)]) for q in qs]
    df = spark.createDataFrame(lines, "l_suppkey bigint, l_linenumber int, l_partkey bigint, l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert raster_queries.blob(spark, str(tmp_path)).where("NOT (y BETWEEN 5 AND 11 AND x BETWEEN 3 AND 9)").count() == 0
