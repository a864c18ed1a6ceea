"""Scans of pixel and scene tables, and the flagship series."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN, S2_SR, S2_TOA
from skylattice.catalog.registry import catalog_table, resolve_source_column
from skylattice.functions.geo import box
from skylattice.operators import series
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.sources import scans

ROI = box(-167.505, 49.8755, -165.505, 49.9755)
ROI_SQL = "lon >= -167.505 AND lon <= -165.505 AND lat >= 49.8755 AND lat <= 49.9755"
START, END = "1997-01-01", "1999-01-01"
DATES_SQL = "ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1999-01-01'"
CLEAR_SQL = "(NOT prob_present OR coalesce(prob < 50, false))"


def r6(c, digits: int = 6):
    return F.round(c, digits)


@query(
    "flagship_daily_ndvi_series", "px",
    oracle=f"""
    WITH ndvi AS (SELECT ts, (b8 - b4) / nullif(b8 + b4, 0) AS value FROM (
        SELECT ts, B8 / 10000.0 AS b8, B4 / 10000.0 AS b4 FROM px WHERE cloud_pct <= 65 AND {CLEAR_SQL})),
    daily AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS value, count(value) AS count FROM ndvi GROUP BY 1)
    SELECT CAST(date AS VARCHAR) AS date, round(value, 6) AS value, count,
      round(avg(value) OVER (ORDER BY date RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 3 DAY FOLLOWING), 6) AS smooth
    FROM daily
    """,
)
def flagship(spark, sf):
    ndvi = scans.optical_product(v.px(spark, sf), BUILTIN["s2"].get("NDVI"), None, "1990-01-01", "2010-01-01")
    daily = series.daily_series(series.scene_reduction(ndvi)).withColumn("series_id", F.lit("ndvi"))
    smooth = series.rolling_centred(daily, ("series_id",))
    return smooth.select(F.col("date").cast("string").alias("date"), r6("value").alias("value"), "count", r6("smooth").alias("smooth"))


@query(
    "src01_scene_scan", "px",
    oracle=f"""
    SELECT scene_id, tile_id, y, x, round(CASE WHEN v BETWEEN 1600 AND 2200 THEN v END, 6) AS value
    FROM (SELECT *, CH4_column_volume_mixing_ratio_dry_air_bias_corrected AS v FROM px) WHERE {DATES_SQL} AND {ROI_SQL}
    """,
)
def scene_scan(spark, sf):
    df = scans.generic_product(v.px(spark, sf), BUILTIN["s5p"].get("CH4"), ROI, START, END)
    return df.select("scene_id", "tile_id", "y", "x", r6("value").alias("value"))


_CLOUD_CTE = """
    WITH clouds AS (SELECT scene_id, tile_id, y, x, min({'a': image_no, 'b': coalesce(prob, -1)}) AS f FROM cloudpx GROUP BY ALL),
    present AS (SELECT DISTINCT scene_id FROM cloudpx),
    joined AS (SELECT p.*, CASE WHEN c.f.b >= 0 THEN c.f.b END AS jprob, s.scene_id IS NOT NULL AS jpresent
      FROM px p LEFT JOIN clouds c USING (scene_id, tile_id, y, x) LEFT JOIN present s ON p.scene_id = s.scene_id)
"""
v.VIEW_SQL["cloudpx"] = (
    ("px",),
    "SELECT scene_id, tile_id, y, x, B10 % 7 AS image_no, prob FROM px WHERE prob_present",
)


def cloud_table(spark, sf):
    """Cloud-probability images: scenes on the first of a month have none."""
    p = v.px(spark, sf).where("prob_present")
    return p.select("scene_id", "tile_id", "y", "x", (F.col("B10") % 7).alias("image_no"), "prob")


@query(
    "src02_optical_base_scan", "cloudpx",
    oracle=_CLOUD_CTE + f"""
    SELECT scene_id, tile_id, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS n_clear,
      round(avg(CASE WHEN ok THEN B4 / 10000.0 END), 6) AS b4, round(avg(CASE WHEN ok THEN B8 / 10000.0 END), 6) AS b8
    FROM (SELECT *, (NOT jpresent OR coalesce(jprob < 50, false)) AS ok FROM joined WHERE cloud_pct <= 65 AND {DATES_SQL})
    GROUP BY ALL
    """,
)
def optical_base_scan(spark, sf):
    base = scans.optical_base(v.px(spark, sf), None, START, END, ("B4", "B8"), clouds=cloud_table(spark, sf))
    return base.groupBy("scene_id", "tile_id").agg(
        F.count("*").alias("n"), F.count("B4").alias("n_clear"), r6(F.avg("B4")).alias("b4"), r6(F.avg("B8")).alias("b8")
    )


@query(
    "src03_optical_product_scan", "px",
    oracle=f"""
    SELECT scene_id, tile_id, y, x, round(CASE WHEN {CLEAR_SQL} THEN (B3 / 10000.0 - B8 / 10000.0) / nullif(B3 / 10000.0 + B8 / 10000.0, 0) END, 6) AS value
    FROM px WHERE cloud_pct <= 65 AND {DATES_SQL} AND {ROI_SQL}
    """,
)
def optical_product_scan(spark, sf):
    df = scans.optical_product(v.px(spark, sf), BUILTIN["s2"].get("NDWI"), ROI, START, END)
    return df.select("scene_id", "tile_id", "y", "x", r6("value").alias("value"))


@query(
    "src03_collection_choice", "px",
    oracle=f"""
    WITH c AS (SELECT *, day(ts) % 2 = 0 AS toa FROM px WHERE cloud_pct <= 65 AND {DATES_SQL})
    SELECT 'NDWI' AS product, scene_id, count(*) AS n, round(avg(CASE WHEN {CLEAR_SQL} THEN (B3 / 10000.0 - B8 / 10000.0) / nullif(B3 / 10000.0 + B8 / 10000.0, 0) END), 6) AS value FROM c WHERE NOT toa GROUP BY scene_id
    UNION ALL SELECT 'MBSP', scene_id, count(*), round(avg(CASE WHEN {CLEAR_SQL} THEN (B12 / 10000.0 - B11 / 10000.0) / nullif(B11 / 10000.0, 0) END), 6) FROM c WHERE toa GROUP BY scene_id
    """,
)
def collection_choice(spark, sf):
    """A table with scenes of both collections: each product reads its own."""
    name = F.when(F.dayofmonth("ts") % 2 == 0, S2_TOA).otherwise(S2_SR)
    both = v.px(spark, sf).withColumn("collection", name)

    def means(key):
        df = scans.optical_product(both, BUILTIN["s2"].get(key), None, START, END)
        return df.groupBy("scene_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("value")).select(F.lit(key).alias("product"), "scene_id", "n", "value")

    return means("NDWI").unionByName(means("MBSP"))


@query(
    "src04_radar_scan", "px",
    oracle=f"""
    SELECT scene_id, tile_id, y, x, round(4 * pow(10, VH / 10) / (pow(10, VV / 10) + pow(10, VH / 10)), 6) AS value
    FROM px WHERE mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH') AND orbit_pass = 'ASCENDING'
      AND relative_orbit = 6 AND {DATES_SQL}
    """,
)
def radar_scan(spark, sf):
    df = scans.radar_product(v.px(spark, sf), BUILTIN["s1"].get("RVI"), None, START, END, orbit_pass="ASCENDING", relative_orbit=6)
    return df.select("scene_id", "tile_id", "y", "x", r6("value").alias("value"))


@query(
    "src04_despeckled_scan", "px",
    oracle="""
    WITH r AS (SELECT scene_id, tile_id, y, x, VV, VH, CAST(round(lat / 0.01) AS BIGINT) AS gy, CAST(round(lon / 0.01) AS BIGINT) AS gx FROM px
      WHERE mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH')),
    m AS (SELECT a.scene_id, a.gy, a.gx, median(b.VV) AS VV FROM (SELECT DISTINCT scene_id, gy, gx FROM r) a JOIN r b ON a.scene_id = b.scene_id
      AND pow((a.gy - b.gy) * 1113.2, 2) + pow((a.gx - b.gx) * 1113.2 * cos(radians(a.gy * 0.01)), 2) <= 3000.0 * 3000.0 GROUP BY ALL)
    SELECT scene_id, tile_id, y, x, round(CASE WHEN r.VV IS NOT NULL THEN m.VV END, 6) AS value FROM r JOIN m USING (scene_id, gy, gx)""",
)
def despeckled_scan(spark, sf):
    px = v.px(spark, sf)
    df = scans.radar_product(px, BUILTIN["s1"].get("VV"), None, "1900-01-01", "2100-01-01", speckle_radius_m=3_000.0)
    return df.select("scene_id", "tile_id", "y", "x", r6("value").alias("value"))


@query(
    "src05_trace_gas_scan", "px",
    oracle=f"""
    SELECT scene_id, tile_id, count(*) AS n, count(CASE WHEN v BETWEEN 0 AND 0.1 THEN 1 END) AS n_valid,
      round(avg(CASE WHEN v BETWEEN 0 AND 0.1 THEN v END), 6) AS value, round(avg(v), 6) AS value_unmasked
    FROM (SELECT *, CO_column_number_density AS v FROM px) WHERE {DATES_SQL} GROUP BY ALL
    """,
)
def trace_gas_scan(spark, sf):
    co = BUILTIN["s5p"].get("CO")
    px = v.px(spark, sf)
    df = scans.scan(px, None, START, END).select("scene_id", "tile_id", F.col(co.band).alias("raw"), scans.mask_valid(F.col(co.band), co).alias("v"))
    return df.groupBy("scene_id", "tile_id").agg(
        F.count("*").alias("n"), F.count("v").alias("n_valid"), r6(F.avg("v")).alias("value"), r6(F.avg("raw")).alias("value_unmasked")
    )


@query(
    "src06_source_dispatch", "px",
    oracle=f"""
    SELECT * FROM (
      SELECT 's1' AS source, scene_id, tile_id, y, x, round(VV - VH, 6) AS value FROM px
        WHERE mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH') AND {DATES_SQL} AND {ROI_SQL}
      UNION ALL SELECT 's2', scene_id, tile_id, y, x, round(CASE WHEN {CLEAR_SQL} THEN B11 / 10000.0 END, 6) FROM px WHERE cloud_pct <= 65 AND {DATES_SQL} AND {ROI_SQL}
      UNION ALL SELECT 's5p', scene_id, tile_id, y, x, round(CASE WHEN O3_column_number_density BETWEEN 0 AND 0.3 THEN O3_column_number_density END, 6) FROM px WHERE {DATES_SQL} AND {ROI_SQL}
      UNION ALL SELECT 'emit', scene_id, tile_id, y, x, round(CASE WHEN vertical_column_enhancement BETWEEN -2000 AND 10000 THEN vertical_column_enhancement END, 6) FROM px WHERE {DATES_SQL} AND {ROI_SQL})
    """,
)
def source_dispatch(spark, sf):
    px = v.px(spark, sf)
    out = None
    for source, key in (("s1", "VV_VH_RATIO"), ("s2", "B11"), ("s5p", "O3"), ("emit", "CH4ENH")):
        part = scans.collection(px, key, source, ROI, START, END).select(
            F.lit(source).alias("source"), "scene_id", "tile_id", "y", "x", r6("value").alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "src07_virtual_source", "px",
    oracle="""
    SELECT source, key, CASE WHEN source <> 'methane' THEN source WHEN key = 'CH4' THEN 's5p'
        WHEN key IN ('VV', 'VH', 'VV_VH_RATIO', 'FLOOD_VV_CHANGE', 'RVI') THEN 's1' ELSE 's2' END AS dataset_id, count(*) AS n
    FROM (SELECT CASE WHEN B10 % 3 = 0 THEN 's5p' ELSE 'methane' END AS source,
        CASE B2 % 5 WHEN 0 THEN 'CH4' WHEN 1 THEN 'RVI' WHEN 2 THEN 'VV' WHEN 3 THEN 'MBSP' ELSE 'B12_B11' END AS key FROM px)
    GROUP BY ALL
    """,
)
def virtual_source(spark, sf):
    px = v.px(spark, sf)
    m = F.col("B2") % 5
    key = F.when(m == 0, "CH4").when(m == 1, "RVI").when(m == 2, "VV").when(m == 3, "MBSP").otherwise("B12_B11")
    req = px.select(F.when(F.col("B10") % 3 == 0, "s5p").otherwise("methane").alias("source"), key.alias("key"))
    return req.groupBy("source", "key", resolve_source_column(F.col("key"), F.col("source")).alias("dataset_id")).agg(F.count("*").alias("n"))


@query(
    "src13_acquisition_listing", "px",
    oracle=f"SELECT DISTINCT scene_id, CAST(ts AS VARCHAR) AS ts FROM px WHERE {DATES_SQL} AND {ROI_SQL}",
)
def acquisition_listing(spark, sf):
    return scans.acquisition_times(v.px(spark, sf), ROI, START, END).select("scene_id", F.col("ts").cast("string").alias("ts"))


@query(
    "src14_scene_listing", "scenes",
    oracle="""
    SELECT scene_id, site_id, CAST(ts AS VARCHAR) AS ts, cloud_pct, cloud_pct <= 30 AS ref_ok,
      round(1 / cos(radians(sun_zenith)) + 1 / cos(radians(view_zenith)), 6) AS amf
    FROM scenes WHERE cloud_pct <= 80 AND ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2000-01-01'
    """,
)
def scene_listing(spark, sf):
    s = v.scenes(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = scans.list_scenes(s, "1995-01-01", "2000-01-01").orderBy("ts", "scene_id")
    return df.select("scene_id", "site_id", F.col("ts").cast("string").alias("ts"), "cloud_pct", "ref_ok", r6("amf").alias("amf"))


@query(
    "src15_frozen_mirror_split", "refs",
    oracle="""
    SELECT event_id, provenance, CAST(ts AS VARCHAR) AS ts FROM refs
    WHERE (provenance = 'mirror' AND ts >= TIMESTAMP '2020-01-10' AND ts < TIMESTAMP '2020-02-21')
       OR (provenance = 'live' AND ts >= TIMESTAMP '2020-02-21' AND ts < TIMESTAMP '2020-04-11')
    """,
)
def frozen_mirror_split(spark, sf):
    r = v.refs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = scans.split_by_freeze(r.where("provenance = 'mirror'"), r.where("provenance = 'live'"),
                               date(2020, 1, 10), date(2020, 4, 10), last_day=date(2020, 2, 20))
    return df.select("event_id", "provenance", F.col("ts").cast("string").alias("ts"))


@query(
    "flt08_single_scene", "px",
    oracle=f"""
    SELECT tile_id, y, x, round(arg_min(value, value), 6) AS value FROM (
      SELECT tile_id, y, x, CASE WHEN {CLEAR_SQL} THEN B12 / 10000.0 END AS value FROM px
      WHERE cloud_pct <= 65 AND ts = TIMESTAMP '1998-03-17') GROUP BY ALL
    """,
)
def single_scene(spark, sf):
    df = scans.optical_product(v.px(spark, sf), BUILTIN["s2"].get("B12"), None, "1990-01-01", "2010-01-01")
    return scans.single_image(df, datetime(1998, 3, 17)).select("tile_id", "y", "x", r6("value").alias("value"))


@query(
    "prj09_display_scaling", "px",
    oracle="""
    SELECT key, unit, scene_id, round(avg(raw) * scale, 4) AS display FROM (
      SELECT scene_id, 'NO2' AS key, 'umol/m2' AS unit, CAST(1e6 AS DOUBLE) AS scale, tropospheric_NO2_column_number_density AS raw FROM px
      UNION ALL SELECT scene_id, 'CO', 'mmol/m2', 1e3, CO_column_number_density FROM px
      UNION ALL SELECT scene_id, 'CH4', 'ppb', 1e0, CH4_column_volume_mixing_ratio_dry_air_bias_corrected FROM px)
    GROUP BY key, unit, scale, scene_id
    """,
)
def display_scaling(spark, sf):
    bands = {k: BUILTIN["s5p"].get(k).band for k in ("NO2", "CO", "CH4")}
    long = v.px(spark, sf).groupBy("scene_id").agg(*[F.avg(b).alias(k) for k, b in bands.items()]).unpivot(
        ["scene_id"], list(bands), "key", "raw"
    )
    cat = catalog_table(spark).where("dataset_id = 's5p'").select("key", "unit", "display_scale")
    return long.join(F.broadcast(cat), "key").select(
        "key", "unit", "scene_id", r6(F.col("raw") * F.col("display_scale"), 4).alias("display")
    )
