"""Composites, comparisons, ranges and pixel-level aggregates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN
from skylattice.functions.quantiles import robust_spread
from skylattice.operators import composites, retrieval
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import CLEAR_SQL, r6
from skylattice.sources import scans

FULL = ("1990-01-01", "2010-01-01")
REF = ("1995-01-01", "1998-01-01")
NOW = ("1998-01-01", "2001-01-01")
_REF_SQL = "ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1998-01-01'"
_NOW_SQL = "ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '2001-01-01'"
_NDVI_SQL = f"""SELECT scene_id, ts, tile_id, y, x, CASE WHEN {CLEAR_SQL} THEN (B8 / 10000.0 - B4 / 10000.0) / nullif(B8 / 10000.0 + B4 / 10000.0, 0) END AS value
  FROM px WHERE cloud_pct <= 65"""
v.VIEW_SQL["ndvi"] = (("px",), _NDVI_SQL)


def ndvi(spark, sf):
    return scans.optical_product(v.px(spark, sf), BUILTIN["s2"].get("NDVI"), None, *FULL)


def _pixels(df):
    return df.select("tile_id", "y", "x", r6("value").alias("value"))


@query("ag01_mean_composite", "ndvi", oracle="SELECT tile_id, y, x, round(avg(value), 6) AS value FROM ndvi GROUP BY ALL")
def mean_composite(spark, sf):
    return _pixels(composites.mean_composite(ndvi(spark, sf)))


@query(
    "ag02_centred_composite", "ndvi",
    oracle="SELECT tile_id, y, x, round(avg(value), 6) AS value FROM ndvi WHERE ts >= TIMESTAMP '1998-03-03' AND ts < TIMESTAMP '1998-09-30' GROUP BY ALL",
)
def centred_composite(spark, sf):
    return _pixels(composites.date_composite(ndvi(spark, sf), date(1998, 6, 16), 105))


@query("ag03_median_composite", "ndvi", oracle="SELECT tile_id, y, x, round(median(value), 6) AS value FROM ndvi WHERE value IS NOT NULL GROUP BY ALL")
def median_composite(spark, sf):
    return _pixels(composites.median_composite(ndvi(spark, sf)))


@query(
    "ag04_year_mosaic", "vectors",
    oracle="SELECT pixel_id, year, arg_max(vec_id, zone) AS vec_id, round(arg_max(embedding[1], zone), 4) AS first_dim FROM vectors GROUP BY ALL",
)
def year_mosaic(spark, sf):
    df = v.vectors(spark, sf).withColumn("image", F.struct("vec_id", "embedding"))
    m = composites.latest_mosaic(df, ("pixel_id", "year"), "image", ("zone", "vec_id"))
    return m.select("pixel_id", F.col("year").cast("bigint").alias("year"), F.col("image.vec_id").alias("vec_id"), r6(F.col("image.embedding")[0], 4).alias("first_dim"))


@query(
    "jn01_cloud_probability_join", "cloudpx",
    oracle="""
    WITH c AS (SELECT scene_id, tile_id, y, x, min({'a': image_no, 'b': coalesce(prob, -1)}) AS f FROM cloudpx GROUP BY ALL), s AS (SELECT DISTINCT scene_id FROM cloudpx)
    SELECT p.tile_id, s.scene_id IS NOT NULL AS prob_present, count(*) AS n, count(CASE WHEN c.f.b >= 0 THEN 1 END) AS n_prob, CAST(sum(CASE WHEN c.f.b >= 0 THEN c.f.b END) AS BIGINT) AS prob_sum
    FROM px p LEFT JOIN c USING (scene_id, tile_id, y, x) LEFT JOIN s ON s.scene_id = p.scene_id GROUP BY ALL""",
)
def cloud_probability_join(spark, sf):
    from skylattice.plans.scan_queries import cloud_table

    px = v.px(spark, sf).drop("prob", "prob_present")
    df = scans.join_cloud_probability(px, cloud_table(spark, sf))
    return df.groupBy("tile_id", "prob_present").agg(F.count("*").alias("n"), F.count("prob").alias("n_prob"), F.sum("prob").alias("prob_sum"))


@query(
    "jn02_two_window_compare", "px",
    oracle=f"""SELECT tile_id, y, x, round((pa - pb) / nullif(pa + pb, 0) - (qa - qb) / nullif(qa + qb, 0), 6) AS value FROM (
      SELECT tile_id, y, x, avg(CASE WHEN {_REF_SQL} THEN a END) AS pa, avg(CASE WHEN {_REF_SQL} THEN b END) AS pb, avg(CASE WHEN {_NOW_SQL} THEN a END) AS qa, avg(CASE WHEN {_NOW_SQL} THEN b END) AS qb
      FROM (SELECT *, CASE WHEN {CLEAR_SQL} THEN B8A / 10000.0 END AS a, CASE WHEN {CLEAR_SQL} THEN B12 / 10000.0 END AS b FROM px WHERE cloud_pct <= 65)
      WHERE ({_REF_SQL}) OR ({_NOW_SQL}) GROUP BY ALL)""",
)
def two_window_compare(spark, sf):
    base = scans.optical_base(v.px(spark, sf), None, *FULL, ("B8A", "B12"))
    return _pixels(composites.compare_windows(base, BUILTIN["s2"].get("DNBR"), REF, NOW))


@query(
    "jn03_methane_anomaly", "px",
    oracle=f"""
    WITH b AS (SELECT scene_id, ts, tile_id, y, x, CASE WHEN {CLEAR_SQL} THEN (B12 / 10000.0) / nullif(B11 / 10000.0, 0) END AS q FROM px WHERE cloud_pct <= 65),
    r AS (SELECT tile_id, y, x, avg(q) AS r FROM b WHERE {_REF_SQL} GROUP BY ALL),
    w AS (SELECT tile_id, y, x, avg(q) AS t FROM b WHERE ts >= TIMESTAMP '1999-05-01' AND ts < TIMESTAMP '1999-07-31' GROUP BY ALL),
    s AS (SELECT tile_id, y, x, avg(q) AS t FROM b WHERE scene_id = '19980317' GROUP BY ALL)
    SELECT 'window' AS form, tile_id, y, x, round(t - r, 6) AS value FROM w FULL OUTER JOIN r USING (tile_id, y, x) WHERE t IS NOT NULL OR r IS NOT NULL
    UNION ALL SELECT 'scene', tile_id, y, x, round(t - r, 6) FROM s JOIN r USING (tile_id, y, x)""",
)
def methane_anomaly(spark, sf):
    base = scans.optical_base(v.px(spark, sf), None, *FULL, ("B11", "B12"))
    window = composites.windowed_anomaly(base, date(1999, 6, 15), 45, REF)
    scene = composites.single_scene_anomaly(base, "19980317", REF)
    return _pixels(window).select(F.lit("window").alias("form"), "*").unionByName(_pixels(scene).select(F.lit("scene").alias("form"), "*"))


@query(
    "jn08_pass_difference", "chips",
    oracle="""SELECT t.chip_id, t.y, t.x, round(t.b12 / t.b11 - r.b12 / r.b11, 6) AS value FROM chips t JOIN chips r USING (chip_id, y, x) WHERE t.pass = 1 AND r.pass = 0""",
)
def pass_difference(spark, sf):
    c = v.chips(spark, sf).withColumn("value", F.col("b12") / F.col("b11"))
    df = retrieval.pass_difference(c.where("pass = 1"), c.where("pass = 0"), ("chip_id",), ("value",))
    return df.select("chip_id", "y", "x", r6("value").alias("value"))


@query(
    "set03_band_stacking", "px",
    oracle=f"""SELECT tile_id, y, x, round(avg(CASE WHEN {_REF_SQL} THEN B4 END), 6) AS pre_b4, round(avg(CASE WHEN {_NOW_SQL} THEN B4 END), 6) AS post_b4,
      round(avg(CASE WHEN {_REF_SQL} THEN B8 END), 6) AS pre_b8, round(avg(CASE WHEN {_NOW_SQL} THEN B8 END), 6) AS post_b8 FROM px GROUP BY ALL""",
)
def band_stacking(spark, sf):
    pre, post = scans.date_range(F.col("ts"), *REF), scans.date_range(F.col("ts"), *NOW)
    aggs = [r6(F.avg(F.when(w, F.col(b)))).alias(f"{n}_{b.lower()}") for b in ("B4", "B8") for n, w in (("pre", pre), ("post", post))]
    return v.px(spark, sf).groupBy("tile_id", "y", "x").agg(*aggs)


@query(
    "ag09_first_and_max", "ndvi",
    oracle="SELECT tile_id, round(arg_min(value, {'a': ts, 'b': y, 'c': x, 'd': value}), 6) AS first_value, round(max(value), 6) AS max_value FROM ndvi WHERE value IS NOT NULL GROUP BY tile_id",
)
def first_and_max(spark, sf):
    df = ndvi(spark, sf).where("value IS NOT NULL")
    return df.groupBy("tile_id").agg(r6(F.min_by("value", F.struct("ts", "y", "x", "value"))).alias("first_value"), r6(F.max("value")).alias("max_value"))


@query(
    "ag10_display_range", "ndvi",
    oracle="""SELECT tile_id, round(CASE WHEN ok THEN lo ELSE -0.2 END, 6) AS vis_min, round(CASE WHEN ok THEN hi ELSE 0.9 END, 6) AS vis_max FROM (
      SELECT *, lo < hi AS ok FROM (SELECT tile_id, greatest(p - (q - p) * 0.15, -1) AS lo, least(q + (q - p) * 0.15, 1) AS hi FROM (
        SELECT tile_id, quantile_cont(value, 0.005) AS p, quantile_cont(value, 0.995) AS q FROM ndvi GROUP BY tile_id)))""",
)
def display_range(spark, sf):
    df = composites.display_range(ndvi(spark, sf), BUILTIN["s2"].get("NDVI"), ("tile_id",))
    return df.select("tile_id", r6("vis_min").alias("vis_min"), r6("vis_max").alias("vis_max"))


@query(
    "ag11_anomaly_range", "ndvi",
    oracle="""SELECT tile_id, round(m - h, 6) AS vis_min, round(m + h, 6) AS vis_max FROM (
      SELECT tile_id, m, greatest(m - a, b - m, 0.005) * 1.10 AS h FROM (SELECT tile_id, quantile_cont(value, 0.02) AS a, median(value) AS m, quantile_cont(value, 0.98) AS b FROM ndvi GROUP BY tile_id))""",
)
def anomaly_range(spark, sf):
    df = composites.anomaly_range(ndvi(spark, sf), ("tile_id",))
    return df.select("tile_id", r6("vis_min").alias("vis_min"), r6("vis_max").alias("vis_max"))


@query(
    "ag12_robust_sigma", "ndvi",
    oracle="""
    WITH m AS (SELECT tile_id, median(value) AS med FROM ndvi GROUP BY tile_id), g AS (SELECT median(value) AS med FROM ndvi)
    SELECT tile_id, round(any_value(med), 6) AS median, round(1.4826 * median(abs(value - med)), 6) AS sigma FROM ndvi JOIN m USING (tile_id) GROUP BY tile_id
    UNION ALL SELECT -1, round(any_value(med), 6), round(1.4826 * median(abs(value - med)), 6) FROM ndvi, g""",
)
def robust_sigma(spark, sf):
    df = ndvi(spark, sf)
    per = robust_spread(df, ("tile_id",), "value").select("tile_id", r6("median").alias("median"), r6("sigma").alias("sigma"))
    pooled = robust_spread(df, (), "value").select(F.lit(-1).cast("bigint").alias("tile_id"), r6("median").alias("median"), r6("sigma").alias("sigma"))
    return per.unionByName(pooled)


@query(
    "ag13_origin_slope", "chips",
    oracle="SELECT chip_id, pass, round(sum(CASE WHEN y < 14 THEN b11 * b12 END) / nullif(sum(CASE WHEN y < 14 THEN b12 * b12 END), 0), 6) AS c FROM chips GROUP BY ALL",
)
def origin_slope(spark, sf):
    keep = F.col("y") < 14
    return v.chips(spark, sf).groupBy("chip_id", "pass").agg(r6(retrieval.fit_ratio(F.col("b11"), F.col("b12"), keep)).alias("c"))
