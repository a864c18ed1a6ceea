"""Filters, gates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN, DEFAULT_PALETTE
from skylattice.catalog.registry import catalog_table
from skylattice.functions import display
from skylattice.functions.geo import box, in_box, outline, roi_filter
from skylattice.operators import classify, composites, gates
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import CLEAR_SQL, DATES_SQL, END, ROI, ROI_SQL, START, r6
from skylattice.sources import scans

FULL = ("1990-01-01", "2010-01-01")


def _per_tile(df):
    return df.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum("B4").alias("b4"))


_PER_TILE = "SELECT tile_id, count(*) AS n, CAST(sum(B4) AS BIGINT) AS b4 FROM px WHERE {} GROUP BY tile_id"


@query("flt01_date_range", "px", oracle=_PER_TILE.format(DATES_SQL))
def date_range(spark, sf):
    return _per_tile(v.px(spark, sf).where(scans.date_range(F.col("ts"), START, END)))


@query(
    "flt02_cloud_ceiling", "px",
    oracle="""SELECT tile_id, count(CASE WHEN cloud_pct <= 65 THEN 1 END) AS browse, count(CASE WHEN cloud_pct <= 80 THEN 1 END) AS list,
      count(CASE WHEN cloud_pct <= 30 THEN 1 END) AS reference, count(*) AS detect FROM px WHERE cloud_pct <= 90 GROUP BY tile_id""",
)
def cloud_ceiling(spark, sf):
    c = F.col("cloud_pct")
    kept = v.px(spark, sf).where(c <= scans.DETECT_CLOUD_MAX)
    limits = {"browse": scans.BROWSE_CLOUD_MAX, "list": scans.LIST_CLOUD_MAX, "reference": scans.REFERENCE_CLOUD_MAX}
    return kept.groupBy("tile_id").agg(*[F.count_if(c <= x).alias(k) for k, x in limits.items()], F.count("*").alias("detect"))


@query(
    "flt03_radar_metadata", "px",
    oracle=_PER_TILE.format("mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH') AND orbit_pass = 'DESCENDING' AND relative_orbit = 3"),
)
def radar_metadata(spark, sf):
    return _per_tile(v.px(spark, sf).where(scans.radar_filters("DESCENDING", 3)))


TRIANGLE = outline(((-167.9037, 49.8513), (-166.0011, 49.9987), (-164.3019, 49.8721)))


def _crossings_sql() -> str:
    ring = TRIANGLE.ring
    return " + ".join(
        f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2 - x1!r}) * (lat - {y1}) / ({y2 - y1!r}) + ({x1}) THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])
    )


@query(
    "flt04_region_clip", "px",
    oracle=f"""
    SELECT tile_id, count(CASE WHEN {ROI_SQL} THEN 1 END) AS n_box, count(CASE WHEN inside THEN 1 END) AS n_polygon, count(*) AS n_global
    FROM (SELECT *, lon >= -167.9037 AND lon <= -164.3019 AND lat >= 49.8513 AND lat <= 49.9987 AND ({_crossings_sql()}) % 2 = 1 AS inside FROM px)
    GROUP BY tile_id""",
)
def region_clip(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    assert roi_filter(lon, lat, box(-180, -90, 180, 90)) is None
    return v.px(spark, sf).groupBy("tile_id").agg(
        F.count_if(in_box(lon, lat, ROI)).alias("n_box"), F.count_if(roi_filter(lon, lat, TRIANGLE)).alias("n_polygon"), F.count("*").alias("n_global")
    )


@query(
    "flt05_valid_range", "px",
    oracle="""SELECT tile_id, count(*) AS n, count(CASE WHEN v BETWEEN 0 AND 0.3 THEN v END) AS n_valid, round(avg(CASE WHEN v BETWEEN 0 AND 0.3 THEN v END), 6) AS mean
      FROM (SELECT tile_id, O3_column_number_density AS v FROM px) GROUP BY tile_id""",
)
def valid_range(spark, sf):
    o3 = BUILTIN["s5p"].get("O3")
    df = v.px(spark, sf).select("tile_id", scans.mask_valid(F.col(o3.band), o3).alias("v"))
    return df.groupBy("tile_id").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), r6(F.avg("v")).alias("mean"))


@query(
    "flt06_cloud_pixels", "px",
    oracle=f"""SELECT tile_id, prob_present, prob IS NULL AS prob_null, count(*) AS n, count(CASE WHEN {CLEAR_SQL} THEN 1 END) AS n_kept FROM px GROUP BY ALL""",
)
def cloud_pixels(spark, sf):
    return v.px(spark, sf).groupBy("tile_id", "prob_present", F.col("prob").isNull().alias("prob_null")).agg(
        F.count("*").alias("n"), F.count_if(scans.cloud_free()).alias("n_kept")
    )


@query(
    "flt07_vegetation_water_mask", "px",
    oracle=f"""
    WITH m AS (SELECT tile_id, y, x, sum(B3) / 10000.0 / count(B3) AS g, sum(B4) / 10000.0 / count(B4) AS r, sum(B8) / 10000.0 / count(B8) AS nir
      FROM px WHERE cloud_pct <= 65 AND {CLEAR_SQL} GROUP BY ALL),
    k AS (SELECT tile_id, y, x, (nir - r) / nullif(nir + r, 0) <= 0.4 AND (g - nir) / nullif(g + nir, 0) <= -0.4 AS keep FROM m)
    SELECT tile_id, y, x, count(*) AS n, count(CASE WHEN keep THEN 1 END) AS n_kept, round(avg(CASE WHEN keep THEN B12 END), 6) AS value
    FROM px LEFT JOIN k USING (tile_id, y, x) GROUP BY ALL""",
)
def vegetation_water_mask(spark, sf):
    px = v.px(spark, sf)
    base = scans.optical_base(px, None, *FULL, ("B3", "B4", "B8"))
    df = composites.vegetation_water_mask(px.select("tile_id", "y", "x", F.col("B12").alias("value")), base, ndvi_max=0.4, ndwi_max=-0.4)
    return df.groupBy("tile_id", "y", "x").agg(F.count("*").alias("n"), F.count("value").alias("n_kept"), r6(F.avg("value")).alias("value"))


@query(
    "flt09_fill_sentinel", "px",
    oracle="""SELECT tile_id, count(*) AS n, count(v) AS n_valid, count(CASE WHEN v = 0 THEN 1 END) AS n_zero, round(avg(v), 6) AS mean FROM (
      SELECT tile_id, CASE WHEN dn <> -9999 THEN dn / 10000.0 END AS v FROM (SELECT tile_id, CASE WHEN B2 % 17 = 0 THEN -9999 WHEN B2 % 17 = 1 THEN 0 ELSE B2 END AS dn FROM px))
      GROUP BY tile_id""",
)
def fill_sentinel(spark, sf):
    dn = F.when(F.col("B2") % 17 == 0, scans.FILL_DN).when(F.col("B2") % 17 == 1, 0).otherwise(F.col("B2"))
    df = scans.to_reflectance(v.px(spark, sf).select("tile_id", dn.alias("B2")), ("B2",))
    return df.groupBy("tile_id").agg(
        F.count("*").alias("n"), F.count("B2").alias("n_valid"), F.count_if(F.col("B2") == 0).alias("n_zero"), r6(F.avg("B2")).alias("mean")
    )


def site_boxes(spark, sf):
    """Region table: one box per customer, some of them invalid."""
    c = v.read(spark, sf, "customer")
    k = F.col("c_custkey")
    west = (k * 37 % 370 - 185).cast("double")
    south = (k * 53 % 190 - 95).cast("double")
    return c.select(k.alias("id"), west.alias("west"), south.alias("south"),
                    (west + k % 7 * F.lit(0.1) - 0.1).alias("east"), (south + k % 5 * F.lit(0.05)).alias("north"))


v.VIEW_SQL["boxes"] = ((), """
SELECT c_custkey AS id, CAST(c_custkey * 37 % 370 - 185 AS DOUBLE) AS west, CAST(c_custkey * 53 % 190 - 95 AS DOUBLE) AS south,
  CAST(c_custkey * 37 % 370 - 185 AS DOUBLE) + c_custkey % 7 * 0.1 - 0.1 AS east,
  CAST(c_custkey * 53 % 190 - 95 AS DOUBLE) + c_custkey % 5 * 0.05 AS north FROM customer""")
_BOX_REASON = """CASE WHEN NOT (west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180) THEN 'longitude out of range'
  WHEN NOT (south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90) THEN 'latitude out of range'
  WHEN east <= west THEN 'east must exceed west' WHEN north <= south THEN 'north must exceed south' END"""


@query("flt10_region_validation", "boxes", oracle=f"SELECT id, {_BOX_REASON} AS reason FROM boxes")
def region_validation(spark, sf):
    ok, bad = gates.split_rejects(site_boxes(spark, sf), gates.region_problem())
    return ok.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


@query(
    "flt11_date_validation",
    oracle="""SELECT o_orderkey AS id, CASE WHEN o_orderdate + to_days(CAST(o_orderkey % 5 - 1 AS INTEGER)) <= o_orderdate THEN 'end must be after start' END AS reason FROM orders""",
)
def date_validation(spark, sf):
    o = v.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5 - 1).cast("int")).alias("end"),
    )
    return o.select("id", gates.date_problem(F.col("start"), F.col("end")).alias("reason"))


@query(
    "flt12_product_refusals", "px",
    oracle="""SELECT key, CASE key WHEN 'CH4_ANOMALY' THEN 'needs its own builder' WHEN 'DNBR' THEN 'needs a reference window' WHEN 'RGB' THEN 'colour stack' END AS reason, count(*) AS n
      FROM (SELECT CASE B2 % 4 WHEN 0 THEN 'CH4_ANOMALY' WHEN 1 THEN 'DNBR' WHEN 2 THEN 'RGB' ELSE 'NDVI' END AS key FROM px) GROUP BY ALL""",
)
def product_refusals(spark, sf):
    m = F.col("B2") % 4
    req = v.px(spark, sf).select(F.when(m == 0, "CH4_ANOMALY").when(m == 1, "DNBR").when(m == 2, "RGB").otherwise("NDVI").alias("key"))
    cat = catalog_table(spark).where("dataset_id = 's2'").select("key", "builder", "needs_ref", "is_rgb")
    return req.join(F.broadcast(cat), "key").groupBy("key", gates.product_problem().alias("reason")).agg(F.count("*").alias("n"))


@query(
    "flt13_inversion_validity", "px",
    oracle="""
    SELECT scene_id, tile_id, n_mask, round(share, 6) AS invalid_share,
      CASE WHEN n_mask = 0 THEN 'no_plume' WHEN share > 0.2 THEN 'out_of_validity' WHEN rate IS NULL THEN 'non_finite_rate' END AS exclusion_reason
    FROM (SELECT scene_id, tile_id, count(CASE WHEN VV > -14 THEN 1 END) AS n_mask,
        coalesce(avg(CASE WHEN VV > -14 THEN CAST(abs(d) >= 3 AS INTEGER) END), 0) AS share, avg(CASE WHEN VV > -8 THEN d END) AS rate
      FROM (SELECT *, vertical_column_enhancement / 2200.0 AS d FROM px) GROUP BY scene_id, tile_id)""",
)
def inversion_validity(spark, sf):
    d = F.col("vertical_column_enhancement") / 2200.0
    mask = F.col("VV") > -14
    per = v.px(spark, sf).groupBy("scene_id", "tile_id").agg(
        F.count_if(mask).alias("n_mask"), gates.invalid_share(d, mask).alias("share"), F.avg(F.when(F.col("VV") > -8, d)).alias("rate")
    )
    return per.select("scene_id", "tile_id", "n_mask", r6("share").alias("invalid_share"),
                      gates.exclusion_reason(F.col("n_mask"), F.col("share"), F.col("rate")).alias("exclusion_reason"))


@query(
    "flt14_detection_feed", "feed",
    oracle="""SELECT det_id, site_id, status, source, CAST(created AS VARCHAR) AS created FROM feed
      WHERE status = 'new' AND source = 'ml' ORDER BY created DESC, det_id DESC LIMIT 50 OFFSET 20""",
)
def detection_feed(spark, sf):
    df = v.feed(spark, sf).where((F.col("status") == "new") & (F.col("source") == "ml"))
    page = df.orderBy(F.desc("created"), F.desc("det_id")).offset(20).limit(50)
    return page.select("det_id", "site_id", "status", "source", F.col("created").cast("string").alias("created"))


@query(
    "flt15_chip_validity", "px",
    oracle=f"""SELECT scene_id, tile_id, round(valid, 6) AS valid_share FROM (
      SELECT scene_id, tile_id, avg(CAST({CLEAR_SQL} AS INTEGER)) AS valid FROM px GROUP BY ALL) WHERE valid >= 0.95""",
)
def chip_validity(spark, sf):
    bands = scans.mask_bands(v.px(spark, sf), scans.cloud_free(), ("B11", "B12"))
    ok = (F.col("B11").isNotNull() & F.col("B12").isNotNull()).cast("int")
    per = bands.groupBy("scene_id", "tile_id").agg(F.avg(ok).alias("valid"))
    return per.where(F.col("valid") >= gates.VALID_SHARE_MIN).select("scene_id", "tile_id", r6("valid").alias("valid_share"))


@query(
    "flt16_chip_size_guard", "boxes",
    oracle=f"""SELECT id, CASE WHEN w > 1024 OR h > 1024 THEN w || 'x' || h || ' exceeds the chip limit' END AS reason FROM (
      SELECT id, greatest(1, CAST(ceil((east - west) / (20.0 / (111320.0 * cos(radians((south + north) / 2))))) AS BIGINT)) AS w,
        greatest(1, CAST(ceil((north - south) / (20.0 / 111320.0)) AS BIGINT)) AS h FROM boxes WHERE {_BOX_REASON} IS NULL)""",
)
def chip_size_guard(spark, sf):
    ok, _ = gates.split_rejects(site_boxes(spark, sf), gates.region_problem())
    return ok.select("id", gates.chip_size_problem().alias("reason"))


@query(
    "prj01_generic_band_math", "px",
    oracle="""SELECT scene_id, tile_id, round(avg(CASE WHEN v BETWEEN -1 AND 1 THEN v END), 6) AS value, count(v) AS n FROM (
      SELECT scene_id, tile_id, (B8 - B4) / nullif(CAST(B2 % 13 AS DOUBLE), 0) / 977.0 AS v FROM px) GROUP BY ALL""",
)
def generic_band_math(spark, sf):
    from skylattice.catalog.products import Product

    user = Product("user", "X", 0, 1, -1, 1, "", expression="(B8 - B4) / R / 977.0", bands=("B8", "B4", "R"))
    px = v.px(spark, sf).withColumn("R", (F.col("B2") % 13).cast("double"))
    from skylattice.sources.scans import product_column

    df = px.select("scene_id", "tile_id", product_column(user).alias("v"))
    return df.groupBy("scene_id", "tile_id").agg(r6(F.avg(scans.mask_valid(F.col("v"), user))).alias("value"), F.count("v").alias("n"))


_BANDS = ("B1", "B5", "B8A", "B12")


@query(
    "prj02_reflectance", "px",
    oracle="SELECT tile_id, " + ", ".join(f"round(sum({b} / 10000.0), 4) AS {b.lower()}" for b in _BANDS) + " FROM px GROUP BY tile_id",
)
def reflectance(spark, sf):
    df = scans.to_reflectance(v.px(spark, sf), _BANDS)
    return df.groupBy("tile_id").agg(*[r6(F.sum(b), 4).alias(b.lower()) for b in _BANDS])


@query("prj03_colour_stack", "px", oracle=f"SELECT scene_id, tile_id, y, x, B4 AS r, B3 AS g, B2 AS b FROM px WHERE {DATES_SQL} AND {ROI_SQL}")
def colour_stack(spark, sf):
    df = scans.scan(v.px(spark, sf), ROI, START, END)
    stack = scans.product_column(BUILTIN["s2"].get("RGB"))
    return df.withColumn("rgb", stack).select("scene_id", "tile_id", "y", "x", F.col("rgb.B4").alias("r"), F.col("rgb.B3").alias("g"), F.col("rgb.B2").alias("b"))


@query(
    "prj04_band_rename", "px",
    oracle=f"SELECT scene_id, tile_id, y, x, round(tropospheric_NO2_column_number_density, 8) AS no2 FROM px WHERE {DATES_SQL} AND {ROI_SQL}",
)
def band_rename(spark, sf):
    no2 = BUILTIN["s5p"].get("NO2")
    return scans.scan(v.px(spark, sf), ROI, START, END).select("scene_id", "tile_id", "y", "x", r6(F.col(no2.band), 8).alias("no2"))


def _value_query(name: str, key: str, source: str, sql: str):
    @query(name, "px", oracle=f"SELECT scene_id, tile_id, count(value) AS n, round(avg(value), 6) AS value FROM (SELECT scene_id, tile_id, {sql} AS value FROM px) GROUP BY ALL")
    def build(spark, sf):
        p = BUILTIN[source].get(key)
        df = v.px(spark, sf).select("scene_id", "tile_id", scans.product_column(p).alias("value"))
        return df.groupBy("scene_id", "tile_id").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("value"))


_value_query("prj05_chlorophyll", "CHLA", "s2", "4.26 * pow(B5 / B4, 3.94)")
_value_query("prj06_swir_ratio", "B12_B11", "s2", "B12 / nullif(B11, 0)")
_value_query("prj07_polarisation_difference", "VV_VH_RATIO", "s1", "VV - VH")
_value_query("prj08_radar_vegetation", "RVI", "s1", "4 * pow(10, VH / 10) / (pow(10, VV / 10) + pow(10, VH / 10))")


def _channel_sql(at: int, palette=DEFAULT_PALETTE) -> str:
    stops = "[" + ", ".join(str(int(c[at:at + 2], 16)) for c in palette) + "]"
    return f"CAST(round_even({stops}[i + 1] + ({stops}[i + 2] - {stops}[i + 1]) * (t - i), 0) AS INTEGER)"


@query(
    "prj10_palette_colour", "px",
    oracle=f"""SELECT r, g, b, count(*) AS n FROM (SELECT {_channel_sql(1)} AS r, {_channel_sql(3)} AS g, {_channel_sql(5)} AS b
      FROM (SELECT t, least(CAST(floor(t) AS BIGINT), 8) AS i FROM (
        SELECT greatest(0.0, least(1.0, (v - -25.0) / 25.0)) * 9 AS t FROM (SELECT VV AS v FROM px)))) GROUP BY ALL""",
)
def palette_colour(spark, sf):
    p = BUILTIN["s1"].get("VV")
    rgb = display.sample_palette(F.col("VV"), p.vis_min, p.vis_max, p.palette)
    df = v.px(spark, sf).select(rgb.alias("c"))
    return df.groupBy(F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b")).agg(F.count("*").alias("n"))


# The vegetation palette.
_GREENS = ("#d73027", "#f46d43", "#fdae61", "#fee08b", "#ffffbf", "#d9ef8b", "#a6d96a", "#66bd63", "#1a9850", "#006837")


@query(
    "prj10_vegetation_colour", "px",
    oracle=f"""SELECT r, g, b, count(*) AS n FROM (SELECT {_channel_sql(1, _GREENS)} AS r, {_channel_sql(3, _GREENS)} AS g, {_channel_sql(5, _GREENS)} AS b
      FROM (SELECT t, least(CAST(floor(t) AS BIGINT), 8) AS i FROM (
        SELECT greatest(0.0, least(1.0, (v - -0.2) / (0.9 - -0.2))) * 9 AS t FROM (SELECT (B8 - B4) / (B8 + B4) AS v FROM px)))) GROUP BY ALL""",
)
def vegetation_colour(spark, sf):
    p = BUILTIN["s2"].get("NDVI")
    df = v.px(spark, sf).select(display.sample_palette((F.col("B8") - F.col("B4")) / (F.col("B8") + F.col("B4")), p.vis_min, p.vis_max, p.palette).alias("c"))
    return df.groupBy(F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b")).agg(F.count("*").alias("n"))


# Means as whole sums over counts: limits must not hang on the order in which rows are added.
_MEAN_SQL = ", ".join(f"sum({b}) / 10000.0 / count({b}) AS {b.lower()}" for b in ("B3", "B4", "B8", "B11", "B12"))


@query(
    "prj11_source_class", "px",
    oracle=f"""
    WITH o AS (SELECT tile_id, y, x, {_MEAN_SQL}
      FROM px WHERE cloud_pct <= 65 AND {CLEAR_SQL} GROUP BY ALL),
    s AS (SELECT tile_id, y, x, sum(CAST(round(VV * 10.0) AS BIGINT)) / 10.0 / count(VV) AS vv FROM px WHERE mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH') GROUP BY ALL),
    j AS (SELECT *, (b8 - b4) / nullif(b8 + b4, 0) AS ndvi, (b3 - b8) / nullif(b3 + b8, 0) AS ndwi, (b12 - b11) / nullif(b11, 0) AS mbsp FROM s JOIN o USING (tile_id, y, x)),
    n AS (SELECT tile_id, y, x, CASE WHEN (mbsp < -0.02 OR (b11 > 0.5 AND b12 > 0.5)) AND vv > -10 AND ndvi < 0.35 THEN 1
        WHEN mbsp < -0.02 AND ndvi > 0.35 THEN 2 WHEN mbsp < -0.02 AND (ndwi > 0.1 OR vv < -18) THEN 3
        WHEN mbsp < -0.04 AND ndvi < 0.35 AND NOT ndvi < 0.1 AND NOT vv < -18 AND NOT vv > -10 THEN 4 ELSE 5 END AS source_class FROM j)
    SELECT tile_id, source_class, count(*) AS n FROM n GROUP BY ALL""",
)
def source_class(spark, sf):
    px = v.px(spark, sf)
    opt = composites.exact_mean_composite(scans.optical_base(px, None, *FULL, ("B3", "B4", "B8", "B11", "B12")), ("B3", "B4", "B8", "B11", "B12"))
    opt = opt.where(F.col("B11").isNotNull())
    sar = composites.exact_mean_composite(px.where(scans.radar_filters()), ("VV",))
    cls = classify.source_class(*[F.col(c) for c in ("VV", "B3", "B4", "B8", "B11", "B12")])
    return sar.join(opt, ["tile_id", "y", "x"]).groupBy("tile_id", cls.alias("source_class")).agg(F.count("*").alias("n"))


@query(
    "prj12_unit_conversions", "px",
    oracle="""SELECT tile_id, round(avg(d / 356700.0 * 1e9), 4) AS ppb, round(avg(pi_q / 1000.0), 6) AS t_h FROM (
      SELECT tile_id, vertical_column_enhancement / 10000.0 AS d, CAST(B8 AS DOUBLE) AS pi_q FROM px) GROUP BY tile_id""",
)
def unit_conversions(spark, sf):
    px = v.px(spark, sf)
    return px.groupBy("tile_id").agg(
        r6(F.avg(display.column_to_ppb(F.col("vertical_column_enhancement") / 10000.0)), 4).alias("ppb"),
        r6(F.avg(display.kgh_to_th(F.col("B8").cast("double")))).alias("t_h"),
    )


@query(
    "prj13_flag_labels", "feed",
    oracle="""SELECT flag, hint, count(*) AS n FROM (
      SELECT unnest(CAST(json_extract_string(result_json, '$.flags[*]') AS VARCHAR[])) AS flag FROM feed)
      JOIN (VALUES ('no_plume', 'nothing rose above the threshold'), ('unstable_mask', 'the mask size swings fourfold or more over the thresholds'),
        ('flare_lit_target', 'a lit flare in the target scene was excluded')) AS h(flag, hint) USING (flag) GROUP BY ALL""",
)
def flag_labels(spark, sf):
    flags = F.explode(F.from_json("result_json", "flags array<string>")["flags"])
    df = v.feed(spark, sf).select(flags.alias("flag"))
    return df.join(F.broadcast(display.flag_table(spark)), "flag", "left").groupBy("flag", "hint").agg(F.count("*").alias("n"))


@query(
    "prj14_legend_range", "px",
    oracle="""SELECT key, vmin, vmax, count(*) AS n FROM (
      SELECT key, coalesce(CASE WHEN B3 % 3 = 0 THEN -0.5 END, CASE key WHEN 'NDVI' THEN -0.2 ELSE -0.8 END) AS vmin,
        coalesce(CASE WHEN B3 % 5 = 0 THEN 0.95 END, CASE key WHEN 'NDVI' THEN 0.9 ELSE 0.8 END) AS vmax
      FROM (SELECT B3, CASE WHEN B2 % 2 = 0 THEN 'NDVI' ELSE 'NDWI' END AS key FROM px)) GROUP BY ALL""",
)
def legend_range(spark, sf):
    req = v.px(spark, sf).select(
        F.when(F.col("B2") % 2 == 0, "NDVI").otherwise("NDWI").alias("key"),
        F.when(F.col("B3") % 3 == 0, -0.5).alias("omin"), F.when(F.col("B3") % 5 == 0, 0.95).alias("omax"),
    )
    cat = catalog_table(spark).where("dataset_id = 's2'").select("key", "vis_min", "vis_max")
    lo, hi = display.legend_range(F.col("omin"), F.col("omax"), F.col("vis_min"), F.col("vis_max"))
    return req.join(F.broadcast(cat), "key").groupBy("key", lo.alias("vmin"), hi.alias("vmax")).agg(F.count("*").alias("n"))
