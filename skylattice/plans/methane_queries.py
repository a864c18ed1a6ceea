"""Retrieval, inversion, rates and whole detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.inversion import invert_signal
from skylattice.operators import detection, emission, folds, plume, retrieval
from skylattice.plans import views as v
from skylattice.plans.match_queries import BRACKET, INVERTED, LUT_CTES
from skylattice.plans.raster_queries import CHIP, field, sources
from skylattice.plans.raster_sql import plume_sql, retrieval_sql
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6
from skylattice.session import materialize

PASS = ("chip_id", "pass")
_EXCL = "SELECT chip_id, pass, y, x, b11, b12, (chip_id % 4 = 1 AND abs(y - 3) <= 1 AND abs(x - 12) <= 1) AS excl FROM chips"
v.VIEW_SQL["passes"] = (("chips",), _EXCL)


@query(
    "me01_single_pass", "passes",
    oracle=f"""WITH {retrieval_sql('passes', 'a', 'chip_id, pass', False).replace('USING (chip_id, pass)', 'USING (chip_id, pass)')}
      SELECT chip_id, pass, round(any_value(c), 6) AS c, round(any_value(c_initial), 6) AS c_initial, CAST(any_value(n_excluded) AS BIGINT) AS n_excluded, round(avg(delta_r), 6) AS mean_dr, round(stddev_pop(delta_r), 6) AS sd FROM a GROUP BY ALL""".replace("coalesce(excl, false)", "false"),
)
def single_pass(spark, sf):
    df = retrieval.single_pass(v.chips(spark, sf).select(*PASS, "y", "x", "b11", "b12"), PASS)
    return df.groupBy(*PASS).agg(
        r6(F.first("c")).alias("c"), r6(F.first("c_initial")).alias("c_initial"), F.first("n_excluded").alias("n_excluded"),
        r6(F.avg("delta_r")).alias("mean_dr"), r6(F.stddev_pop("delta_r")).alias("sd"),
    )


@query(
    "me01_robust_pass", "passes",
    oracle=f"""WITH {retrieval_sql('passes', 'a', 'chip_id, pass', True)}
      SELECT chip_id, pass, y, x, round(delta_r, 6) AS delta_r, round(c, 6) AS c, CAST(n_excluded AS BIGINT) AS n_excluded FROM a""",
)
def robust_pass(spark, sf):
    hot = (F.col("chip_id") % 4 == 1) & (F.abs(F.col("y") - 3) <= 1) & (F.abs(F.col("x") - 12) <= 1)
    df = retrieval.single_pass(v.chips(spark, sf).select(*PASS, "y", "x", "b11", "b12"), PASS, robust=True, exclude=hot)
    return df.select(*PASS, "y", "x", r6("delta_r").alias("delta_r"), r6("c").alias("c"), "n_excluded")


v.VIEW_SQL["csig"] = (("chips",), """SELECT chip_id, pass, y, x, CASE WHEN chip_id % 2 = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS spacecraft,
  2.05 + chip_id % 9 * 0.27 AS amf, b12 / b11 / 0.8 - 1.0 AS signal FROM chips""")


def chip_signals(spark, sf):
    craft = F.when(F.col("chip_id") % 2 == 0, "Sentinel-2A").otherwise("Sentinel-2B")
    return v.chips(spark, sf).select(
        *PASS, "y", "x", craft.alias("spacecraft"), (2.05 + F.col("chip_id") % 9 * F.lit(0.27)).alias("amf"), (F.col("b12") / F.col("b11") / 0.8 - 1.0).alias("signal")
    )


def _two_tables(src: str) -> str:
    return f"""inv AS (SELECT p.chip_id, p.pass, p.y, p.x, p.signal, {INVERTED.format(s='r', v='p.signal')} AS reported, {INVERTED.format(s='m', v='p.signal')} AS masked FROM {src} p
      LEFT JOIN seg r ON r.lut_version = 'report' AND r.spacecraft = p.spacecraft AND r.amf = p.amf AND {BRACKET.format(s='r', v='p.signal')}
      LEFT JOIN seg m ON m.lut_version = 'mask' AND m.spacecraft = p.spacecraft AND m.amf = p.amf AND {BRACKET.format(s='m', v='p.signal')})"""


@query(
    "me02_two_table_inversion", "csig", "lut",
    oracle="WITH " + LUT_CTES.format(src="csig") + ", " + _two_tables("csig") + " SELECT chip_id, pass, y, x, round(reported, 5) AS reported, round(masked, 5) AS masked FROM inv",
)
def two_table_inversion(spark, sf):
    lut = v.lut(spark)
    df = invert_signal(chip_signals(spark, sf), lut, "report", "signal", "reported")
    df = invert_signal(df, lut, "mask", "signal", "masked")
    return df.select(*PASS, "y", "x", r6("reported", 5).alias("reported"), r6("masked", 5).alias("masked"))


# Chip geometry and wind for the rate queries.
v.VIEW_SQL["site"] = (("chips",), "SELECT DISTINCT chip_id, 400.0 + chip_id % 3 AS area_m2, 2.5 + chip_id % 7 * 0.5 AS u10, 1.5 + chip_id % 4 * 0.1 AS sigma_u10 FROM chips")
v.VIEW_SQL["colfield"] = (("chips",), "SELECT chip_id, y, x, (0.8 - b12 / b11) * 10 AS value FROM chips WHERE pass = 1")


def chip_sites(spark, sf):
    k = F.col("chip_id")
    # the numbers alone: the pixels of the chips need not be gathered for them
    ids = v.read(spark, sf, "lineitem").select(F.expr("l_suppkey div 4").alias("chip_id")).distinct()
    return ids.select("chip_id", (400.0 + k % 3).alias("area_m2"), (2.5 + k % 7 * 0.5).alias("u10"), (1.5 + k % 4 * F.lit(0.1)).alias("sigma_u10"))


def columns(spark, sf):
    return field(spark, sf).select("chip_id", "y", "x", (F.col("value") * 10).alias("delta_omega"))


def swept_masks(spark, sf):
    """The columns and their masks over the sweep, each written once: the steps that follow read both more than once."""
    f = materialize(columns(spark, sf), "columns")
    masks = plume.detect_plumes(f.withColumnRenamed("delta_omega", "value"), CHIP, ks=plume.K_SWEEP, sources=sources(spark, sf))
    return f, materialize(masks, "masks")


_MASK = plume_sql("colfield", "pl", "2.0", source="sources")


@query(
    "me04_rate_over_mask", "colfield", "site", "sources",
    oracle=f"""WITH RECURSIVE {_MASK}, t AS (SELECT f.chip_id, f.value, p.k IS NOT NULL AS m FROM colfield f LEFT JOIN pl p USING (chip_id, y, x)),
      nm AS (SELECT chip_id, median(value) AS med FROM t WHERE NOT m GROUP BY chip_id), ns AS (SELECT chip_id, 1.4826 * median(abs(value - med)) AS s FROM t JOIN nm USING (chip_id) WHERE NOT m GROUP BY chip_id),
      a AS (SELECT chip_id, count(CASE WHEN m THEN 1 END) AS n, coalesce(sum(CASE WHEN m THEN value END), 0) AS v FROM t GROUP BY chip_id)
      SELECT chip_id, n AS n_pixels, round(v * area_m2 * 0.01604, 5) AS ime_kg, round(sqrt(n * area_m2), 5) AS l_m, round((0.33 * u10 + 0.45) / sqrt(n * area_m2) * v * area_m2 * 0.01604 * 3600, 4) AS q_kg_h, round(s, 6) AS sigma_noise
      FROM a JOIN site USING (chip_id) JOIN ns USING (chip_id)""",
)
def rate_over_mask(spark, sf):
    f = columns(spark, sf)
    mask = plume.detect_plumes(f.withColumnRenamed("delta_omega", "value"), CHIP, sources=sources(spark, sf))
    df = emission.emission_over_mask(f, CHIP, mask, chip_sites(spark, sf))
    return df.select("chip_id", "n_pixels", r6("ime_kg", 5).alias("ime_kg"), r6("l_m", 5).alias("l_m"), r6("q_kg_h", 4).alias("q_kg_h"), r6("sigma_noise").alias("sigma_noise"))


_SWEEP = plume_sql("colfield", "pl", "1.5, 1.75, 2.0, 2.25, 2.5", source="sources")
_U = "('0x' || substr(md5('0|' || chip_id || '|' || d || '|{s}'), {at}, 8))::BIGINT"
_N = "sqrt(-2 * ln(({a} + 0.5) / 4294967296.0)) * cos(2 * pi() * ({b} / 4294967296.0))"


def _normal(stream: str) -> str:
    return _N.format(a=_U.format(s=stream, at=1), b=_U.format(s=stream, at=9))


_DRAWS = f"""
 sw AS (SELECT s.chip_id, k, count(p.y) AS n, coalesce(sum(f.value), 0) * any_value(area_m2) * 0.01604 AS ime, sqrt(count(p.y) * any_value(area_m2)) AS len, row_number() OVER (PARTITION BY s.chip_id ORDER BY k) - 1 AS ki
   FROM site s CROSS JOIN (SELECT unnest([1.5, 1.75, 2.0, 2.25, 2.5]) AS k) LEFT JOIN pl p USING (chip_id, k) LEFT JOIN colfield f USING (chip_id, y, x) GROUP BY s.chip_id, k),
 off AS (SELECT f.chip_id, f.value, row_number() OVER (PARTITION BY f.chip_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY f.chip_id) AS np FROM colfield f LEFT JOIN (SELECT * FROM pl WHERE k = 2.0) p USING (chip_id, y, x) WHERE p.k IS NULL),
 np AS (SELECT chip_id, max(np) AS np FROM off GROUP BY chip_id),
 dr AS (SELECT chip_id, area_m2, d, CAST(floor({_U.format(s='k', at=1)} / 4294967296.0 * 5) AS BIGINT) AS ki, greatest(0.1, u10 + sigma_u10 * {_normal('wind')}) AS u, 1.0 + 0.15 * {_normal('model')} AS model, {_U.format(s='pool', at=1)} % 2147483647 AS start
   FROM site CROSS JOIN (SELECT unnest(range({{draws}})) AS d)),
 jd AS (SELECT dr.*, n, ime, len, np FROM dr JOIN sw USING (chip_id, ki) JOIN np USING (chip_id)),
 ix AS (SELECT chip_id, d, ((a + a // 65536) * 69621 % 2147483647) % np AS i FROM (SELECT chip_id, d, np, ((start + g * 7919) % 2147483647) * 48271 % 2147483647 AS a FROM (SELECT *, unnest(range(1, n + 1)) AS g FROM jd WHERE n > 0))),
 nz AS (SELECT chip_id, d, sum(value) AS noise FROM ix JOIN off USING (chip_id, i) GROUP BY ALL),
 q AS (SELECT jd.chip_id, (0.33 * u + 0.45) / nullif(len, 0) * (ime + coalesce(noise, 0) * area_m2 * 0.01604) * 3600 * model AS q FROM jd LEFT JOIN nz USING (chip_id, d))"""


@query(
    "me03_rate_uncertainty", "colfield", "site", "sources",
    oracle=f"WITH RECURSIVE {_SWEEP}, {_DRAWS.format(draws=500)} SELECT chip_id, count(q) AS n_draws, round(median(q), 3) AS q_kg_h, round(stddev_pop(q), 3) AS q_sigma_kg_h, round(quantile_cont(q, 0.05), 3) AS p05, round(quantile_cont(q, 0.95), 3) AS p95 FROM q WHERE q IS NOT NULL GROUP BY chip_id",
)
def rate_uncertainty(spark, sf):
    f, masks = swept_masks(spark, sf)
    sites = chip_sites(spark, sf)
    sweep = emission.sweep_masses(f, CHIP, masks, sites).join(sites.drop("area_m2"), "chip_id")
    off = f.join(masks.where("k = 2.0").select("chip_id", "y", "x"), ["chip_id", "y", "x"], "left_anti")
    mc = emission.monte_carlo(sweep, off, CHIP, F.col("chip_id"))
    return mc.select(
        "chip_id", F.col("n_draws").cast("bigint").alias("n_draws"), r6("q_kg_h", 3).alias("q_kg_h"), r6("q_sigma_kg_h", 3).alias("q_sigma_kg_h"),
        r6(F.col("percentiles")["p05"], 3).alias("p05"), r6(F.col("percentiles")["p95"], 3).alias("p95"),
    )


@query(
    "me06_mask_stability", "colfield", "sources",
    oracle=f"""WITH RECURSIVE {_SWEEP}, n AS (SELECT chip_id, k, count(p.y) AS n FROM (SELECT DISTINCT chip_id FROM pl) CROSS JOIN (SELECT unnest([1.5, 1.75, 2.0, 2.25, 2.5]) AS k) LEFT JOIN pl p USING (chip_id, k) GROUP BY ALL)
      SELECT chip_id, min(n) AS smallest, max(n) AS largest, min(n) = 0 OR max(n) >= 4 * min(n) AS unstable FROM n GROUP BY chip_id""",
)
def mask_stability(spark, sf):
    f, masks = swept_masks(spark, sf)
    sweep = emission.sweep_masses(f, CHIP, masks, chip_sites(spark, sf))
    return sweep.select("chip_id", F.array_min("n_k").alias("smallest"), F.array_max("n_k").alias("largest"), emission.unstable(F.col("n_k")).alias("unstable"))


v.VIEW_SQL["reffield"] = (("chips",), "SELECT chip_id, y, x, 0.8 - b12 / b11 AS value FROM chips WHERE pass = CASE WHEN chip_id % 3 = 0 THEN 1 ELSE 0 END")


@query(
    "me07_reference_contamination", "reffield", "sources",
    oracle=f"WITH RECURSIVE {plume_sql('reffield', 'pl', '2.0', source='sources')} SELECT r.chip_id, count(p.y) > 0 AS contaminated FROM (SELECT DISTINCT chip_id FROM reffield) r LEFT JOIN pl p USING (chip_id) GROUP BY ALL",
)
def reference_contamination(spark, sf):
    c = v.chips(spark, sf).where(F.col("pass") == F.when(F.col("chip_id") % 3 == 0, 1).otherwise(0))
    f = c.select("chip_id", "y", "x", (F.lit(0.8) - F.col("b12") / F.col("b11")).alias("value"))
    pl = plume.detect_plumes(f, CHIP, sources=sources(spark, sf)).select("chip_id").distinct().withColumn("hit", F.lit(True))
    return c.select("chip_id").distinct().join(pl, "chip_id", "left").select("chip_id", F.coalesce("hit", F.lit(False)).alias("contaminated"))


@query(
    "ag29_edge_fractions", "csig", "lut",
    oracle="WITH " + LUT_CTES.format(src="csig") + ", " + _two_tables("csig") + """
      SELECT i.chip_id, i.pass, round(coalesce(avg(CASE WHEN truth_do >= 0.1 THEN CAST(reported <= 0.1 AS INTEGER) END), 0), 6) AS lo, round(coalesce(avg(CASE WHEN truth_do >= 0.1 THEN CAST(reported >= 0.6 AS INTEGER) END), 0), 6) AS hi
      FROM inv i JOIN chips c USING (chip_id, pass, y, x) GROUP BY ALL""",
)
def edge_fractions(spark, sf):
    df = invert_signal(chip_signals(spark, sf), v.lut(spark), "report", "signal", "reported")
    both = df.join(v.chips(spark, sf).select(*PASS, "y", "x", "truth_do"), [*PASS, "y", "x"])
    lo, hi = retrieval.edge_share(F.col("reported"), F.col("truth_do") >= 0.1, 0.1, 0.6)
    return both.groupBy(*PASS).agg(r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(
    "ag30_surface_correlation", "chips",
    oracle="""WITH m AS (SELECT chip_id, y, x FROM chips WHERE pass = 1 AND truth_do >= 0.2),
      d AS (SELECT c.chip_id, c.b4, c.b3, c.b2, CASE WHEN m.y IS NOT NULL THEN 1.0 ELSE 0.0 END AS i FROM chips c LEFT JOIN m USING (chip_id, y, x)
        WHERE c.pass = 1 AND EXISTS (SELECT 1 FROM m n WHERE n.chip_id = c.chip_id AND abs(n.y - c.y) <= 3 AND abs(n.x - c.x) <= 3))
      SELECT chip_id, round(greatest(abs(corr(i, b4)), abs(corr(i, b3)), abs(corr(i, b2))), 6) AS surface_r FROM d GROUP BY chip_id""",
)
def surface_correlation(spark, sf):
    c = v.chips(spark, sf).where("pass = 1")
    df = plume.surface_correlation(c.where("truth_do >= 0.2"), c, CHIP)
    return df.select("chip_id", r6("surface_r").alias("surface_r"))


@query(
    "ag31_chip_quality", "chips",
    oracle="""SELECT chip_id, pass, CASE WHEN sparse AND cloudy THEN 'sparse_chip,cloudy_chip' WHEN sparse THEN 'sparse_chip' WHEN cloudy THEN 'cloudy_chip' ELSE '' END AS flags, dims FROM (
      SELECT chip_id, pass, count(CASE WHEN (y * 3 + x + chip_id) % 10 < chip_id % 10 THEN b12 END) * 1.0 / count(*) < 0.7 AS sparse, avg(b2 * (1 + chip_id % 4)) > 0.25 AS cloudy,
        coalesce(avg(CASE WHEN truth_do >= 0.2 THEN b12 / b11 - 0.8 END) < 0, true) AS dims FROM chips GROUP BY ALL)""",
)
def chip_quality(spark, sf):
    k = F.col("chip_id")
    some = F.when((F.col("y") * 3 + F.col("x") + k) % 10 < k % 10, F.col("b12"))
    df = v.chips(spark, sf).groupBy(*PASS).agg(
        retrieval.chip_flags(F.count("*"), some, F.col("b2") * (1 + k % 4)).alias("f"),
        retrieval.mean_sign_ok(F.col("b12") / F.col("b11") - 0.8, F.col("truth_do") >= 0.2).alias("dims"),
    )
    return df.select(*PASS, F.array_join("f", ",").alias("flags"), "dims")


@query(
    "ag38_label_gate", "csig", "lut",
    oracle="WITH " + LUT_CTES.format(src="csig") + ", " + _two_tables("csig") + """,
      l AS (SELECT i.chip_id, i.pass, coalesce(sum(CASE WHEN truth_do >= 0.2 THEN reported - 0.05 END), 0) AS integral, count(CASE WHEN truth_do >= 0.2 THEN 1 END) AS n FROM inv i JOIN chips c USING (chip_id, pass, y, x) GROUP BY ALL)
      SELECT chip_id, pass, round(integral, 4) AS integral, CASE WHEN chip_id % 5 <> 0 AND NOT integral > 0 THEN 'excluded' ELSE 'kept' END AS gate, round((0.33 * 3.98 + 0.45) / sqrt(n * 400.0) * integral * 400.0 * 0.01604 * 3600, 3) AS rate FROM l""",
)
def label_gate(spark, sf):
    df = invert_signal(chip_signals(spark, sf), v.lut(spark), "report", "signal", "reported")
    both = df.join(v.chips(spark, sf).select(*PASS, "y", "x", "truth_do"), [*PASS, "y", "x"])
    inside = F.col("truth_do") >= 0.2
    per = both.groupBy(*PASS).agg(F.coalesce(F.sum(F.when(inside, F.col("reported") - 0.05)), F.lit(0.0)).alias("integral"), F.count_if(inside).alias("n"))
    gated = folds.label_gate(per.withColumn("positive", F.col("chip_id") % 5 != 0))
    return gated.select(*PASS, r6("integral", 4).alias("integral"), "gate", r6(folds.nominal_label_rate(F.col("n"), F.col("integral")), 3).alias("rate"))


def chip_scenes(spark, sf):
    """Scene records of the chips: the plume-free pass ten days before the other."""
    ids = v.chips(spark, sf).select("chip_id", "pass").distinct()
    k, p = F.col("chip_id"), F.col("pass")
    ts = F.timestamp_seconds(F.lit(1577836800) + (k * 3 + p * 10) * 86400 + 36000)
    return ids.select(
        k.alias("site_id"), F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("_T"), F.when((k % 7 == 3) & (p == 0), "40").otherwise("39").cast("string"), F.lit("RUN_"), k.cast("string"), F.lit("_"), p.cast("string")).alias("scene_id"),
        ts.alias("ts"), F.when(k % 11 == 10, 60.0).otherwise(5.0).alias("cloud_pct"), (k % 3 + F.when((p == 0) & (k % 6 == 5), 1).otherwise(0)).cast("bigint").alias("relative_orbit"),
        F.when(k % 2 == 0, "Sentinel-2A").otherwise("Sentinel-2B").alias("spacecraft"), (30.0 + k % 9).alias("sun_zenith"), (5.0 + p).alias("view_zenith"), p.alias("pass"), k.alias("chip_id"),
    )


def detection_inputs(spark, sf):
    sc = chip_scenes(spark, sf)
    px = v.chips(spark, sf).join(sc.select("chip_id", "pass", "scene_id"), ["chip_id", "pass"]).select("scene_id", "y", "x", *detection.BANDS)
    req = sc.where("pass = 1").select(F.col("chip_id").alias("det_id"), "site_id", "scene_id")
    s = chip_sites(spark, sf).withColumnRenamed("chip_id", "det_id")
    winds = s.select("det_id", "u10", "sigma_u10", F.lit(270.0).alias("from_deg"), (F.col("det_id") % 5 == 0).alias("fallback_used"))
    return req, sc.drop("pass", "chip_id"), px, winds, s.select("det_id", "area_m2")


# The same detection in SQL up to the mask, the single-pass rate and the deterministic flags.
_DET_FIELDS = """
 scn AS (SELECT chip_id, pass, CASE WHEN chip_id % 2 = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS spacecraft,
   1 / cos(radians(30.0 + chip_id % 9)) + 1 / cos(radians(5.0 + pass)) AS amf FROM (SELECT DISTINCT chip_id, pass FROM chips)),
 used AS (SELECT c.* FROM chips c WHERE pass = 1 OR chip_id % 11 <> 10),
 hotpx AS (SELECT chip_id, pass, y, x FROM used JOIN scn USING (chip_id, pass) WHERE coalesce((b12 * CASE WHEN chip_id % 2 = 0 THEN 85.25 ELSE 87.75 END > b11 * CASE WHEN chip_id % 2 = 0 THEN 245.59 ELSE 247.08 END
   OR b11 * CASE WHEN chip_id % 2 = 0 THEN 245.59 ELSE 247.08 END > b8a * CASE WHEN chip_id % 2 = 0 THEN 955.19 ELSE 953.93 END) AND b12 >= 0.01 AND b8a >= 0 AND b11 >= 0, false)),
 src AS (SELECT u.chip_id, u.pass, u.y, u.x, b11, b12, EXISTS (SELECT 1 FROM hotpx h WHERE h.chip_id = u.chip_id AND h.pass = u.pass AND abs(h.y - u.y) <= 1 AND abs(h.x - u.x) <= 1) AS excl FROM used u)
"""
_DET_SQL = f"""WITH RECURSIVE {_DET_FIELDS}, {retrieval_sql('src', 'ret', 'chip_id, pass', True)},
 sig AS (SELECT ret.chip_id, ret.pass, ret.y, ret.x, spacecraft, amf, CASE WHEN NOT excl THEN delta_r END AS signal, c FROM ret JOIN scn USING (chip_id, pass)), {LUT_CTES.format(src='sig')}, {_two_tables('sig')},
 fld AS (SELECT t.chip_id, t.y, t.x, CASE WHEN t.chip_id % 11 = 10 THEN t.reported ELSE t.reported - r.reported END AS d, CASE WHEN t.chip_id % 11 = 10 THEN t.masked ELSE t.masked - r.masked END AS value, t.signal
   FROM (SELECT * FROM inv WHERE pass = 1) t LEFT JOIN (SELECT * FROM inv WHERE pass = 0) r USING (chip_id, y, x)),
 {plume_sql('fld', 'pl', '2.0')},
 agg AS (SELECT f.chip_id, count(p.y) AS n, coalesce(sum(CASE WHEN p.y IS NOT NULL THEN d END), 0) * any_value(area_m2) * 0.01604 AS ime, sqrt(count(p.y) * any_value(area_m2)) AS len, any_value(u10) AS u10
   FROM fld f LEFT JOIN pl p USING (chip_id, y, x) JOIN site USING (chip_id) GROUP BY f.chip_id),
 cc AS (SELECT chip_id, max(CASE WHEN pass = 1 THEN c END) AS c_target, max(CASE WHEN pass = 0 THEN c END) AS c_ref FROM sig GROUP BY chip_id),
 hh AS (SELECT chip_id, count(CASE WHEN pass = 1 THEN 1 END) AS n_hot_target FROM hotpx GROUP BY chip_id)
 SELECT a.chip_id AS det_id, n AS n_pixels, round(ime, 4) AS ime_kg, round(CASE WHEN n > 0 THEN (0.33 * u10 + 0.45) / len * ime * 3600 END, 3) AS q_single_kg_h, round(c_target, 6) AS c_target, round(c_ref, 6) AS c_ref,
   coalesce(n_hot_target, 0) AS n_hot_target, a.chip_id % 11 <> 10 AND a.chip_id % 6 = 5 AS other_orbit, a.chip_id % 11 <> 10 AND a.chip_id % 7 = 3 AS cross_tile, n = 0 AS no_plume FROM agg a JOIN cc USING (chip_id) LEFT JOIN hh USING (chip_id)"""


@query("me05_full_detection", "chips", "lut", "site", oracle=_DET_SQL)
def full_detection(spark, sf):
    req, scenes, px, winds, sites = detection_inputs(spark, sf)
    out, _ = detection.analyze(req, scenes, px, winds, sites, v.lut(spark), detection.Settings())
    has = lambda name: F.array_contains("flags", name)
    return out.select(
        "det_id", "n_pixels", r6("ime_kg", 4).alias("ime_kg"), r6("q_single_kg_h", 3).alias("q_single_kg_h"), r6("c_target").alias("c_target"), r6("c_ref").alias("c_ref"),
        F.col("n_hot_target").cast("bigint").alias("n_hot_target"), has("different_orbit_reference").alias("other_orbit"), has("cross_tile_reference").alias("cross_tile"), has("no_plume").alias("no_plume"),
    )


@query("me05_detection_flags")
def detection_flags(spark, sf):
    req, scenes, px, winds, sites = detection_inputs(spark, sf)
    out, _ = detection.analyze(req, scenes, px, winds, sites, v.lut(spark), detection.Settings(reference_mode="composite"))
    return out.select("det_id", "reference_id", "reference_mode", "n_pixels", r6("q_kg_h", 3).alias("q_kg_h"), r6("q_sigma_kg_h", 3).alias("q_sigma_kg_h"), F.array_join("flags", ",").alias("flags"))


@query("me08_truth_scoring")
def truth_scoring(spark, sf):
    c = v.chips(spark, sf)
    pid = F.col("chip_id") * 2 + F.col("pass")
    px = c.select(pid.alias("product"), "y", "x", *detection.BANDS, F.when(F.col("pass") == 1, F.col("truth_do") / 3.567e5 * 1e9).otherwise(0.0).alias("truth"))
    prod = c.select("chip_id", "pass").distinct().select(
        pid.alias("product"), (F.col("chip_id") % 3).alias("site"), F.col("chip_id").alias("plume_no"), (F.col("pass") * 1000.0).alias("q_true"),
        F.lit(2.3).alias("amf"), F.lit("Sentinel-2A").alias("spacecraft"), F.lit(4.0).alias("u10"), F.lit(400.0).alias("area_m2"),
    )
    out = detection.score_truth(prod, px, v.lut(spark))
    return out.select("product", "method", "mode", "n_pixels", "detected", *[r6(x, 4).alias(x) for x in ("iou", "bias_ppb", "rms_ppb", "q_ours", "invalid_fraction")], "n_hot")
