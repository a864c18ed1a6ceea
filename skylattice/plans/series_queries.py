"""Series, frames, screening and ordering."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN
from skylattice.catalog.registry import catalog_table, merge_catalogs
from skylattice.functions.joins import with_single_row
from skylattice.functions.ranks import numbered
from skylattice.operators import composites, frames, screening, series
from skylattice.plans import views as v
from skylattice.plans.composite_queries import ndvi
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import DATES_SQL, ROI, ROI_SQL, r6
from skylattice.sources import scans

MONTH = (date(2024, 1, 1), date(2024, 1, 30))


def day_text(name="date"):
    return F.col(name).cast("string").alias(name)


@query(
    "ag05_scene_reduction", "ndvi", "px",
    oracle="""SELECT n.scene_id, round(avg(value), 6) AS value, count(value) AS count FROM ndvi n GROUP BY n.scene_id""",
)
def scene_reduction(spark, sf):
    df = series.scene_reduction(ndvi(spark, sf))
    return df.select("scene_id", r6("value").alias("value"), "count")


v.VIEW_SQL["daily"] = (("obs",), """
SELECT series_id, CAST(ts AS DATE) AS date, CASE WHEN sum(weight) > 0 THEN sum(value * weight) / sum(weight) ELSE avg(value) END AS value, CAST(sum(weight) AS BIGINT) AS count
FROM (SELECT series_id, scene_kind, ts, value, weight FROM obs) WHERE value IS NOT NULL GROUP BY ALL""")


def daily(spark, sf):
    o = v.obs(spark, sf).select("series_id", "ts", "value", F.col("weight").alias("count"))
    return series.daily_series(o, ("series_id",))


@query("ag06_daily_series", "daily", oracle="SELECT series_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value, count FROM daily")
def daily_series(spark, sf):
    return daily(spark, sf).select("series_id", day_text(), r6("value").alias("value"), "count")


@query(
    "ag07_daily_series_end_to_end", "px", "ndvi",
    oracle=f"""
    WITH f AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS value, count(value) AS count FROM (SELECT n.ts, value, -168.0 + (tile_id % 1400 * 16 + x) * 0.01 AS lon, 50.0 - (tile_id // 1400 * 16 + y) * 0.01 AS lat FROM ndvi n)
      WHERE {DATES_SQL} AND {ROI_SQL} AND value IS NOT NULL GROUP BY 1),
    c AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS value FROM (SELECT ts, tile_id, y // 4 AS y, x // 4 AS x, avg(value) AS value FROM ndvi WHERE {DATES_SQL} GROUP BY ALL) WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(date AS VARCHAR) AS date, round(f.value, 6) AS value, coalesce(f.count, 0) AS count, round(c.value, 6) AS preview FROM c LEFT JOIN f USING (date)""",
)
def daily_end_to_end(spark, sf):
    px = v.px(spark, sf)
    p = BUILTIN["s2"].get("NDVI")
    fine = series.daily_from_pixels(scans.optical_product(px, p, ROI, "1997-01-01", "1999-01-01"))
    rough = series.coarse_preview(scans.optical_product(px, p, None, "1997-01-01", "1999-01-01"))
    preview = rough.where("value IS NOT NULL").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("preview"))
    out = preview.join(fine, "date", "left")
    return out.select(day_text(), r6("value").alias("value"), F.coalesce("count", F.lit(0)).alias("count"), r6("preview").alias("preview"))


@query(
    "ag08_zonal_mean", "px",
    oracle="""
    WITH z AS (SELECT scene_id, CAST(floor((50.005 - lat) / 0.08) AS BIGINT) * 40 + CAST(floor((lon - -168.005) / 0.1) AS BIGINT) AS idx,
      CASE WHEN v BETWEEN 1600 AND 2200 THEN v END AS value FROM (SELECT scene_id, lon, lat, CH4_column_volume_mixing_ratio_dry_air_bias_corrected AS v FROM px WHERE lon >= -168.005 AND lon < -164.005 AND lat > 49.845 AND lat <= 50.005))
    SELECT scene_id, idx, round(avg(value), 4) AS value, count(value) AS n FROM z WHERE value IS NOT NULL GROUP BY ALL""",
)
def zonal_mean(spark, sf):
    from skylattice.functions.geo import box, cell_index

    area = box(-168.005, 49.845, -164.005, 50.005)
    ch4 = BUILTIN["s5p"].get("CH4")
    df = v.px(spark, sf).select(
        "scene_id", cell_index(F.col("lon"), F.col("lat"), area, 40, 2).alias("idx"), scans.mask_valid(F.col(ch4.band), ch4).alias("value")
    ).where("idx IS NOT NULL AND value IS NOT NULL")
    z = df.groupBy("scene_id", "idx").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return z.select("scene_id", "idx", r6("value", 4).alias("value"), "n")


_WEEKLY = "weekly AS (SELECT cell AS idx, date_diff('day', DATE '2024-01-01', date) // 7 AS week, avg(value) AS value FROM obs GROUP BY ALL)"
_HOT = """
sig AS (SELECT 1.4826 * median(abs(value - m)) AS s FROM {t}, (SELECT median(value) AS m FROM {t})),
hot AS (SELECT idx, avg(value) AS mean_enh, max(value) AS max_enh, count(CASE WHEN value > 2 * s THEN 1 END) AS weeks_flagged, count(value) AS weeks_observed, avg(value) / any_value(s) AS score FROM {t}, sig WHERE s > 0 GROUP BY idx)
SELECT idx, round(mean_enh, 6) AS mean_enh, round(max_enh, 6) AS max_enh, weeks_flagged, weeks_observed, round(score, 6) AS score FROM hot ORDER BY hot.score DESC, idx LIMIT 50"""


def _hot_columns(df):
    return df.select("idx", *[r6(c).alias(c) for c in ("mean_enh", "max_enh", "score")], "weeks_flagged", "weeks_observed")


def weekly(spark, sf):
    o = v.obs(spark, sf)
    week = screening.week_of(F.col("date"), MONTH[0]).alias("week")
    return o.groupBy(F.col("cell").alias("idx"), week).agg(F.avg("value").alias("value"))


@query("ag14_hotspot_persistence", "obs", oracle=f"WITH {_WEEKLY}, {_HOT.format(t='weekly')}")
def hotspot_persistence(spark, sf):
    return _hot_columns(screening.hotspots(weekly(spark, sf)))


@query(
    "ag15_regional_screening", "obs",
    oracle=f"""WITH bg AS (SELECT cell, median(value) AS bg FROM obs WHERE date >= DATE '2024-01-05' - 30 AND date < DATE '2024-01-05' GROUP BY cell),
      w AS (SELECT cell, date_diff('day', DATE '2024-01-05', date) // 7 AS week, avg(value) AS v FROM obs WHERE date >= DATE '2024-01-05' AND date < DATE '2024-01-30' GROUP BY ALL),
      zone AS (SELECT cell // 5 AS idx, week, avg(v - bg) AS value FROM w JOIN bg USING (cell) GROUP BY ALL), {_HOT.format(t='zone')}""",
)
def regional_screening(spark, sf):
    o = v.obs(spark, sf)
    df = screening.screen_region(o, ("cell",), F.expr("cell div 5"), date(2024, 1, 5), date(2024, 1, 30))
    return _hot_columns(df)


@query(
    "ag16_series_statistics", "daily",
    oracle="""SELECT series_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
      CAST(arg_min(date, {'v': value, 'd': date}) AS VARCHAR) AS min_date, CAST(arg_max(date, {'v': value, 'd': -date_diff('day', DATE '1970-01-01', date)}) AS VARCHAR) AS max_date,
      round(coalesce(regr_slope(value, date_diff('day', DATE '1970-01-01', date)), 0) * 365.25, 4) AS trend_per_year, round(count(value) / 60.0, 6) AS coverage FROM daily GROUP BY series_id""",
)
def series_statistics(spark, sf):
    s = series.series_statistics(daily(spark, sf), ("series_id",), F.lit(60.0))
    six = ("mean", "std", "min_value", "max_value", "coverage")
    return s.select("series_id", "n", *[r6(c).alias(c) for c in six], "min_date", "max_date", r6("trend_per_year", 4).alias("trend_per_year"))


@query("ag35_distinct_years", "px", oracle="SELECT DISTINCT year(ts) AS year FROM px")
def distinct_years(spark, sf):
    return v.px(spark, sf).select(F.year("ts").cast("bigint").alias("year")).distinct().orderBy("year")


@query(
    "wn01_trailing_smooth", "daily",
    oracle="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(value) OVER w >= 4 THEN avg(value) OVER w END, 6) AS value_mean_14d,
      round(CASE WHEN count(value) OVER w >= 4 THEN median(value) OVER w END, 6) AS value_median_14d FROM daily
      WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
)
def trailing_smooth(spark, sf):
    d = daily(spark, sf)
    out = series.rolling_trailing(series.rolling_trailing(d, ("series_id",)), ("series_id",), method="median")
    return out.select("series_id", day_text(), r6("value_mean_14d").alias("value_mean_14d"), r6("value_median_14d").alias("value_median_14d"))


@query(
    "wn02_centred_smooth", "daily",
    oracle="""SELECT series_id, CAST(date AS VARCHAR) AS date, round(avg(CASE WHEN day(date) % 3 <> 0 THEN value END) OVER (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 4 DAY PRECEDING AND INTERVAL 4 DAY FOLLOWING), 6) AS smooth
      FROM daily""",
)
def centred_smooth(spark, sf):
    d = daily(spark, sf).withColumn("value", F.when(F.dayofmonth("date") % 3 != 0, F.col("value")))
    return series.rolling_centred(d, ("series_id",), window_days=9).select("series_id", day_text(), r6("smooth").alias("smooth"))


@query(
    "wn07_every_nth", "truth",
    oracle="""SELECT site, id, scored_idx FROM (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY id) - 1 AS scored_idx FROM truth WHERE q_true > 0) WHERE scored_idx % 10 = 0""",
)
def every_nth(spark, sf):
    df = numbered(v.truth(spark, sf).where("q_true > 0"), ("site",), "id", "scored_idx")
    return df.where("scored_idx % 10 = 0").select("site", "id", "scored_idx")


@query(
    "wn08_peak_pixel", "chip_sums",
    oracle="""SELECT chip_id, pass, p.y AS y, p.x AS x, (2 * p.s + p.n) // (2 * p.n) / 1e6 AS peak FROM (SELECT chip_id, pass, arg_max(chip_sums, {'v': s / n, 'ny': -y, 'nx': -x}) AS p FROM chip_sums WHERE n > 0 GROUP BY ALL)""",
)
def peak_pixel(spark, sf):
    # Whole sums: equal means are equal numbers, whichever way the rows came; half a millionth is rounded up.
    best = F.max_by(F.struct("y", "x", "s", "n"), F.struct(F.col("s") / F.col("n"), -F.col("y"), -F.col("x")))
    df = v.chip_sums(spark, sf).where("n > 0").groupBy("chip_id", "pass").agg(best.alias("p"))
    return df.select("chip_id", "pass", "p.y", "p.x", (F.expr("(2 * p.s + p.n) div (2 * p.n)") / F.lit(1e6)).alias("peak"))


_FRAME_SQL = """SELECT i AS idx, DATE '1997-01-01' + CAST(i * 30 AS INTEGER) AS start, least(DATE '1997-01-01' + CAST(i * 30 + 44 AS INTEGER), DATE '1998-06-30') AS "end" FROM (SELECT unnest(range(19)) AS i)"""


@query(
    "wn09_frame_table", "px",
    oracle=f"""
    WITH f AS (SELECT 'interval' AS mode, idx, start, "end" AS stop FROM ({_FRAME_SQL})
      UNION ALL SELECT 'month', i, greatest(m, DATE '1996-02-10'), least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, DATE '1998-11-20') FROM (SELECT i, CAST(DATE '1996-02-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS m FROM (SELECT unnest(range(34)) AS i))
      UNION ALL SELECT 'quarter', i, greatest(m, DATE '1996-02-10'), least(m + INTERVAL 3 MONTH - INTERVAL 1 DAY, DATE '1998-11-20') FROM (SELECT i, CAST(DATE '1996-01-01' + to_months(CAST(i * 3 AS INTEGER)) AS DATE) AS m FROM (SELECT unnest(range(12)) AS i)))
    SELECT f.mode, idx, CAST(CAST(start AS DATE) AS VARCHAR) AS start, CAST(CAST(stop AS DATE) AS VARCHAR) AS stop, count(ts) AS n FROM f LEFT JOIN px ON ts >= start AND ts < stop + INTERVAL 1 DAY GROUP BY ALL""",
)
def frame_table(spark, sf):
    a = frames.interval_frames(spark, date(1997, 1, 1), date(1998, 6, 30), 30, 45).withColumn("mode", F.lit("interval"))
    b = frames.calendar_frames(spark, date(1996, 2, 10), date(1998, 11, 20), "month").withColumn("mode", F.lit("month"))
    c = frames.calendar_frames(spark, date(1996, 2, 10), date(1998, 11, 20), "quarter").withColumn("mode", F.lit("quarter"))
    f = a.unionByName(b).unionByName(c)
    # The days of the data are counted once, then joined with the frames' days: no range join.
    per_day = v.px(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("k"))
    days = f.withColumn("d", F.explode(F.sequence("start", "end")))
    n = per_day.join(F.broadcast(days), "d").groupBy("mode", "idx").agg(F.sum("k").alias("n"))
    out = f.join(n, ["mode", "idx"], "left")
    return out.select("mode", "idx", day_text("start"), F.col("end").cast("string").alias("stop"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "wn10_frame_composites", "ndvi",
    oracle=f"""
    WITH f AS ({_FRAME_SQL}), c AS (SELECT idx, tile_id, y, x, avg(CASE WHEN month(ts) <> 3 THEN value END) AS value FROM f JOIN ndvi ON CAST(ts AS DATE) BETWEEN start AND "end" GROUP BY ALL),
    r AS (SELECT quantile_cont(value, 0.005) AS p, quantile_cont(value, 0.995) AS q FROM c WHERE idx = 9)
    SELECT f.idx, count(value) AS n_pixels, CASE WHEN count(value) > 0 THEN 'rendered' ELSE 'empty' END AS status, round(avg(value), 6) AS mean,
      round(any_value(greatest(p - (q - p) * 0.15, -1)), 6) AS vis_min, round(any_value(least(q + (q - p) * 0.15, 1)), 6) AS vis_max FROM f LEFT JOIN c USING (idx) CROSS JOIN r GROUP BY f.idx""",
)
def frame_composites(spark, sf):
    start, end = date(1997, 1, 1), date(1998, 6, 30)
    f = frames.interval_frames(spark, start, end, 30, 45)
    ids = frames.interval_frame_ids(F.to_date("ts"), start, end, 30, 45)
    comp = frames.frame_composites(ndvi(spark, sf).withColumn("value", F.when(F.month("ts") != 3, F.col("value"))), f, ids, ("tile_id", "y", "x"))
    rng = composites.display_range(comp.where("idx = 9"), BUILTIN["s2"].get("NDVI"))
    mean = comp.groupBy("idx").agg(F.avg("value").alias("mean"))
    out = with_single_row(frames.frame_status(f, comp).join(mean, "idx", "left"), rng)
    return out.select("idx", "n_pixels", "status", *[r6(c).alias(c) for c in ("mean", "vis_min", "vis_max")])


@query(
    "wn11_cross_fade", "obs",
    oracle="""
    WITH b AS (SELECT cell, week AS idx, avg(value) AS value FROM (SELECT cell, date_diff('day', DATE '2024-01-01', date) // 7 AS week, value FROM obs) GROUP BY ALL),
    n AS (SELECT *, lead(value) OVER (PARTITION BY cell ORDER BY idx) AS nxt FROM b),
    s AS (SELECT *, unnest(CASE WHEN nxt IS NULL THEN [0] ELSE [0, 1, 2] END) AS j FROM n)
    SELECT cell, idx * 3 + j AS step, round(CASE WHEN j = 0 THEN value ELSE value * (1 - j / 3.0) + nxt * (j / 3.0) END, 6) AS value FROM s""",
)
def cross_fade(spark, sf):
    w = weekly(spark, sf).select(F.col("idx").alias("cell"), F.col("week").alias("idx"), "value")
    return frames.cross_fade(w, ("cell",), 2).select("cell", "step", r6("value").alias("value"))


@query(
    "wn12_date_axis", "obs",
    oracle="""
    WITH r AS (SELECT cell, min(date) AS a, max(date) AS b FROM obs GROUP BY cell),
    x AS (SELECT cell, unnest(CASE WHEN b > a THEN list_transform(range(7), lambda i: a + CAST(floor(date_diff('day', a, b) * i / 6.0) AS INTEGER)) ELSE [a] END) AS d FROM r)
    SELECT cell, count(*) AS n, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS axis FROM x GROUP BY cell""",
)
def date_axis(spark, sf):
    r = v.obs(spark, sf).groupBy("cell").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    ax = r.withColumn("axis", frames.date_axis(F.col("a"), F.col("b"), 7))
    text = F.transform("axis", lambda d: d.cast("string"))
    return ax.select("cell", F.size("axis").cast("bigint").alias("n"), F.array_min("axis").cast("string").alias("first"),
                     F.array_max("axis").cast("string").alias("last"), F.array_join(F.array_sort(text), ",").alias("axis"))


@query(
    "tk01_top_scores", "obs",
    oracle="SELECT idx, round(score, 6) AS score FROM (SELECT cell AS idx, avg(value) AS score FROM obs GROUP BY cell) t ORDER BY t.score DESC, idx LIMIT 20",
)
def top_scores(spark, sf):
    df = v.obs(spark, sf).groupBy(F.col("cell").alias("idx")).agg(F.avg("value").alias("score"))
    return df.orderBy(F.desc("score"), "idx").limit(20).select("idx", r6("score").alias("score"))


@query("tk04_time_order", "scenes", oracle="SELECT site_id, scene_id, CAST(ts AS VARCHAR) AS ts FROM scenes ORDER BY ts, scene_id")
def time_order(spark, sf):
    s = v.scenes(spark, sf).orderBy("ts", "scene_id")
    return s.select("site_id", "scene_id", F.col("ts").cast("string").alias("ts"))


@query(
    "set02_catalog_merge", "px",
    oracle="""SELECT dataset_id, CASE WHEN dataset_id IN ('s2', 's1', 's5p', 'emit') THEN 'collision' ELSE 'accepted' END AS state, count(*) AS n FROM (
      SELECT CASE B3 % 6 WHEN 0 THEN 's2' WHEN 1 THEN 'emit' ELSE 'user_' || CAST(B3 % 6 AS VARCHAR) END AS dataset_id FROM px) GROUP BY ALL""",
)
def catalog_merge(spark, sf):
    m = F.col("B3") % 6
    user = v.px(spark, sf).select(F.when(m == 0, "s2").when(m == 1, "emit").otherwise(F.concat(F.lit("user_"), m.cast("string"))).alias("dataset_id"))
    builtin = catalog_table(spark).select("dataset_id")
    merged, bad = merge_catalogs(builtin, user)
    accepted = merged.join(F.broadcast(builtin.distinct()), "dataset_id", "left_anti")
    both = accepted.withColumn("state", F.lit("accepted")).unionByName(bad.withColumn("state", F.lit("collision")))
    return both.groupBy("dataset_id", "state").agg(F.count("*").alias("n"))


@query(
    "set04_membership", "scenes",
    oracle="""SELECT site_id, count(*) AS n FROM scenes WHERE spacecraft IN ('Sentinel-2A', 'Sentinel-2B') AND relative_orbit IN (1, 3) AND site_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY site_id""",
)
def membership(spark, sf):
    keep = v.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("site_id"))
    s = v.scenes(spark, sf).where(F.col("spacecraft").isin("Sentinel-2A", "Sentinel-2B") & F.col("relative_orbit").isin(1, 3))
    return s.join(keep, "site_id", "left_semi").groupBy("site_id").agg(F.count("*").alias("n"))


@query(
    "set05_exclusion_split", "truth",
    oracle="""SELECT site, state, exclusion_reason, count(*) AS n FROM (SELECT site, CASE WHEN r IS NULL THEN 'quantified' ELSE 'excluded' END AS state, r AS exclusion_reason FROM (
      SELECT site, CASE WHEN NOT detected THEN 'no_plume' WHEN invalid_fraction > 0.2 THEN 'out_of_validity' WHEN q_ours IS NULL THEN 'non_finite_rate' END AS r FROM truth)) GROUP BY ALL""",
)
def exclusion_split(spark, sf):
    from skylattice.operators import gates

    t = v.truth(spark, sf)
    reason = gates.exclusion_reason(F.col("detected").cast("int"), F.col("invalid_fraction"), F.col("q_ours"))
    ok, bad = gates.split_rejects(t, reason)
    a = ok.select("site", F.lit("quantified").alias("state"), F.lit(None).cast("string").alias("exclusion_reason"))
    b = bad.select("site", F.lit("excluded").alias("state"), F.col("reason").alias("exclusion_reason"))
    return a.unionByName(b).groupBy("site", "state", "exclusion_reason").agg(F.count("*").alias("n"))


