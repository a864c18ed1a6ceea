"""Streams over the tables' files; each result is compared with the batch statement."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skylattice.operators.screening import hotspots
from skylattice.plans import views as v
from skylattice.plans.match_queries import km_sql, twins
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6
from skylattice.plans.series_queries import _HOT
from skylattice.session import scratch_path
from skylattice.streaming import forms, running

START = date(2024, 1, 1)


def event_stream(spark, sf):
    """The event file as a stream of weighted readings."""
    raw = running.file_stream(spark, sf, v.read(spark, sf, "events"), "events.parquet")
    return raw.select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_id") % 7).alias("count"), F.col("user_id").alias("cell"), "event_id"
    )


def as_stream(spark, df, name):
    """A derived table written once and read back as a stream."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return running.file_stream(spark, path, df)


@query("st01_incremental_daily_series", "daily", oracle="SELECT series_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value, count FROM daily")
def incremental_daily_series(spark, sf):
    out = forms.daily_series(event_stream(spark, sf), ("series_id",))
    return out.select("series_id", F.col("date").cast("string").alias("date"), r6("value").alias("value"), "count")


@query(
    "st02_weekly_screening", "obs",
    oracle=f"""WITH bg AS (SELECT cell, avg(value) AS bg FROM obs WHERE weight = 0 GROUP BY cell),
      wk AS (SELECT cell AS idx, week, avg(value) AS value FROM (SELECT o.cell, date_diff('day', DATE '2024-01-01', date) // 7 AS week, value - bg AS value FROM obs o JOIN bg USING (cell)) GROUP BY ALL), {_HOT.format(t='wk')}""",
)
def weekly_screening(spark, sf):
    bg = v.obs(spark, sf).where("weight = 0").groupBy("cell").agg(F.avg("value").alias("bg"))
    enh = forms.against_background(event_stream(spark, sf), bg, ["cell"])
    h = hotspots(forms.weekly_cells(enh, "cell", START).withColumnRenamed("cell", "idx"))
    return h.select("idx", *[r6(c).alias(c) for c in ("mean_enh", "max_enh", "score")], "weeks_flagged", "weeks_observed")


@query(
    "st03_rolling_frames", "obs",
    oracle="""SELECT i AS idx, round(avg(value), 6) AS value, count(value) AS n FROM (SELECT unnest(range(8)) AS i) JOIN obs ON date_diff('day', DATE '2024-01-01', date) >= i * 4 AND date_diff('day', DATE '2024-01-01', date) < i * 4 + 10 GROUP BY i""",
)
def rolling_frames(spark, sf):
    return forms.rolling_frames(event_stream(spark, sf), START, 4, 10).select("idx", r6("value").alias("value"), "n")


@query(
    "st04_known_event_match", "dets", "refs",
    oracle=f"SELECT d.det_id, r.event_id, round({km_sql('d', 'r')}, 5) AS km FROM dets d JOIN refs r ON abs(d.lat - r.lat) < 0.2 WHERE {km_sql('d', 'r')} <= 15 AND abs(epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 <= 60",
)
def known_event_match(spark, sf):
    s = as_stream(spark, v.dets(spark, sf), "detections")
    out = running.to_table(forms.match_known_events(s, v.refs(spark, sf)), "matches", "append")
    return out.select("det_id", "event_id", r6("km", 5).alias("km"))


@query(
    "st05_arriving_plumes", "dets", "refs",
    oracle=f"SELECT d.det_id, r.event_id, round({km_sql('d', 'r')}, 5) AS km FROM dets d JOIN refs r ON abs(d.lat - r.lat) < 0.2 WHERE {km_sql('d', 'r')} <= 12 AND abs(epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 <= 9",
)
def arriving_plumes(spark, sf):
    d = as_stream(spark, v.dets(spark, sf).select("det_id", "lat", "lon", "ts"), "detections")
    p = as_stream(spark, v.refs(spark, sf).select("event_id", "lat", "lon", "ts"), "plumes")
    out = running.to_table(forms.match_arriving_plumes(d, p, 12.0, 9.0), "pairs", "append")
    return out.select("det_id", "event_id", r6("km", 5).alias("km"))


_BIN = "date_trunc('minute', ts) AS m, floor(lat / (1.0 / 111.32)) AS a, floor(lon / (1.0 / 111.32)) AS b"


@query("st06_repeat_removal", "twins", oracle=f"SELECT CAST(m AS VARCHAR) AS minute, count(*) AS places FROM (SELECT DISTINCT {_BIN} FROM twins) GROUP BY m")
def repeat_removal(spark, sf):
    s = as_stream(spark, twins(spark, sf), "twins")
    out = running.to_table(forms.drop_repeats(s), "unique", "append")
    return out.groupBy(F.date_trunc("minute", "ts").cast("string").alias("minute")).agg(F.count("*").alias("places"))


@query(
    "st06_provenance_preference", "twins",
    oracle=f"SELECT CAST(m AS VARCHAR) AS minute, arg_min(event_id, {{'p': provenance <> 'live', 'e': event_id}}) AS event_id, min(CASE WHEN provenance = 'live' THEN 'live' ELSE 'mirror' END) AS provenance FROM (SELECT *, {_BIN} FROM twins) GROUP BY m, a, b",
)
def provenance_preference(spark, sf):
    s = as_stream(spark, twins(spark, sf), "twins")
    return forms.prefer_provenance(s).select(F.col("minute").cast("string").alias("minute"), "event_id", "provenance")


@query(
    "st07_fine_replaces_coarse", "obs",
    oracle="""
    WITH a AS (SELECT series_id, date, avg(value) AS value, count(*) AS count, 0 AS resolution FROM obs GROUP BY ALL UNION ALL SELECT series_id, date, avg(value), count(*), 1 FROM obs WHERE weight > 2 AND day(date) % 2 = 0 GROUP BY ALL)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(arg_max(value, resolution), 6) AS value, arg_max(count, resolution) AS count, max(resolution) AS resolution FROM a GROUP BY series_id, date""",
)
def fine_replaces_coarse(spark, sf):
    o = v.obs(spark, sf)

    def series(df, resolution):
        return df.groupBy("series_id", "date").agg(F.avg("value").alias("value"), F.count("*").alias("count")).withColumn("resolution", F.lit(resolution))

    both = series(o, 0).unionByName(series(o.where("weight > 2 AND day(date) % 2 = 0"), 1))
    out = forms.replace_coarse(as_stream(spark, both, "series"), ["series_id", "date"])
    return out.select("series_id", F.col("date").cast("string").alias("date"), r6("value").alias("value"), "count", "resolution")


_SESSIONS = """
    WITH g AS (SELECT relative_orbit, spacecraft, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM scenes WINDOW w AS (PARTITION BY relative_orbit, spacecraft ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY relative_orbit, spacecraft ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT relative_orbit, spacecraft, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY relative_orbit, spacecraft, sid"""


@query("st08_overpass_sessions", "scenes", oracle=_SESSIONS)
def overpass_sessions(spark, sf):
    s = as_stream(spark, v.scenes(spark, sf).select("relative_orbit", "spacecraft", "ts"), "scenes")
    return forms.overpass_sessions(s).select("relative_orbit", "spacecraft", F.col("start").cast("string").alias("start"), "n")


@query("st08_all_overpass_sessions", "scenes", oracle=_SESSIONS)
def all_overpass_sessions(spark, sf):
    """The same sessions from scenes that land in several batches."""
    path = scratch_path(spark, "scenes")
    rows = v.scenes(spark, sf).select("relative_orbit", "spacecraft", "ts")
    rows.repartition(4, "relative_orbit", "ts").write.parquet(path)
    return forms.overpass_sessions(running.file_stream(spark, path, rows, files_per_batch=1)).select("relative_orbit", "spacecraft", F.col("start").cast("string").alias("start"), "n")
