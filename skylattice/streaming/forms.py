"""Streaming forms: series, buckets, frames, matches, de-duplication, upserts and sessions.

What adds up (sums, counts, best records, stretches of time) is kept as one part per micro-batch and put together when it is
read. So no row is too late, whatever order the data lands in, and nothing is held in operator state: a
stream that starts again goes on with the parts it has written. Every form gives the batch operator's
result over all that has arrived.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import haversine_km
from skylattice.operators import matching
from skylattice.operators.scene_choice import days
from skylattice.streaming.running import Folders, batch_parts, to_table

# Fixed values.
SESSION_GAP = "30 minutes"


def daily_series(stream: DataFrame, keys: tuple[str, ...], folders: Folders = None) -> DataFrame:
    """Count-weighted daily mean of all that landed (value, count per key and day)."""

    def part(rows: DataFrame) -> DataFrame:
        sums = [F.sum(F.col("value") * F.col("count")).alias("vc"), F.sum("count").cast("bigint").alias("c"), F.sum("value").alias("s"), F.count("value").alias("n")]
        return rows.where("value IS NOT NULL AND ts IS NOT NULL").groupBy(*keys, F.to_date("ts").alias("date")).agg(*sums)

    per = batch_parts(stream, part, "daily", folders).groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in ("vc", "c", "s", "n")])
    value = F.when(F.col("c") > 0, F.try_divide("vc", "c")).otherwise(F.col("s") / F.col("n"))
    return per.select(*keys, "date", value.alias("value"), F.col("c").alias("count"))


def weekly_cells(stream: DataFrame, key: str, start: date, folders: Folders = None) -> DataFrame:
    """Weekly mean per cell in seven-day windows counted from ``start``."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit(start)) / 7).cast("bigint")

    def part(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("ts") >= F.lit(start)).groupBy(key, week.alias("week")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))

    per = batch_parts(stream, part, "weekly", folders).groupBy(key, "week").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per.select(key, "week", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("value"))


def against_background(stream: DataFrame, background: DataFrame, keys: list[str]) -> DataFrame:
    """Enhancement over a static background (stream-static join)."""
    return stream.join(background, keys).withColumn("value", F.col("value") - F.col("bg")).drop("bg")


def rolling_frames(stream: DataFrame, start: date, step_days: int, span_days: int, folders: Folders = None) -> DataFrame:
    """Means of windows longer than their step; windows that open before the range are left out."""
    if not 0 < step_days <= span_days:
        raise ValueError("the span must be at least the step")
    offset = f"{(start - date(1970, 1, 1)).days % step_days} days"
    window = F.window("ts", f"{span_days} days", f"{step_days} days", offset)
    idx = F.floor(F.datediff(F.to_date("w.start"), F.lit(start)) / step_days).cast("bigint")

    def part(rows: DataFrame) -> DataFrame:
        per = rows.groupBy(window.alias("w")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
        return per.where(F.col("w.start") >= F.lit(start).cast("timestamp")).select(idx.alias("idx"), "s", "n")

    per = batch_parts(stream, part, "frames", folders).groupBy("idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per.select("idx", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("value"), "n")


def match_known_events(stream: DataFrame, events: DataFrame, max_km: float = matching.MATCH_KM) -> DataFrame:
    """New detections beside known events: every supporting pair, by bin (stream-static join)."""
    return matching.near_pairs(stream.select("det_id", "lat", "lon", "ts"), events.select("event_id", "lat", "lon", "ts"), max_km, matching.PLAUSIBLE_DAYS).select(
        F.col("a.det_id").alias("det_id"), F.col("b.event_id").alias("event_id"), "km", "dt_days"
    )


def match_arriving_plumes(detections: DataFrame, plumes: DataFrame, max_km: float = matching.PLUME_KM, max_days: float = matching.PLUME_DAYS,
                          late: str = "1 day", how: str = "inner") -> DataFrame:
    """Detections against plumes that also arrive over time (stream-stream join on bins and a time range).

    A left outer join emits a detection without a match once the watermark has passed it.
    """
    d = matching.with_bins(detections.withWatermark("ts", late), max_km, max_days).select(
        "det_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), F.col("ts").alias("d_ts"), "_band", "_lonbin", "_slice"
    )
    p = matching.with_neighbour_bins(plumes.withWatermark("ts", late), max_km, max_days).select(
        "event_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.col("ts").alias("p_ts"),
        F.col("_band").alias("_pb"), F.col("_lonbin").alias("_pl"), F.col("_slice").alias("_ps"),
    )
    span = F.expr(f"INTERVAL {int(max_days * 86400)} SECONDS")
    km = haversine_km(F.col("d_lat"), F.col("d_lon"), F.col("p_lat"), F.col("p_lon"))
    on = (
        (F.col("_band") == F.col("_pb")) & (F.col("_lonbin") == F.col("_pl")) & (F.col("_slice") == F.col("_ps"))
        & (F.col("p_ts") >= F.col("d_ts") - span) & (F.col("p_ts") <= F.col("d_ts") + span) & (km <= max_km)
    )
    return d.join(p, on, how).select("det_id", "event_id", km.alias("km"), days(F.col("p_ts"), F.col("d_ts")).alias("dt_days"))


def _place_bin(step_km: float) -> tuple[Column, Column]:
    deg = step_km / 111.32
    return F.floor(F.col("lat") / deg).alias("by"), F.floor(F.col("lon") / deg).alias("bx")


def drop_repeats(stream: DataFrame, late: str = "1 hour", step_km: float = matching.SAME_KM) -> DataFrame:
    """First record per minute and place; repeats within the watermark are dropped."""
    binned = stream.withWatermark("ts", late).withColumn("minute", F.date_trunc("minute", "ts")).select("*", *_place_bin(step_km))
    return binned.dropDuplicatesWithinWatermark(["minute", "by", "bx"]).drop("minute", "by", "bx")


def prefer_provenance(stream: DataFrame, prefer: str = "live", step_km: float = matching.SAME_KM, folders: Folders = None) -> DataFrame:
    """Best record per minute and place: of the preferred feed if there is one, then the smallest id.

    A part is the best record of a place in one batch.
    """
    place = ["minute", "by", "bx"]
    order = F.struct((F.col("provenance") != prefer).alias("other"), "event_id")

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*place).agg(F.min_by(F.struct("event_id", "provenance"), order).alias("_r")).select(*place, "_r.*")

    def part(rows: DataFrame) -> DataFrame:
        return best(rows.select(F.date_trunc("minute", "ts").alias("minute"), *_place_bin(step_km), F.col("event_id").cast("bigint").alias("event_id"), "provenance"))

    return best(batch_parts(stream, part, "best", folders))


def replace_coarse(stream: DataFrame, keys: list[str], name: str = "series", folders: Folders = None) -> DataFrame:
    """Fine values replace coarse ones as they land: every row is appended, the best of a key is read.

    ``stream``: keys, value, count, resolution (0 coarse, 1 fine). The series has one row per key, by
    resolution, then count, then value. ``folders``: checkpoint and output folder, to go on after a restart.
    """
    rows = to_table(stream.select(*keys, "value", "count", "resolution"), name, "append", folders).drop("batch")
    order, rest = F.struct("resolution", "count", "value"), F.struct("value", "count", "resolution")
    return rows.groupBy(*keys).agg(F.max_by(rest, order).alias("_r")).select(*keys, "_r.*")


def overpass_sessions(stream: DataFrame, gap: str = SESSION_GAP, folders: Folders = None) -> DataFrame:
    """Adjacent tiles of one pass as one acquisition, per orbit and spacecraft: every session of all that landed.

    A part is a stretch of one batch; stretches that meet are one session, whichever batch they came in.
    """
    per = ["relative_orbit", "spacecraft"]

    def part(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(F.session_window("ts", gap).alias("w"), *per).agg(F.count("*").alias("n"))
        return found.select(*per, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

    in_order = Window.partitionBy(*per).orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= F.col("_reached"), 0).otherwise(1)
    stretches = batch_parts(stream, part, "sessions", folders).withColumn("_reached", reached).withColumn("_session", F.sum(fresh).over(in_order))
    whole = stretches.groupBy(*per, "_session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return whole.drop("_session")
