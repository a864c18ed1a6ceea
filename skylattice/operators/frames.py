"""Frame tables, frame composites, cross-fades and date axes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value.
MAX_FRAMES = 400


def _check(start: date, end: date) -> None:
    if end < start:
        raise ValueError(f"end {end} must not be before start {start}")


def interval_frames(spark: SparkSession, start: date, end: date, step_days: int = 16, span_days: int | None = None) -> DataFrame:
    """A window opens every ``step_days`` and lasts ``span_days``; ends are inclusive and clipped."""
    _check(start, end)
    span = step_days if span_days is None else span_days
    if step_days <= 0 or span <= 0:
        raise ValueError("step and span must be positive")
    n = (end - start).days // step_days + 1
    if n > MAX_FRAMES:
        raise ValueError(f"{n} frames exceed the limit of {MAX_FRAMES}")
    opened = F.date_add(F.lit(start), (F.col("id") * step_days).cast("int"))
    closed = F.least(F.date_add(opened, span - 1), F.lit(end))
    label = F.when(opened == closed, opened.cast("string")).otherwise(F.concat(opened.cast("string"), F.lit(" to "), closed.cast("string")))
    return spark.range(n).select(F.col("id").alias("idx"), opened.alias("start"), closed.alias("end"), label.alias("label"))


def calendar_frames(spark: SparkSession, start: date, end: date, unit: str = "month") -> DataFrame:
    """Calendar months or quarters that touch the range, clipped to it."""
    _check(start, end)
    months = {"month": 1, "quarter": 3}[unit]
    first_month = (start.month - 1) // months * months + 1
    n = ((end.year - start.year) * 12 + end.month - first_month) // months + 1
    if n > MAX_FRAMES:
        raise ValueError(f"{n} frames exceed the limit of {MAX_FRAMES}")
    opened = F.add_months(F.lit(date(start.year, first_month, 1)), (F.col("id") * months).cast("int"))
    closed = F.date_sub(F.add_months(opened, months), 1)
    label = F.date_format(opened, "yyyy-MM") if unit == "month" else F.concat(F.year(opened).cast("string"), F.lit("-Q"), F.quarter(opened).cast("string"))
    return spark.range(n).select(
        F.col("id").alias("idx"), F.greatest(opened, F.lit(start)).alias("start"), F.least(closed, F.lit(end)).alias("end"), label.alias("label")
    )


def interval_frame_ids(day: Column, start: date, end: date, step_days: int, span_days: int | None = None) -> Column:
    """Ids of all interval frames a day falls in (several when spans overlap), by arithmetic."""
    span = step_days if span_days is None else span_days
    off = F.datediff(day, F.lit(start))
    last = F.floor(off / step_days).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((off - span + step_days) / step_days).cast("bigint"))
    inside = (day >= F.lit(start)) & (day <= F.lit(end)) & (first <= last)
    return F.when(inside, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def frame_composites(pixels: DataFrame, frames: DataFrame, ids: Column, keys: tuple[str, ...]) -> DataFrame:
    """Mean per frame and pixel; ``ids`` lists the frames of an observation."""
    placed = pixels.withColumn("idx", F.explode(ids))
    return placed.groupBy("idx", *keys).agg(F.avg("value").alias("value"))


def frame_status(frames: DataFrame, composites: DataFrame) -> DataFrame:
    """Frames with the number of valid pixels, rendered or empty, and a dense index of the rendered."""
    n = composites.where(F.col("value").isNotNull()).groupBy("idx").agg(F.count("*").alias("n_pixels"))
    tagged = frames.join(n, "idx", "left").withColumn("n_pixels", F.coalesce("n_pixels", F.lit(0)))
    full = F.col("n_pixels") > 0
    # At most MAX_FRAMES rows reach this window.
    seq = F.sum(full.cast("int")).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return tagged.withColumns({"status": F.when(full, "rendered").otherwise("empty"), "out_index": F.when(full, seq)})


def cross_fade(values: DataFrame, keys: tuple[str, ...], tween: int) -> DataFrame:
    """Each frame followed by ``tween`` linear blends towards the next: n + (n-1) * tween steps per pixel.

    A partition is one pixel's frames, at most ``MAX_FRAMES`` rows.
    """
    if tween < 0:
        raise ValueError("tween must not be negative")
    w = Window.partitionBy(*keys).orderBy("idx")
    ahead = values.withColumns({"next": F.lead("value").over(w), "last": F.lead("idx").over(w).isNull()})
    steps = F.when(F.col("last"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(tween)))
    out = ahead.withColumn("j", F.explode(steps))
    alpha = F.col("j") / F.lit(float(tween + 1))
    blend = F.when(F.col("j") == 0, F.col("value")).otherwise(F.col("value") * (1 - alpha) + F.col("next") * alpha)
    return out.select(*keys, (F.col("idx") * (tween + 1) + F.col("j")).alias("step"), blend.alias("value"))


def date_axis(start: Column, end: Column, steps: int) -> Column:
    """``steps`` days spread evenly over the inclusive range; one day when the range is empty."""
    n = max(2, steps)
    span = F.datediff(end, start)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_add(start, F.floor(span * i / F.lit(float(n - 1))).cast("int")))
    return F.when(span > 0, at).otherwise(F.array(start))


def pool(frames: DataFrame, radius: int) -> DataFrame:
    """The frame indices to hold ready around each frame."""
    w = Window.orderBy("idx").rowsBetween(-radius, radius)
    return frames.select("idx", F.collect_list("idx").over(w).alias("pool"))
