"""Lookups by key, box, grid position and table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Region boxes, first match wins; name, west, east, south, north.
REGION_BOXES = (
    ("Turkmenistan", 50.0, 60.0, 35.0, 45.0),
    ("Algeria", -5.0, 12.0, 25.0, 38.0),
    ("Libya", 12.0, 26.0, 24.0, 34.0),
    ("Persian Gulf", 44.0, 60.0, 24.0, 34.0),
    ("Yemen/Arabia", 40.0, 50.0, 12.0, 22.0),
    ("US Permian", -110.0, -95.0, 28.0, 38.0),
    ("Mexico", -98.0, -88.0, 16.0, 24.0),
    ("Turkmenistan-N/Kazakhstan", 50.0, 65.0, 45.0, 55.0),
    ("SE Asia offshore", 95.0, 120.0, 0.0, 15.0),
    ("Argentina", -72.0, -62.0, -42.0, -32.0),
    ("Venezuela", -70.0, -60.0, 6.0, 14.0),
)


def region_of(lat: Column, lon: Column) -> Column:
    """Name of the first region box that holds the point, else ``other(lat,lon)``."""
    chain = None
    for name, west, east, south, north in REGION_BOXES:
        hit = lon.between(west, east) & lat.between(south, north)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    rounded = [F.bround(c).cast("bigint").cast("string") for c in (lat, lon)]
    return chain.otherwise(F.concat(F.lit("other("), rounded[0], F.lit(","), rounded[1], F.lit(")")))


def physics_found_plume(result_json: Column) -> Column:
    """A stored detection that is not flagged empty and has masked pixels."""
    parsed = F.from_json(result_json, "flags array<string>, plume struct<n_pixels double>")
    empty = F.array_contains(F.coalesce(parsed["flags"], F.array().cast("array<string>")), "no_plume")
    return ~empty & (F.coalesce(parsed["plume"]["n_pixels"], F.lit(0.0)) > 0)


def physics_agreement(rows: DataFrame, physics: DataFrame) -> DataFrame:
    """agree / physics_no_plume / physics_not_run per row, by (site, scene) with NULL sites equal."""
    found = physics.groupBy("site_id", "scene_id").agg(F.bool_or(physics_found_plume(F.col("result_json"))).alias("found"))
    p = found.select(F.col("site_id").alias("_site"), F.col("scene_id").alias("_scene"), "found")
    joined = rows.join(p, F.col("site_id").eqNullSafe(F.col("_site")) & (F.col("scene_id") == F.col("_scene")), "left")
    state = F.when(F.col("found").isNull(), "physics_not_run").when(F.col("found"), "agree").otherwise("physics_no_plume")
    return joined.withColumn("agreement", state).drop("_site", "_scene", "found")


def noise_floor(rows: DataFrame, floors: DataFrame, pooled: Column) -> DataFrame:
    """Own site's floor, else the pooled one; at or below it counts as noise, no rate never does."""
    joined = rows.join(floors.select("site_name", "floor"), "site_name", "left").withColumn("_pooled", pooled)
    level = F.coalesce("floor", "_pooled")
    return joined.select(
        *rows.columns, level.alias("noise_floor"),
        F.when(F.col("floor").isNotNull(), "site").when(F.col("_pooled").isNotNull(), "global").alias("floor_source"),
        F.coalesce(F.col("q_kg_h") <= level, F.lit(False)).alias("below_floor"),
    )


def resolve_scene(candidates: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scene of a datatake time and tile, both cut out of the scene id; equi-join, first id wins."""
    keyed = scenes.select(
        "scene_id", F.substring("scene_id", 1, 15).alias("datatake"), F.regexp_extract("scene_id", r"_(T\d{2}[A-Z]{3})", 1).alias("tile")
    ).groupBy("datatake", "tile").agg(F.min("scene_id").alias("scene_id"))
    return candidates.join(keyed, ["datatake", "tile"], "left")


def regrid_nearest(mask: DataFrame, targets: DataFrame, src: dict[str, float], dst: dict[str, float]) -> DataFrame:
    """Nearest source pixel of each target pixel, held inside the source grid.

    ``mask`` is ``chip_id, y, x, value``; ``targets`` is ``chip_id, y, x`` on the target grid.
    """
    lon = F.lit(dst["x0"]) + (F.col("x") + 0.5) * dst["xscale"]
    lat = F.lit(dst["y0"]) - (F.col("y") + 0.5) * dst["yscale"]
    sx = F.rint((lon - src["x0"]) / F.lit(src["xscale"]) - 0.5).cast("bigint")
    sy = F.rint((F.lit(src["y0"]) - lat) / F.lit(src["yscale"]) - 0.5).cast("bigint")

    def held(i: Column, n: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(int(n) - 1), i)).cast("bigint")

    want = targets.withColumns({"_y": held(sy, src["height"]), "_x": held(sx, src["width"])})
    have = mask.select("chip_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "value")
    return want.join(have, ["chip_id", "_y", "_x"], "left").drop("_y", "_x")


def inspect_points(points: DataFrame, composite: DataFrame, x0: float, y0: float, step: float) -> DataFrame:
    """Composite value under each point by floor division; NULL where masked or outside."""
    at = points.withColumns({"gx": F.floor((F.col("lon") - x0) / F.lit(step)), "gy": F.floor((F.lit(y0) - F.col("lat")) / F.lit(step))})
    return at.join(composite, ["gx", "gy"], "left").drop("gx", "gy")


def newest_first(df: DataFrame, order: str, tie: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc(order), F.desc(tie)).offset(offset).limit(limit)


def top_by_group(df: DataFrame, keys: tuple[str, ...], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the group limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
