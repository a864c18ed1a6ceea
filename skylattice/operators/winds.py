"""Wind at a moment: bracketing hours, fallback collection, spread and lattices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import Region, cell_index, wind_lattice

# Fixed values.
WIND_SIGMA_FLOOR = 1.5
UEFF_SLOPE = 0.33
UEFF_OFFSET = 0.45


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def blows_to_deg(u: Column, v: Column) -> Column:
    """Azimuth the wind blows towards, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def blows_from_deg(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(u, v)) + 180.0, F.lit(360.0))


def effective_wind(u10: Column) -> Column:
    return u10 * UEFF_SLOPE + UEFF_OFFSET


def _hour_weight(ts: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(F.date_trunc("hour", ts))) / F.lit(3.6e9)


def bracket_hours(requests: DataFrame, wind: DataFrame, offsets: tuple[int, ...], collections: tuple[str, ...]) -> DataFrame:
    """Requests with the u and v of each hour offset and collection as columns ``u_land_0`` ...

    One equi-join on (cell, hour) and one aggregation on the request, whatever the number
    of hours wanted.
    """
    at = F.date_trunc("hour", F.col("ts"))
    hours = requests.select(
        "req_id", "cell", F.col("ts").alias("when"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("off")
    )
    hours = hours.withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", "when")) + F.col("off") * 3600))
    joined = hours.join(wind.where(F.col("collection_id").isin(*collections)), ["cell", "ts"])
    cols = []
    for c in collections:
        for o in offsets:
            hit = (F.col("collection_id") == c) & (F.col("off") == o)
            tag = f"{c}_{o}".replace("-", "m")
            cols += [F.max(F.when(hit, F.col("u"))).alias(f"u_{tag}"), F.max(F.when(hit, F.col("v"))).alias(f"v_{tag}")]
    wide = joined.groupBy("req_id").agg(*cols)
    return requests.withColumn("hour", at).withColumn("w", _hour_weight(F.col("ts"))).join(wide, "req_id", "left")


def _blend(comp: str, collection: str, offset: int) -> Column:
    """Linear blend of two hours; with one missing the other stands alone."""
    def col(o: int) -> Column:
        return F.col(f"{comp}_{collection}_{o}".replace("-", "m"))

    a, b, w = col(offset), col(offset + 1), F.col("w")
    return F.coalesce(a * (1 - w) + b * w, a, b)


def sample_at(requests: DataFrame, wind: DataFrame, collection: str = "land", fallback: str | None = None) -> DataFrame:
    """Blended wind per request, from the fallback collection where the first has none."""
    names = (collection,) if fallback is None else (collection, fallback)
    wide = bracket_hours(requests, wind, (0, 1), names)
    u, v = _blend("u", collection, 0), _blend("v", collection, 0)
    have = u.isNotNull() & v.isNotNull()
    used = F.when(have, collection)
    if fallback is not None:
        fu, fv = _blend("u", fallback, 0), _blend("v", fallback, 0)
        used = used.when(fu.isNotNull() & fv.isNotNull(), fallback)
        u, v = F.when(have, u).otherwise(fu), F.when(have, v).otherwise(fv)
    out = wide.select("req_id", "cell", "ts", u.alias("u"), v.alias("v"), used.alias("collection_id"))
    return out.withColumns({
        "speed": speed(F.col("u"), F.col("v")), "to_deg": blows_to_deg(F.col("u"), F.col("v")), "from_deg": blows_from_deg(F.col("u"), F.col("v")),
    })


def overpass_wind(requests: DataFrame, wind: DataFrame, collection: str = "land", fallback: str = "global") -> DataFrame:
    """Central wind with sigma from the hour before, at and after, floored in quadrature.

    Each of the three moments falls back on its own.
    """
    wide = bracket_hours(requests, wind, (-1, 0, 1, 2), (collection, fallback))
    parts = {}
    for o in (-1, 0, 1):
        u, v = _blend("u", collection, o), _blend("v", collection, o)
        have = u.isNotNull() & v.isNotNull()
        parts[o] = (
            F.when(have, u).otherwise(_blend("u", fallback, o)), F.when(have, v).otherwise(_blend("v", fallback, o)), have
        )
    speeds = F.filter(F.array(*[speed(u, v) for u, v, _ in parts.values()]), lambda s: s.isNotNull())
    zero = F.lit(0.0)
    mean = F.aggregate(speeds, zero, lambda a, s: a + s) / F.size(speeds)
    var = F.aggregate(speeds, zero, lambda a, s: a + (s - mean) * (s - mean)) / F.size(speeds)
    u, v, have = parts[0]
    return wide.where(F.size(speeds) > 0).select(
        "req_id", u.alias("u"), v.alias("v"), speed(u, v).alias("speed"), blows_from_deg(u, v).alias("from_deg"),
        F.when(have, collection).when(u.isNotNull(), fallback).alias("collection_id"),
        (~have & u.isNotNull()).alias("fallback_used"),
        F.sqrt(var + WIND_SIGMA_FLOOR**2).alias("sigma_u10"),
    )


def window_mean(points: DataFrame, wind: DataFrame, centre: str, half_hours: int = 3) -> DataFrame:
    """Mean wind over the hours round ``centre`` at sample points keyed by ``cell``."""
    mid = F.lit(centre).cast("timestamp")
    lo, hi = mid - F.expr(f"INTERVAL {half_hours} HOURS"), mid + F.expr(f"INTERVAL {half_hours} HOURS")
    mean = wind.where((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy("cell").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    out = points.join(mean, "cell", "left")
    return out.withColumns({
        "speed": speed(F.col("u"), F.col("v")), "to_deg": blows_to_deg(F.col("u"), F.col("v")), "from_deg": blows_from_deg(F.col("u"), F.col("v")),
    })


def wind_fields(moments: DataFrame, grid: DataFrame, box: Region, nx: int, ny: int, collection: str = "land",
                fallback: str | None = "global") -> DataFrame:
    """Dense wind lattices, one per moment: both hours blended per grid point, then the cell mean.

    ``grid`` is ``collection_id, ts, lon, lat, u, v``; a point missing in either hour is
    missing. A field with no value at all is taken from ``fallback``. Absent cells are NULL.
    """
    names = [collection] if fallback is None else [collection, fallback]
    at = F.date_trunc("hour", F.col("when"))
    hours = moments.select("when", F.explode(F.array(F.lit(0), F.lit(1))).alias("off")).withColumn(
        "ts", F.timestamp_seconds(F.unix_seconds(at) + F.col("off") * 3600)
    )
    pts = hours.join(grid.where(F.col("collection_id").isin(*names)), "ts")
    both = pts.groupBy("collection_id", "when", "lon", "lat").agg(
        *[F.max(F.when(F.col("off") == o, F.col(c))).alias(f"{c}{o}") for c in ("u", "v") for o in (0, 1)]
    )
    w = _hour_weight(F.col("when"))
    blended = both.select(
        "collection_id", "when", cell_index(F.col("lon"), F.col("lat"), box, nx, ny).alias("idx"),
        *[(F.col(f"{c}0") * (1 - w) + F.col(f"{c}1") * w).alias(c) for c in ("u", "v")],
    ).where(F.col("idx").isNotNull() & F.col("u").isNotNull())
    cells = blended.groupBy("when", "idx").agg(
        *[F.avg(F.when(F.col("collection_id") == n, F.col(c))).alias(f"{c}_{n}") for n in names for c in ("u", "v")]
    )
    have = cells.groupBy("when").agg(F.count(f"u_{collection}").alias("n_first"))
    idx = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx * ny - 1).cast("bigint")))
    dense = moments.select("when", idx.alias("idx")).join(have, "when", "left").join(cells, ["when", "idx"], "left")
    first = F.coalesce(F.col("n_first"), F.lit(0)) > 0
    pick = {c: F.col(f"{c}_{collection}") if fallback is None else F.when(first, F.col(f"{c}_{collection}")).otherwise(F.col(f"{c}_{fallback}")) for c in ("u", "v")}
    used = F.lit(collection) if fallback is None else F.when(first, collection).otherwise(fallback)
    return dense.select("when", "idx", pick["u"].alias("u"), pick["v"].alias("v"), used.alias("collection_id"))


__all__ = ["wind_lattice"]
