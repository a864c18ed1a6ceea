"""Distance and time matches through bins, so no match is a nested loop.

Points fall into latitude bands; each band has its own longitude step, wide enough for the
search radius at that latitude, and time falls into slices as long as the time limit. The
searching side reads the neighbouring bins, the searched side sits in exactly one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import haversine_km
from skylattice.operators.block_pairs import Span, count_pairs
from skylattice.operators.components import connected_components
from skylattice.operators.scene_choice import days
from skylattice.session import materialize

KM_PER_DEG_MIN = 110.5

# Fixed values.
CONFIRMED_DAYS = 14
PLAUSIBLE_DAYS = 60
MATCH_KM = 15.0
PLUME_KM = 5.0
PLUME_DAYS = 3.0
SAME_SECONDS = 60
SAME_KM = 1.0


def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step)


def _lon_bins(band: Column, step: float) -> Column:
    """Longitude bins of a band, counted so that one bin spans the radius anywhere near it.

    The longitude difference grows like an arcsine towards the poles, at most pi/2 times its
    linear estimate; a band that reaches a pole has a single bin.
    """
    south = band * step - 90.0
    reach = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + step)) + step)
    return F.greatest(F.lit(1), F.floor(F.lit(360.0 / (1.6 * step)) * F.cos(F.radians(reach))))


def _lon_bin(lon: Column, n: Column) -> Column:
    return F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n))


def _slice(ts: Column, max_days: float) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(max_days * 8.64e10))


def with_bins(points: DataFrame, km: float, max_days: float | None) -> DataFrame:
    """Searched side: one bin per point."""
    step = km / KM_PER_DEG_MIN * 1.01
    band = _band(F.col("lat"), step)
    t = F.lit(0).cast("bigint") if max_days is None else _slice(F.col("ts"), max_days)
    return points.withColumns({"_band": band, "_lonbin": _lon_bin(F.col("lon"), _lon_bins(band, step)), "_slice": t})


def with_neighbour_bins(points: DataFrame, km: float, max_days: float | None) -> DataFrame:
    """Searching side: one row per bin that may hold a match."""
    step = km / KM_PER_DEG_MIN * 1.01
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    out = points.withColumn("_band", F.explode(F.transform(around, lambda d: _band(F.col("lat"), step) + d)))
    n = _lon_bins(F.col("_band"), step)
    near = F.array_distinct(F.transform(around, lambda d: F.pmod(_lon_bin(F.col("lon"), n) + d, n)))
    out = out.withColumn("_lonbin", F.explode(near))
    if max_days is None:
        return out.withColumn("_slice", F.lit(0).cast("bigint"))
    return out.withColumn("_slice", F.explode(F.transform(around, lambda d: _slice(F.col("ts"), max_days) + d)))


def near_pairs(left: DataFrame, right: DataFrame, km: float, max_days: float | None) -> DataFrame:
    """Rows of ``left`` and ``right`` (structs ``a``, ``b``) within the limits, with distance and signed days."""
    a = with_neighbour_bins(left, km, max_days).select("_band", "_lonbin", "_slice", F.struct(*left.columns).alias("a"))
    b = with_bins(right, km, max_days).select("_band", "_lonbin", "_slice", F.struct(*right.columns).alias("b"))
    pairs = a.join(b, ["_band", "_lonbin", "_slice"]).select(
        "a", "b", haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("km")
    )
    pairs = pairs.where(F.col("km") <= km)
    if max_days is None:
        return pairs
    return pairs.withColumn("dt_days", days(F.col("b.ts"), F.col("a.ts"))).where(F.abs("dt_days") <= max_days)


def match_events(detections: DataFrame, events: DataFrame, max_km: float = MATCH_KM) -> DataFrame:
    """Verdict per detection: confirmed, plausible or unvalidated, with the supporting event ids."""
    pairs = near_pairs(detections.select("det_id", "lat", "lon", "ts"), events.select("event_id", "lat", "lon", "ts"), max_km, PLAUSIBLE_DAYS)
    hits = pairs.groupBy(F.col("a.det_id").alias("det_id")).agg(
        F.sort_array(F.collect_set("b.event_id")).alias("event_ids"), F.bool_or(F.abs("dt_days") <= CONFIRMED_DAYS).alias("sure")
    )
    verdict = F.when(F.col("sure"), "confirmed").when(F.col("sure").isNotNull(), "plausible").otherwise("unvalidated")
    return detections.join(hits, "det_id", "left").select(
        "det_id", verdict.alias("verdict"), F.coalesce("event_ids", F.array().cast("array<bigint>")).alias("event_ids")
    )


def match_plumes(detections: DataFrame, plumes: DataFrame, max_km: float = PLUME_KM, max_days: float = PLUME_DAYS) -> DataFrame:
    """Coincident plumes per detection, nearest first, then by the smaller time difference."""
    pairs = near_pairs(detections.select("det_id", "lat", "lon", "ts"), plumes.select("event_id", "lat", "lon", "ts"), max_km, max_days)
    w = Window.partitionBy("a.det_id").orderBy("km", F.abs("dt_days"), "b.event_id")
    return pairs.select(
        F.col("a.det_id").alias("det_id"), F.col("b.event_id").alias("event_id"), "km", "dt_days", F.row_number().over(w).alias("rank")
    )


def match_counts(detections: DataFrame, matches: DataFrame, checked: Column) -> DataFrame:
    """Number of matches: NULL where never checked, 0 where checked and none."""
    n = matches.groupBy("det_id").agg(F.count("*").alias("n"))
    return detections.join(n, "det_id", "left").select("det_id", F.when(checked, F.coalesce("n", F.lit(0))).alias("n_matches"))


def dedup_plumes(plumes: DataFrame, prefer: str = "live", max_km: float = SAME_KM, max_seconds: int = SAME_SECONDS) -> DataFrame:
    """One record per physical plume: same instant within a minute and a kilometre.

    Records at the very same place and instant are folded first, so a group of copies of any
    size contributes one point. Points linked by the limits form a group; the preferred
    provenance wins, then the earlier record. A chain A-B-C whose ends are further apart than
    the limits counts as one plume (a pairwise greedy pass would depend on input order).
    """
    w = F.struct(
        (F.col("provenance") == prefer).cast("int").alias("pref"), (-F.unix_micros("ts")).alias("t"), (-F.col("event_id")).alias("i")
    )
    points = plumes.groupBy("lat", "lon", "ts").agg(
        F.min("event_id").alias("point"), F.max(F.struct(w.alias("w"), F.struct(*plumes.columns).alias("r"))).alias("best")
    )
    slim = points.select("point", "lat", "lon", "ts")
    pairs = near_pairs(slim, slim, max_km, max_seconds / 86400.0).where(F.col("a.point") < F.col("b.point"))
    edges = pairs.select(F.col("a.point").alias("src"), F.col("b.point").alias("dst"))
    groups = connected_components(edges)
    labelled = points.join(groups.withColumnRenamed("node", "point"), "point", "left")
    return labelled.groupBy(F.coalesce("component", "point").alias("group")).agg(F.max("best").alias("best")).select("best.r.*")


def link_sites(sites: DataFrame, max_km: float = 5.0, km_per_deg: float = 111.32) -> DataFrame:
    """Single-linkage clusters of site centroids at ``max_km`` (equirectangular distance).

    Cutting a single-linkage tree at t gives the connected components of the graph of pairs
    within t. Returns (site_id, cluster) with the smallest member as the cluster's name.
    """
    mean_lat = sites.agg(F.avg("lat")).scalar()
    xy = sites.select("site_id", (F.col("lon") * F.cos(F.radians(mean_lat)) * km_per_deg).alias("px"), (F.col("lat") * km_per_deg).alias("py"))
    cell = max_km / math.sqrt(2)
    binned = xy.withColumns({"cx": F.floor(F.col("px") / cell), "cy": F.floor(F.col("py") / cell)})
    # All sites of one cell are within reach of each other: link each to the cell's first site only.
    hub = materialize(binned.groupBy("cx", "cy").agg(F.min("site_id").alias("hub")), "hubs")
    inside = binned.join(hub, ["cx", "cy"]).where(F.col("site_id") != F.col("hub")).select(F.col("hub").alias("src"), F.col("site_id").alias("dst"))
    # So one pair within reach is enough to join two cells.
    root = F.struct("cx", "cy").alias("root")
    spots = binned.groupBy("px", "py", "cx", "cy").agg(F.lit(1).alias("n")).select(root, "n", "px", "py")
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    cells = hub.select("cx", "cy", root)
    ahead = cells.select(F.col("root").alias("root_a"), F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i, j in steps])).alias("root_b"))
    neighbours = ahead.join(cells.select(F.col("root").alias("root_b")), "root_b")

    def reach(p: dict[str, Span], q: dict[str, Span]) -> tuple[Column, Column]:
        far, near = F.lit(0.0), F.lit(0.0)
        for axis in ("px", "py"):
            (p_lo, p_hi), (q_lo, q_hi) = p[axis], q[axis]
            most, least = F.greatest(p_hi - q_lo, q_hi - p_lo), F.greatest(p_lo - q_hi, q_lo - p_hi, F.lit(0.0))
            far, near = far + most * most, near + least * least
        return F.sqrt(far) <= max_km, F.sqrt(near) > max_km

    places = [F.col("px") / cell - F.col("root.cx"), F.col("py") / cell - F.col("root.cy")]
    linked = count_pairs(spots, neighbours, places, ("px", "py"), reach, once=True)
    for s, end in (("a", "src"), ("b", "dst")):
        linked = linked.join(hub.select(F.struct("cx", "cy").alias(f"root_{s}"), F.col("hub").alias(end)), f"root_{s}")
    edges = inside.unionByName(linked.select("src", "dst"))
    comp = connected_components(edges)
    return sites.join(comp.withColumnRenamed("node", "site_id"), "site_id", "left").select("site_id", F.coalesce("component", "site_id").alias("cluster"))


def overlap_pairs(chips: DataFrame, cell_deg: float, max_overlap: float = 0.10) -> DataFrame:
    """Number of chip pairs of different folds that overlap by more than ``max_overlap`` of the smaller box.

    Chips with the same box and fold are one item with a multiplicity. A box belongs to the cell of its south-west
    corner and meets the boxes of the nine cells around; dense cells are counted by blocks, not pair by pair.
    ``cell_deg`` must be at least the largest box side. Boxes with a NULL limit are in no pair.
    """
    width, height = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    boxes = chips.groupBy("west", "south", "east", "north", "fold").agg(F.count("*").alias("n")).withColumn("area", width * height)
    root = F.struct("fold", F.floor(F.col("west") / cell_deg).alias("cx"), F.floor(F.col("south") / cell_deg).alias("cy"))
    limits = ("west", "south", "east", "north", "area")
    items = boxes.where("area IS NOT NULL").select(root.alias("root"), "n", *limits)
    cells = materialize(items.select("root").distinct(), "cells")
    around = [F.struct((F.col("root.cx") + i).alias("cx"), (F.col("root.cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    ahead = cells.select(F.col("root").alias("root_a"), F.explode(F.array(*around)).alias("at"))
    near = ahead.join(cells.select(F.col("root").alias("root_b"), F.struct("root.cx", "root.cy").alias("at")), "at")

    def overlap(p: dict[str, Span], q: dict[str, Span]) -> tuple[Column, Column]:
        def common(low: str, high: str, pick: int) -> Column:
            other = 1 - pick
            return F.least(p[high][pick], q[high][pick]) - F.greatest(p[low][other], q[low][other])

        least_w, most_w = [common("west", "east", pick) for pick in (0, 1)]
        least_h, most_h = [common("south", "north", pick) for pick in (0, 1)]
        smaller = [F.least(p["area"][pick], q["area"][pick]) for pick in (0, 1)]
        sure = (least_w > 0) & (least_h > 0) & (F.try_divide(least_w * least_h, smaller[1]) > max_overlap)
        never = (most_w <= 0) | (most_h <= 0) | ((smaller[0] > 0) & ~(F.try_divide(most_w * most_h, smaller[0]) > max_overlap))
        return F.coalesce(sure, F.lit(False)), F.coalesce(never, F.lit(False))

    places = [F.col("west") / cell_deg - F.col("root.cx"), F.col("south") / cell_deg - F.col("root.cy"), width / cell_deg, height / cell_deg]
    pairs = count_pairs(items, near.where("root_a.fold < root_b.fold").select("root_a", "root_b"), places, limits, overlap)
    return pairs.groupBy(F.col("root_a.fold").alias("fold_a"), F.col("root_b.fold").alias("fold_b")).agg(F.sum("n").alias("n_pairs"))
