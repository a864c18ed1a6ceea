"""Reference scenes for each target: the nearest in time under a geometry penalty.

Joining every target with every scene of its site would emit all pairs of a busy site.
Instead targets and candidates are brought together once, in time order. A candidate's
score is its distance in days plus a penalty for another orbit or another spacecraft, so
the best ``k`` are always among the ``k`` nearest on either side within the four groupings
"any", "same orbit", "same spacecraft" and "both the same".

Time is cut into slices as long as the search range and candidates are copied to the
neighbouring slices. A scene is shuffled four times at most, whatever ``k`` is; a task holds
the rows of some thousand slices, or three slices of one site where these are more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from skylattice.functions.batches import changes, codes, whole_groups

# Fixed values.
MAX_CLOUD = 30.0
MAX_DAYS = 120
MIN_DAYS = 1.0
OTHER_ORBIT_DAYS = 30.0
OTHER_SPACECRAFT_DAYS = 5.0
COMPOSITE_SIZE = 5
COMPOSITE_MIN = 3
AMF_SPREAD_MAX = 0.25
SESSION_GAP_MINUTES = 30

_META = ("scene_id", "ts", "relative_orbit", "spacecraft")
_ANY, _ORBIT, _CRAFT, _BOTH = range(4)
_HELD_ROWS = 60_000  # rows that are searched at once, more where one slice has more


def days(later: Column, earlier: Column) -> Column:
    """Signed difference in days with sub-day precision."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10)


def _choose(table: pa.Table, k: int, keep: int, kinds: tuple[int, ...], max_days: float, min_days: float) -> tuple[np.ndarray, ...]:
    """(target row, candidate row, days, score, rank) of whole slices that are sorted by time and scene."""
    fresh = changes(table, ("site_id", "slot", "at", "scene_id", "role", "relative_orbit", "spacecraft"))
    is_cand = table["role"].to_numpy() == 1
    cand, want = np.flatnonzero(fresh & is_cand), np.flatnonzero(fresh & ~is_cand)
    at = table["at"].to_numpy()
    name = codes(table, "scene_id")
    group = np.cumsum(changes(table, ("site_id", "slot")))
    orbit, craft = codes(table, "relative_orbit"), codes(table, "spacecraft")
    no_orbit, no_craft = (table[c].combine_chunks().is_null().to_numpy(zero_copy_only=False) for c in ("relative_orbit", "spacecraft"))
    times = np.unique(at)
    span = len(times) + 1
    when = np.searchsorted(times, at)
    gap = round(min_days * 8.64e10)
    orders = []
    for kind in kinds:
        key = group
        for code in ((orbit,) if kind in (_ORBIT, _BOTH) else ()) + ((craft,) if kind in (_CRAFT, _BOTH) else ()):
            key = np.unique(key * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
        place = key[cand] * span + when[cand]
        order = np.argsort(place, kind="stable")
        orders.append((key, place[order], cand[order]))
    found = []
    step = np.arange(k)
    for part in np.array_split(want, len(want) // 16_384 + 1):
        pairs = []
        for key, place, rows in orders:
            base = key[part] * span
            first, end = np.searchsorted(place, base), np.searchsorted(place, base + span)
            before = np.searchsorted(place, base + np.searchsorted(times, at[part] - gap, "right"))[:, None] - 1 - step
            after = np.searchsorted(place, base + np.searchsorted(times, at[part] + gap))[:, None] + step
            for n, ok in ((before, before >= first[:, None]), (after, after < end[:, None])):
                t, j = np.nonzero(ok)
                pairs.append(part[t] * len(at) + rows[n[t, j]])
        t, c = np.divmod(np.unique(np.concatenate(pairs)), len(at))
        dt = (at[c] - at[t]) / 8.64e10
        ok = (np.abs(dt) <= max_days) & (np.abs(dt) >= min_days) & (name[c] != name[t])
        t, c, dt = t[ok], c[ok], dt[ok]
        other_orbit = (orbit[c] != orbit[t]) & ~no_orbit[c] & ~no_orbit[t]
        other_craft = (craft[c] != craft[t]) & ~no_craft[c] & ~no_craft[t]
        score = np.abs(dt) + np.where(other_orbit, OTHER_ORBIT_DAYS, 0.0) + np.where(other_craft, OTHER_SPACECRAFT_DAYS, 0.0)
        order = np.lexsort((c, score, t))
        t, c, dt, score = t[order], c[order], dt[order], score[order]
        rank = np.arange(len(t)) - np.searchsorted(t, t) + 1
        best = rank <= keep
        found.append((t[best], c[best], dt[best], score[best], rank[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def neighbours(targets: DataFrame, candidates: DataFrame, k: int, kinds: tuple[int, ...], *, max_cloud: float = MAX_CLOUD,
               max_days: int = MAX_DAYS, min_days: float = MIN_DAYS, carry: tuple[str, ...] = (), own: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` best eligible scenes per target by score, earlier ones first among equals: (site_id, target_id, rank, c, dt_days, score).

    Only scenes of a grouping in ``kinds`` count. ``carry`` names columns of the candidates that come along in ``c``,
    ``own`` columns of the targets that come along as they are.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(8.64e10) / max_days)
    at = F.unix_micros("ts").alias("at")
    known = F.col("site_id").isNotNull() & F.col("ts").isNotNull() & F.col("scene_id").isNotNull()
    eligible = candidates.where(known & (F.col("cloud_pct") <= max_cloud))
    cand = eligible.select(
        "site_id", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"), at, F.lit(1).alias("role"), *_META, *carry
    )
    want = targets.where(known).select("site_id", slot.alias("slot"), at, F.lit(0).alias("role"), *_META, *[F.col(c).alias(f"own_{c}") for c in own])
    rows = cand.unionByName(want, allowMissingColumns=True).repartition("site_id", "slot").sortWithinPartitions("site_id", "slot", "at", "scene_id", "role")
    fields = {f.name: f.dataType for f in rows.schema}
    out = StructType([
        StructField("site_id", fields["site_id"]), StructField("target_id", fields["scene_id"]), StructField("rank", IntegerType()),
        StructField("c", StructType([StructField(m, fields[m]) for m in (*_META, *carry)])),
        StructField("dt_days", DoubleType()), StructField("score", DoubleType()), *[StructField(c, fields[f"own_{c}"]) for c in own],
    ])
    deep = k if min_days > 0 else k + 1  # a target is not among its own neighbours where there is a gap

    def best(table: pa.Table) -> pa.RecordBatch:
        t, c, dt, score, rank = _choose(table, deep, k, kinds, max_days, min_days)
        mine, theirs = pa.array(t), pa.array(c)
        column = {m: table[m].combine_chunks().take(theirs) for m in (*_META, *carry)}
        arrays = [
            table["site_id"].combine_chunks().take(mine), table["scene_id"].combine_chunks().take(mine), pa.array(rank.astype(np.int32)),
            pa.StructArray.from_arrays(list(column.values()), list(column)), pa.array(dt), pa.array(score),
            *[table[f"own_{m}"].combine_chunks().take(mine) for m in own],
        ]
        return pa.RecordBatch.from_arrays(arrays, [f.name for f in out])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("site_id", "slot"), _HELD_ROWS):
            yield best(table)

    return rows.mapInArrow(search, out)


def ranked_references(targets: DataFrame, candidates: DataFrame, k: int, **kw) -> DataFrame:
    """The ``k`` best references per target: (site_id, target_id, rank, c, dt_days, score)."""
    return neighbours(targets, candidates, k, (_ANY, _ORBIT, _CRAFT, _BOTH), **kw)


def pick_reference(targets: DataFrame, candidates: DataFrame, **kw) -> DataFrame:
    """Every target with its best reference, or NULLs when none is eligible."""
    best = neighbours(targets, candidates, 1, (_ANY, _ORBIT, _CRAFT, _BOTH), **kw)
    chosen = best.select("site_id", "target_id", F.col("c").alias("reference"), "dt_days", "score")
    keyed = targets.withColumn("target_id", F.col("scene_id"))
    return keyed.join(chosen, ["site_id", "target_id"], "left").drop("target_id")


def pick_reference_set(targets: DataFrame, candidates: DataFrame, k: int = COMPOSITE_SIZE, **kw) -> DataFrame:
    """Up to ``k`` same-orbit, same-spacecraft scenes per target, nearest first: (site_id, target_id, rank, c, dt_days)."""
    return neighbours(targets, candidates, k, (_BOTH,), **kw).drop("score")


def reference_mode(targets: DataFrame, members: DataFrame, single: DataFrame) -> DataFrame:
    """Composite where enough members exist, else the single reference and a flag."""
    n = members.groupBy("site_id", F.col("target_id").alias("scene_id")).agg(F.count("*").alias("n_members"))
    base = targets.select("site_id", "scene_id").join(n, ["site_id", "scene_id"], "left").fillna(0, ["n_members"])
    enough = F.col("n_members") >= COMPOSITE_MIN
    joined = base.join(single.select("site_id", "scene_id", F.col("reference.scene_id").alias("single_id")), ["site_id", "scene_id"], "left")
    return joined.select(
        "site_id", "scene_id", "n_members",
        F.when(enough, "composite").otherwise("single").alias("reference_mode"),
        F.when(~enough, F.col("single_id")).alias("single_id"),
        F.when(~enough, "composite_reference_unavailable").alias("flag"),
    )


def member_summary(members: DataFrame, amf: DataFrame) -> DataFrame:
    """Members with signed day offsets, their air-mass spread (flagged above the limit) and median.

    A target has at most ``k`` members, so the list and the median are of bounded size.
    """
    with_amf = members.join(amf.select(F.col("scene_id").alias("_sid"), "amf"), F.col("c.scene_id") == F.col("_sid"))
    spread = F.max("amf") - F.min("amf")
    return with_amf.groupBy("site_id", "target_id").agg(
        F.count("*").alias("n_members"),
        F.median("amf").alias("median_amf"),
        spread.alias("amf_spread"),
        (spread > AMF_SPREAD_MAX).alias("wide"),
        F.sort_array(F.collect_list(F.struct("rank", F.col("c.scene_id").alias("scene_id"), "dt_days", "amf"))).alias("members"),
    )


def first_clean(evaluated: DataFrame, max_saturated: float = 0.20) -> DataFrame:
    """First ranked reference whose difference shows a plume that is not saturated; else the single pass.

    ``evaluated``: site_id, target_id, rank, n_pixels, saturated, and per target
    ``single_n_pixels, single_saturated``.
    """
    ok = (F.col("n_pixels") > 0) & (F.col("saturated") <= max_saturated)
    single_ok = (F.first("single_n_pixels") > 0) & (F.first("single_saturated") <= max_saturated)
    best = F.min(F.when(ok, F.col("rank")))
    return evaluated.groupBy("site_id", "target_id").agg(
        best.alias("rank"),
        F.when(best.isNotNull(), "mbmp").when(single_ok, "mbsp").otherwise("excluded").alias("method"),
    )


def overpass_sessions(scenes: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Neighbouring tiles of one pass as one acquisition: sessions per orbit and spacecraft."""
    return scenes.groupBy(
        F.session_window("ts", f"{gap_minutes} minutes").alias("w"), "relative_orbit", "spacecraft"
    ).agg(F.count("*").alias("n")).select("relative_orbit", "spacecraft", F.col("w.start").alias("start"), "n")
