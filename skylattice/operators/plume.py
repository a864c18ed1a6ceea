"""Plume masks: threshold, opening, components and selection, for many chips in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.quantiles import SIGMA_PER_MAD, pearson
from skylattice.operators import morphology as mo

# Fixed values.
K_SIGMA = 2.0
MIN_AREA_PX = 5
SOURCE_REACH = 3
RING_PX = 3
SURFACE_CUT = 0.5
K_SWEEP = (1.5, 1.75, 2.0, 2.25, 2.5)


def field_spread(field: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Adds ``median`` and ``sigma`` of the chip's finite pixels."""
    w = Window.partitionBy(*keys)
    df = field.withColumn("median", F.median(value).over(w))
    return df.withColumn("sigma", F.median(F.abs(F.col(value) - F.col("median"))).over(w) * SIGMA_PER_MAD)


def above_threshold(field: DataFrame, keys: Sequence[str], ks: Sequence[float], value: str = "value") -> DataFrame:
    """Pixels at or above the median plus k sigma, once per k; a flat field gives none."""
    spread = field_spread(field, keys, value).where(F.col("sigma") > 0)
    each = spread.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
    return each.where(F.col(value) >= F.col("median") + F.col("k") * F.col("sigma")).select(*keys, "k", "y", "x", value)


def select_components(labelled: DataFrame, keys: Sequence[str], sources: DataFrame | None = None, min_area: int = MIN_AREA_PX,
                      value: str = "value") -> DataFrame:
    """Keeps the components that touch the 7 x 7 window round the source, else the one with the peak.

    ``labelled`` has ``keys, k, y, x, label, value``; ``sources`` has ``keys, source_y, source_x``.
    """
    keys = list(keys)
    rows = labelled
    if sources is not None:
        rows = rows.join(sources, keys, "left")
        near = (F.abs(F.col("y") - F.col("source_y")) <= SOURCE_REACH) & (F.abs(F.col("x") - F.col("source_x")) <= SOURCE_REACH)
    else:
        near = F.lit(False)
    comp = rows.groupBy(*keys, "k", "label").agg(
        F.count("*").alias("size"), F.bool_or(F.coalesce(near, F.lit(False))).alias("near"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("peak"),
    ).where(F.col("size") >= min_area)
    w = Window.partitionBy(*keys, "k")
    chosen = comp.withColumns({"any_near": F.max("near").over(w), "top": F.max("peak").over(w)})
    keep = chosen.where(F.when(F.col("any_near"), F.col("near")).otherwise(F.col("peak") == F.col("top")))
    return labelled.join(keep.select(*keys, "k", "label"), [*keys, "k", "label"], "left_semi")


def detect_plumes(field: DataFrame, keys: Sequence[str], *, ks: Sequence[float] = (K_SIGMA,), min_area: int = MIN_AREA_PX,
                  sources: DataFrame | None = None, use_opening: bool = True, value: str = "value",
                  block: int = mo.BLOCK) -> DataFrame:
    """Mask pixels ``(keys, k, y, x, label)`` of every chip; chips without a plume have no rows."""
    keys = list(keys)
    hot = above_threshold(field, keys, ks, value)
    mask = mo.opening(hot, [*keys, "k"]) if use_opening else hot.select(*keys, "k", "y", "x")
    labels = mo.label_components(mask, [*keys, "k"], block)
    valued = labels.join(field.select(*keys, "y", "x", value), [*keys, "y", "x"])
    return select_components(valued, keys, sources, min_area, value).select(*keys, "k", "y", "x", "label")


def mask_sizes(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mask.groupBy(*keys, "k").agg(F.count("*").alias("n_pixels"))


def surface_correlation(mask: DataFrame, bands: DataFrame, keys: Sequence[str], names: Sequence[str] = ("b4", "b3", "b2"),
                        ring_px: int = RING_PX) -> DataFrame:
    """Largest absolute correlation between being in the mask and a visible band, on mask and ring.

    Degenerate cases give zero.
    """
    keys = list(keys)
    where = [*keys, "y", "x"]
    inside = mask.select(*where).distinct().withColumn("m", F.lit(1.0))
    around = mo.ring(mask.select(*where), keys, ring_px, bands).withColumn("m", F.lit(0.0))
    domain = inside.unionByName(around).join(bands.select(*where, *names), where)

    def r(b: str):
        return F.when(F.count(b) >= 3, F.coalesce(F.abs(pearson("m", b)), F.lit(0.0))).otherwise(0.0)

    return domain.groupBy(*keys).agg(F.coalesce(F.greatest(*[r(b) for b in names]), F.lit(0.0)).alias("surface_r"))


def mask_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], empty: float) -> DataFrame:
    """Intersection over union per key; ``empty`` is the score when neither mask has a pixel.

    ``a`` and ``b`` carry ``keys, y, x, m`` for all pixels of the grid.
    """
    both = a.select(*keys, "y", "x", F.col("m").alias("ma")).join(b.select(*keys, "y", "x", F.col("m").alias("mb")), [*keys, "y", "x"])
    inter, union = F.count_if(F.col("ma") & F.col("mb")), F.count_if(F.col("ma") | F.col("mb"))
    return both.groupBy(*keys).agg(F.when(union == 0, F.lit(empty)).otherwise(F.try_divide(inter, union)).alias("iou"))
