"""Model inputs, candidates from a probability table, content clusters and fold evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.joins import with_single_row
from skylattice.operators import linkage, retrieval, statistics
from skylattice.operators import morphology as mo
from skylattice.operators.lookups import resolve_scene
from skylattice.session import materialize

# Fixed values.
CHANNELS = ("mbmp_delta_r", "mbsp_delta_r", "ratio_b12_b11", "b12", "b11")
SIGMA_PER_MAD = 1.4826
MIN_PX = 5
BASELINE_K = 2.0
LINK_DISTANCE = 0.4


def build_channels(target: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Five channels per pixel from the default retrieval of both passes (never the robust one)."""
    t = retrieval.single_pass(target.select(*keys, "y", "x", "b11", "b12"), keys)
    r = retrieval.single_pass(reference.select(*keys, "y", "x", "b11", "b12"), keys).select(*keys, "y", "x", F.col("delta_r").alias("_ref"))
    return t.join(r, [*keys, "y", "x"], "left").select(
        *keys, "y", "x", (F.col("delta_r") - F.col("_ref")).alias("mbmp_delta_r"), F.col("delta_r").alias("mbsp_delta_r"),
        F.try_divide("b12", "b11").alias("ratio_b12_b11"), "b12", "b11",
    )


def normalise(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """(x - median) / (1.4826 MAD) per channel; a flat channel is only centred and missing becomes 0.

    ``stats`` has one row per channel, so its pivot is a single broadcast row.
    """
    wide = stats.agg(*[F.max(F.when(F.col("channel") == c, F.col(s))).alias(f"_{c}_{s}") for c in CHANNELS for s in ("median", "mad")])
    joined = with_single_row(pixels, wide)

    def z(c: str) -> Column:
        scale = F.col(f"_{c}_mad") * SIGMA_PER_MAD
        value = (F.col(c) - F.col(f"_{c}_median")) / F.when(scale > 0, scale).otherwise(1.0)
        return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))

    return joined.select(*[c for c in pixels.columns if c not in CHANNELS], *[z(c).alias(c) for c in CHANNELS])


def candidates(prob: DataFrame, keys: Sequence[str], threshold: float = 0.5, min_px: int = MIN_PX) -> DataFrame:
    """Connected components at or above the threshold with size, mean and peak probability."""
    keys = list(keys)
    hot = prob.where(F.col("prob") >= threshold)
    labels = mo.label_components(hot, keys).join(hot, [*keys, "y", "x"])
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("n_px"), F.avg("prob").alias("mean_prob"), F.max("prob").alias("score")).where(F.col("n_px") >= min_px)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation of two arrays of equal length, from plain sums."""
    n = F.size(a)
    sa, sb = total(a), total(b)
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    return F.try_divide(dot(a, b) - sa * sb / n, F.sqrt(va * vb))


def content_clusters(tiles: DataFrame, limit: float = LINK_DISTANCE) -> DataFrame:
    """Average-linkage clusters of tiles at distance 1 - correlation <= ``limit``, per shape.

    Equal fingerprints count as one tile; a cluster is named after its smallest tile.
    """
    reps = materialize(tiles.groupBy("shape", "v").agg(F.min("tile_id").alias("rep")), "reps")
    owners = linkage.average_linkage(linkage.unit_vectors(reps.where("v IS NOT NULL"), "rep", "v"), limit).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    whole = tiles.join(reps, ["shape", "v"]).join(owners, "rep", "left")
    return whole.select("tile_id", "shape", F.coalesce("cluster", "rep").alias("cluster"))


def assign_clusters(tiles: DataFrame, clusters: DataFrame, min_members: int) -> DataFrame:
    """Each tile's best reliable cluster of its shape by correlation with the cluster's mean fingerprint."""
    rows = tiles.join(clusters.select("tile_id", "cluster"), "tile_id").select("shape", "cluster", F.posexplode("v").alias("i", "x"))
    mean = rows.groupBy("shape", "cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") >= min_members)
    centre = mean.groupBy("shape", "cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).select(
        "shape", "cluster", F.transform("m", lambda s: s["x"]).alias("u")
    )
    return linkage.best_centres(tiles.select("tile_id", "shape", F.col("v").cast("array<double>").alias("v")), centre)


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def best_overpass(tiles: DataFrame, overpasses: DataFrame, min_corr: float) -> DataFrame:
    """Date of the most correlated overpass of the tile's site, within the years its split allows."""
    pairs = tiles.join(overpasses, "site_id")
    year = F.year("date")
    allowed = F.when(F.col("split") == "test", year == 2021).otherwise(year <= 2020)
    scored = pairs.where(allowed).select("tile_id", "date", correlation("v", "o").alias("corr"))
    best = scored.groupBy("tile_id").agg(F.max_by("date", F.struct("corr", "date")).alias("date"), F.max("corr").alias("date_corr"))
    return tiles.select("tile_id").join(best, "tile_id", "left").withColumn("confident", F.coalesce(F.col("date_corr") >= min_corr, F.lit(False)))


def export_manifest(samples: DataFrame, scenes: DataFrame, references: DataFrame, valid: DataFrame, done: DataFrame) -> DataFrame:
    """Status per sample still to do: no_scene, no_reference, sparse or ok.

    Finished keys are left out, so a broken run resumes where it stopped.
    """
    todo = samples.join(done.select("key"), "key", "left_anti")
    found = resolve_scene(todo, scenes)
    withref = found.join(references.select("scene_id", "ref_id"), "scene_id", "left").join(valid.select("scene_id", "valid"), "scene_id", "left")
    status = F.when(F.col("scene_id").isNull(), "no_scene").when(F.col("ref_id").isNull(), "no_reference").when(~F.coalesce("valid", F.lit(False)), "sparse").otherwise("ok")
    return withref.select("key", "scene_id", "ref_id", status.alias("status"))


def evaluate_folds(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per fold and truth set: model F1 at the threshold, baseline F1 at k = 2 and at its best k.

    ``rows``: fold, truth, primary, score, k_max (largest k at which the baseline still sees a plume).
    """
    sets = rows.withColumn("truth_set", F.explode(F.when(F.col("primary"), F.array(F.lit("all"), F.lit("primary"))).otherwise(F.array(F.lit("all")))))
    keys = ["fold", "truth_set"]
    model = statistics.confusion(sets, keys, F.col("truth"), F.col("score") >= threshold).select(*keys, F.col("f1").alias("model_f1"), F.col("precision").alias("model_precision"), F.col("recall").alias("model_recall"))
    each = sets.withColumn("param", F.explode(F.array(*[F.lit(k) for k in statistics.K_GRID])))
    sweep = statistics.confusion(each, [*keys, "param"], F.col("truth"), F.col("k_max") >= F.col("param"))
    at = sweep.where(F.col("param") == BASELINE_K).select(*keys, F.col("f1").alias("baseline_f1"))
    best = statistics.best_param(sweep, keys).select(*keys, F.col("best_param").alias("best_k"), F.col("best_f1").alias("baseline_best_f1"))
    return model.join(at, keys).join(best, keys)
