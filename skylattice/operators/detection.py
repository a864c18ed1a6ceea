"""Full methane detection for many (region, scene) requests in one plan.

Steps: reference choice, pixels of both passes, retrieval with flare exclusion, inversion with
the reporting and the frozen mask table, plume mask over a threshold sweep, rate and quality
flags. Pixels stay in long form keyed by the request. The per-pixel fields are written once
and read by the steps that follow, so no step repeats the retrieval.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.display import column_to_ppb
from skylattice.functions.identifiers import tile_of
from skylattice.functions.inversion import invert_signal
from skylattice.operators import emission, plume, retrieval, scene_choice
from skylattice.operators import morphology as mo
from skylattice.operators.gates import invalid_share
from skylattice.session import materialize
from skylattice.sources.scans import air_mass

# Fixed values.
CLIP_SHARE = 0.05
KEY = ["det_id"]
BANDS = ("b2", "b3", "b4", "b8a", "b11", "b12")


@dataclass(frozen=True)
class Settings:
    """Options of a detection run."""

    method: str = "mbmp"
    reference_mode: str = "single"
    k_sigma: float = plume.K_SIGMA
    min_area_px: int = plume.MIN_AREA_PX
    draws: int = emission.DRAWS
    seed: int = 0
    lut_lo: float = -0.5
    lut_hi: float = 6.0

    def __post_init__(self) -> None:
        if self.method not in ("mbmp", "mbsp"):
            raise ValueError(f"unknown method {self.method!r}")
        if self.reference_mode not in ("single", "composite"):
            raise ValueError(f"unknown reference mode {self.reference_mode!r}")


def plan_passes(requests: DataFrame, scenes: DataFrame, settings: Settings) -> DataFrame:
    """One row per request, pass and scene read: target, and the reference or its members.

    Adds per request the reference flags. ``requests`` is ``det_id, site_id, scene_id``.
    """
    meta = scenes.withColumn("amf", air_mass(F.col("sun_zenith"), F.col("view_zenith")))
    wanted = requests.join(meta, ["site_id", "scene_id"])
    slim = meta.select(F.col("scene_id").alias("_sid"), F.col("amf").alias("_amf"))
    target = wanted.select(
        "det_id", "site_id", F.lit("target").alias("role"), "scene_id", F.col("scene_id").alias("read_id"), "spacecraft", "amf", "relative_orbit",
        F.lit(None).cast("double").alias("dt_days"), F.lit(None).cast("string").alias("mode_flag"),
    )
    if settings.method == "mbsp":
        return target
    goals = wanted.select(*scenes.columns).distinct()
    single = scene_choice.pick_reference(goals, scenes).where(F.col("reference").isNotNull())
    chosen = single.select("site_id", "scene_id", F.col("reference").alias("c"), "dt_days", F.lit(None).cast("string").alias("mode_flag"))
    if settings.reference_mode == "composite":
        members = scene_choice.pick_reference_set(goals, scenes)
        counts = members.groupBy("site_id", "target_id").agg(F.count("*").alias("n"))
        enough = counts.where(F.col("n") >= scene_choice.COMPOSITE_MIN).select("site_id", F.col("target_id").alias("scene_id"))
        many = members.withColumnRenamed("target_id", "scene_id").join(enough, ["site_id", "scene_id"]).select(
            "site_id", "scene_id", "c", "dt_days", F.lit(None).cast("string").alias("mode_flag")
        )
        few = chosen.join(enough, ["site_id", "scene_id"], "left_anti").withColumn("mode_flag", F.lit("composite_reference_unavailable"))
        chosen = many.unionByName(few)
    ref = requests.join(chosen, ["site_id", "scene_id"]).join(slim, F.col("c.scene_id") == F.col("_sid"))
    reference = ref.select(
        "det_id", "site_id", F.lit("reference").alias("role"), "scene_id", F.col("c.scene_id").alias("read_id"), F.col("c.spacecraft").alias("spacecraft"),
        F.col("_amf").alias("amf"), F.col("c.relative_orbit").alias("relative_orbit"), "dt_days", "mode_flag",
    )
    return target.unionByName(reference)


def reference_flags(passes: DataFrame) -> DataFrame:
    """Per request: reference flags, members and air-mass spread."""
    ref, tgt = F.col("role") == "reference", F.col("role") == "target"
    anchor = F.min_by(F.struct("read_id", "relative_orbit"), F.when(ref, F.struct(F.abs("dt_days"), F.col("read_id"))))
    spread = F.max(F.when(ref, F.col("amf"))) - F.min(F.when(ref, F.col("amf")))
    per = passes.groupBy("det_id").agg(
        F.max(F.when(tgt, F.col("relative_orbit"))).alias("t_orbit"), F.max(F.when(tgt, F.col("read_id"))).alias("t_id"),
        anchor.alias("a"), F.count_if(ref).alias("n_members"), spread.alias("spread"), F.max("mode_flag").alias("mode_flag"),
        F.sort_array(F.collect_list(F.when(ref, F.struct("dt_days", F.col("read_id").alias("scene_id"), "amf")))).alias("members"),
    )
    has = F.col("n_members") > 0
    many = F.col("n_members") >= scene_choice.COMPOSITE_MIN
    t_tile, r_tile = tile_of(F.col("t_id")), tile_of(F.col("a.read_id"))
    flags = F.array_compact(F.array(
        F.col("mode_flag"),
        F.when(has & (F.col("a.relative_orbit") != F.col("t_orbit")), "different_orbit_reference"),
        F.when(has & (t_tile != r_tile), "cross_tile_reference"),
        F.when(many & (F.col("spread") > scene_choice.AMF_SPREAD_MAX), "composite_amf_spread"),
    ))
    return per.select(
        "det_id", F.when(has, F.col("a.read_id")).alias("reference_id"), flags.alias("reference_flags"), "members",
        F.when(many, "composite").otherwise("single").alias("reference_mode"), F.when(many, F.col("spread")).otherwise(0.0).alias("amf_spread"), has.alias("has_reference"),
    )


def pass_pixels(passes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Pixels of each request and pass; several reference members become their per-pixel median.

    At most a handful of members meet in one pixel, so the built-in median is bounded.
    """
    reads = passes.select("det_id", "role", F.col("read_id").alias("scene_id"), "spacecraft", "amf")
    amf = reads.groupBy("det_id", "role").agg(F.median("amf").alias("amf"), F.first("spacecraft").alias("spacecraft"))
    joined = reads.select("det_id", "role", "scene_id").join(pixels, "scene_id")
    merged = joined.groupBy("det_id", "role", "y", "x").agg(*[F.median(b).alias(b) for b in BANDS])
    return merged.join(amf, ["det_id", "role"])


def retrieve(px: DataFrame, lut: DataFrame) -> DataFrame:
    """Signal and both inversions per request, pass and pixel; flare pixels are out of the fits and masked."""
    keys = ["det_id", "role"]
    hot = retrieval.hot_pixel(F.col("spacecraft"), F.col("b8a"), F.col("b11"), F.col("b12"))
    tagged = retrieval.guard_chip(px).withColumn("hot", hot)
    grown = mo.dilate(tagged.where("hot"), keys, 1).withColumn("near_hot", F.lit(True))
    df = tagged.join(grown, [*keys, "y", "x"], "left").withColumn("near_hot", F.coalesce("near_hot", F.lit(False)))
    df = retrieval.single_pass(df, keys, robust=True, exclude=F.col("near_hot"))
    df = df.withColumn("delta_r", F.when(~F.col("near_hot"), F.col("delta_r")))
    df = invert_signal(df, lut, "report", "delta_r", "d_omega")
    return invert_signal(df, lut, "mask", "delta_r", "mask_omega")


def combine_passes(ret: DataFrame, settings: Settings) -> DataFrame:
    """Both passes side by side per pixel, with the reported and the mask difference.

    With a reference a pixel missing in either pass is missing in the difference.
    """
    def of(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c)))

    cols = [of("target", c).alias(f"t_{c}") for c in ("delta_r", "d_omega", "mask_omega", "b2", "b3", "b4", "b12", "c", "n_excluded")]
    cols += [of("reference", c).alias(f"r_{c}") for c in ("delta_r", "d_omega", "mask_omega", "c", "n_excluded")]
    cols += [of(role, "hot_n").alias(f"{role[0]}_hot") for role in ("target", "reference")]
    wide = ret.withColumn("hot_n", F.col("hot").cast("int")).groupBy("det_id", "y", "x").agg(*cols, F.count_if(F.col("role") == "target").alias("in_target"))
    return wide


def difference(wide: DataFrame, has_reference: DataFrame) -> DataFrame:
    df = wide.join(has_reference.select("det_id", "has_reference"), "det_id")

    def diff(c: str) -> Column:
        return F.when(F.col("has_reference"), F.col(f"t_{c}") - F.col(f"r_{c}")).otherwise(F.col(f"t_{c}"))

    return df.withColumns({"delta_r": diff("delta_r"), "delta_omega": diff("d_omega"), "mask_field": diff("mask_omega")})


def analyze(requests: DataFrame, scenes: DataFrame, pixels: DataFrame, winds: DataFrame, chips: DataFrame, lut: DataFrame,
            settings: Settings = Settings(), sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one result row per request, mask pixels).

    ``pixels``: scene_id, y, x and the six bands. ``winds``: det_id, u10, sigma_u10, from_deg,
    fallback_used. ``chips``: det_id, area_m2. ``sources``: det_id, source_y, source_x.
    """
    passes = materialize(plan_passes(requests, scenes, settings), "passes")
    info = reference_flags(passes)
    ret = retrieve(pass_pixels(passes, pixels), lut)
    fields = materialize(difference(combine_passes(ret, settings), info), "fields")
    ks = tuple(dict.fromkeys((*plume.K_SWEEP, settings.k_sigma)))
    field = fields.select("det_id", "y", "x", F.col("mask_field").alias("value"))
    masks = materialize(plume.detect_plumes(field, KEY, ks=ks, min_area=settings.min_area_px, sources=sources), "masks")
    shown = masks.where(F.col("k") == settings.k_sigma).select("det_id", "y", "x")
    own = fields.where("has_reference").select("det_id", "y", "x", F.col("r_mask_omega").alias("value"))
    ref_mask = plume.detect_plumes(own, KEY, ks=(settings.k_sigma,), min_area=settings.min_area_px, sources=sources)
    dirty = ref_mask.select("det_id").distinct().withColumn("dirty", F.lit(True))
    out = summarize(fields, masks, shown, chips, winds, settings)
    surface = plume.surface_correlation(shown, fields.select("det_id", "y", "x", F.col("t_b4").alias("b4"), F.col("t_b3").alias("b3"), F.col("t_b2").alias("b2")), KEY)
    out = out.join(info.drop("has_reference"), "det_id", "left").join(dirty, "det_id", "left").join(surface, "det_id", "left")
    return requests.select("det_id", "site_id", "scene_id").join(finish(out, winds), "det_id", "left"), masks


def summarize(fields: DataFrame, masks: DataFrame, shown: DataFrame, chips: DataFrame, winds: DataFrame, settings: Settings) -> DataFrame:
    """Per request: pixel statistics inside the shown mask, the k sweep and the rate."""
    tagged = fields.join(shown.withColumn("m", F.lit(True)), ["det_id", "y", "x"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    m = F.col("m")
    lo, hi = retrieval.edge_share(F.col("t_d_omega"), m, settings.lut_lo, settings.lut_hi)
    rlo, rhi = retrieval.edge_share(F.col("r_d_omega"), m, settings.lut_lo, settings.lut_hi)
    n_target = F.sum("in_target")
    stats = tagged.groupBy("det_id").agg(
        F.count_if(m).alias("n_pixels"), F.count_if(m & F.col("delta_omega").isNull()).alias("n_missing"),
        retrieval.mean_sign_ok(F.col("t_delta_r"), m).alias("dims"), lo.alias("target_lo"), hi.alias("target_hi"), rlo.alias("ref_lo"), rhi.alias("ref_hi"),
        F.coalesce(F.sum("t_hot"), F.lit(0)).alias("n_hot_target"), F.coalesce(F.sum("r_hot"), F.lit(0)).alias("n_hot_reference"),
        retrieval.chip_flags(n_target, F.col("t_b12"), F.col("t_b2")).alias("chip_flags"),
        F.max("t_c").alias("c_target"), F.max("r_c").alias("c_ref"), F.max("t_n_excluded").alias("n_excluded_target"), F.max("r_n_excluded").alias("n_excluded_ref"),
        F.max(F.when(m, column_to_ppb(F.col("delta_omega")))).alias("xch4_max_ppb"), invalid_share(F.col("delta_omega"), m).alias("invalid_share"),
    )
    # Requests without a plume end here: the costly part runs on the others only.
    found = shown.select("det_id").distinct()
    px = fields.select("det_id", "y", "x", "delta_omega").join(found, "det_id", "left_semi")
    plain = emission.emission_over_mask(px, KEY, shown, chips.join(winds.select("det_id", "u10"), "det_id"))
    sweep = emission.sweep_masses(px, KEY, masks.where(F.col("k").isin(*[float(k) for k in plume.K_SWEEP])), chips)
    sweep = sweep.join(winds.select("det_id", "u10", "sigma_u10"), "det_id").join(found, "det_id", "left_semi")
    off = px.join(shown, ["det_id", "y", "x"], "left_anti")
    mc = emission.monte_carlo(sweep, off, KEY, F.col("det_id"), draws=settings.draws, seed=settings.seed)
    unstable = sweep.select("det_id", "n_k", emission.unstable(F.col("n_k")).alias("unstable"))
    return (
        stats.join(plain.select("det_id", "ime_kg", "l_m", "sigma_noise", F.col("q_kg_h").alias("q_single_kg_h")), "det_id", "left")
        .join(mc.drop("n_draws"), "det_id", "left").join(unstable, "det_id", "left")
    )


def finish(out: DataFrame, winds: DataFrame) -> DataFrame:
    """Quality flags in their fixed order beside the numbers."""
    df = out.join(winds.select("det_id", "u10", "sigma_u10", "from_deg", "fallback_used"), "det_id", "left")
    has = F.col("n_pixels") > 0
    late = F.array_compact(F.array(
        F.when(F.col("fallback_used"), "wind_fallback_used"),
        F.when(F.col("n_hot_target") > 0, "flare_lit_target"),
        F.when(F.col("n_hot_reference") > 0, "flare_lit_reference"),
        F.when(F.col("dirty"), "possible_reference_contamination"),
        F.when(~has, "no_plume"),
        F.when(has & (F.col("n_missing") > 0), "nan_in_mask"),
        F.when(has & ~F.col("dims"), "not_b12_dimming"),
        F.when(has & (F.col("surface_r") > plume.SURFACE_CUT), "surface_correlated"),
        F.when(F.col("target_hi") > CLIP_SHARE, "lut_hi_clipped_mask"),
        F.when(has & F.col("unstable"), "unstable_mask"),
    ))
    flags = F.concat(F.coalesce("reference_flags", F.array().cast("array<string>")), F.coalesce("chip_flags", F.array().cast("array<string>")), late)
    keep = [
        "det_id", "reference_id", "reference_mode", "members", "amf_spread", "n_pixels", "q_kg_h", "q_sigma_kg_h", "percentiles", "histogram", "q_single_kg_h",
        "ime_kg", "l_m", "sigma_noise", "u10", "sigma_u10", "from_deg", "c_target", "c_ref", "n_excluded_target", "n_excluded_ref", "xch4_max_ppb", "invalid_share",
        "target_lo", "target_hi", "ref_lo", "ref_hi", "n_hot_target", "n_hot_reference", "n_k", "surface_r",
    ]
    return df.select(*keep, flags.alias("flags"))


def score_truth(products: DataFrame, pixels: DataFrame, lut: DataFrame, keys: Sequence[str] = ("product",)) -> DataFrame:
    """Every product with emission against the zero-rate product of its group, per method and source mode.

    ``products``: product, site, plume_no, q_true, amf, spacecraft, u10, area_m2. ``pixels``:
    product, y, x, the bands and ``truth``. Single-pass and differenced fields, with the source
    given (at the truth's peak) or not, give four scores per product.
    """
    keys = list(keys)
    passes = products.select("product", F.lit("target").alias("role"), F.col("product").alias("det_id"), "amf", "spacecraft")
    px = pixels.select("product", "y", "x", *BANDS).join(passes, "product").select("det_id", "role", "y", "x", *BANDS, "amf", "spacecraft")
    ret = retrieve(px, lut).select(F.col("det_id").alias("product"), "y", "x", "d_omega", "mask_omega", "hot")
    ret = materialize(ret, "scored-pixels")
    zero = products.where("q_true = 0").groupBy("site", "plume_no").agg(F.min("product").alias("zero"))
    wanted = products.where("q_true > 0").join(zero, ["site", "plume_no"])
    base = ret.select(F.col("product").alias("zero"), "y", "x", F.col("d_omega").alias("z"), F.col("mask_omega").alias("zm"))
    both = wanted.select("product", "zero").join(ret, "product").join(base, ["zero", "y", "x"], "left")
    method = F.explode(F.array(
        F.struct(F.lit("mbsp").alias("method"), F.col("d_omega").alias("delta_omega"), F.col("mask_omega").alias("value")),
        F.struct(F.lit("mbmp").alias("method"), (F.col("d_omega") - F.col("z")).alias("delta_omega"), (F.col("mask_omega") - F.col("zm")).alias("value")),
    ))
    long = both.select("product", "y", "x", method.alias("f")).select("product", "y", "x", "f.*")
    modes = long.withColumn("mode", F.explode(F.array(F.lit("hinted"), F.lit("blind"))))
    modes = materialize(modes, "scored-fields")
    group = ["product", "method", "mode"]
    peak = pixels.groupBy("product").agg(F.max_by(F.struct("y", "x"), F.struct(F.col("truth"), -F.col("y"), -F.col("x"))).alias("p"), F.max("truth").alias("peak"))
    hint = modes.where("mode = 'hinted'").select(*group).distinct().join(peak, "product").select(*group, F.col("p.y").alias("source_y"), F.col("p.x").alias("source_x"))
    mask = plume.detect_plumes(modes.select(*group, "y", "x", "value"), group, sources=hint).select(*group, "y", "x").withColumn("m", F.lit(True))
    truth = pixels.join(peak, "product").select("product", "y", "x", ((F.col("peak") > 0) & (F.col("truth") >= 0.05 * F.col("peak"))).alias("in_truth"), "truth")
    cells = modes.join(mask, [*group, "y", "x"], "left").join(truth, ["product", "y", "x"])
    m = F.coalesce(F.col("m"), F.lit(False))
    d = column_to_ppb(F.col("delta_omega")) - F.col("truth")
    err = F.when(F.col("in_truth") & F.col("delta_omega").isNotNull(), d)
    union = F.count_if(m | F.col("in_truth"))
    per = cells.join(products.select("product", "area_m2", "u10"), "product").groupBy(*group).agg(
        F.count_if(m).alias("n_pixels"), F.when(union == 0, 0.0).otherwise(F.try_divide(F.count_if(m & F.col("in_truth")), union)).alias("iou"),
        F.avg(err).alias("bias_ppb"), F.sqrt(F.avg(err * err)).alias("rms_ppb"), invalid_share(F.col("delta_omega"), m).alias("invalid_fraction"),
        emission.mass_kg(F.when(m, F.col("delta_omega")), F.col("area_m2")).alias("ime_kg"), F.first("area_m2").alias("area_m2"), F.first("u10").alias("u10"),
    )
    length = emission.length_m(F.col("n_pixels"), F.col("area_m2"))
    hot = ret.groupBy("product").agg(F.count_if("hot").alias("n_hot"))
    scored = per.withColumns({
        "detected": F.col("n_pixels") > 0, "l_m": length,
        "q_ours": F.when(F.col("n_pixels") > 0, emission.rate_kg_h(F.col("u10"), length, F.col("ime_kg"))),
    })
    return wanted.select("product", "site", "plume_no", "q_true").join(scored, "product").join(hot, "product")
