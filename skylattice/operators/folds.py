"""Fold assignment, sampling and data preparation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.joins import salted_join
from skylattice.functions.quantiles import exact_median, robust_spread
from skylattice.functions.randoms import order_key
from skylattice.functions.ranks import numbered, value_ranks
from skylattice.operators.lookups import top_by_group

# Fixed values.
N_FOLDS = 5
NEG_PER_POS = 2.0
MIN_NEG = 25
NOMINAL_AMF = 2.3
NOMINAL_U10 = 3.98
NOMINAL_AREA_M2 = 400.0


def size_ordered_folds(rows: DataFrame, unit: str, n: int = N_FOLDS) -> DataFrame:
    """Fold per unit: units largest first, dealt round-robin; ties by unit."""
    counts = rows.groupBy(unit).agg(F.count("*").alias("size"))
    # Sizes repeat, so the fold position is the place by size plus the place among equal sizes.
    by_size = value_ranks(counts.withColumn("_neg", -F.col("size")), (), "_neg").select("_neg", "n_below")
    same = numbered(counts.withColumn("_neg", -F.col("size")), ("_neg",), unit, "_tie")
    placed = same.join(by_size, "_neg")
    return placed.select(unit, "size", ((F.col("n_below") + F.col("_tie")) % n).alias("fold"))


def sample_negatives(tiles: DataFrame, per_pos: float = NEG_PER_POS, minimum: int = MIN_NEG, seed: int = 0) -> DataFrame:
    """Every usable positive, and per site max(round(pos x per_pos), minimum) negatives by hashed order.

    A site's negatives are cut down by a bracket on the hashed order before they are numbered,
    so a huge site sends little more than its quota to one task.
    """
    usable = tiles.where(F.col("usable") & F.col("site_id").isNotNull())
    quota = usable.groupBy("site_id").agg(
        F.greatest(F.bround(F.count_if("positive") * F.lit(per_pos)), F.lit(minimum)).alias("quota"), F.count_if(~F.col("positive")).alias("n_neg")
    )
    order = F.conv(F.substring(order_key(seed, F.col("key")), 1, 13), 16, 10).cast("double")
    neg = usable.where(~F.col("positive")).withColumn("_o", order)
    neg = salted_join(neg, quota, ["site_id"], ["key"])
    # Hashed orders are uniform; eight deviations above the quota the bracket misses nothing in practice,
    # and a site whose bracket falls short keeps all its rows.
    share = (F.col("quota") + 8 * F.sqrt("quota") + 20) / F.greatest(F.col("n_neg"), F.lit(1))
    near = F.col("_o") <= share * F.lit(float(16**13))
    short = neg.groupBy("site_id").agg((F.count_if(near) < F.least(F.first("quota"), F.first("n_neg"))).alias("_short"))
    kept = salted_join(neg, short, ["site_id"], ["key"]).where(near | F.col("_short"))
    in_order = Window.partitionBy("site_id").orderBy("_o", "key")
    chosen = kept.withColumn("_i", F.row_number().over(in_order)).where(F.col("_i") <= F.col("quota"))
    return usable.where("positive").select("key", "site_id", "positive").unionByName(chosen.select("key", "site_id", "positive"))


def representative_rows(rows: DataFrame, per_source: int, sources_per_region: int) -> DataFrame:
    """Rows nearest their source's median rate, from the largest sources of each region."""
    sizes = rows.groupBy("region", "id_source").agg(F.count("*").alias("n_source"))
    big = top_by_group(sizes, ("region",), [F.desc("n_source"), F.col("id_source")], sources_per_region, "source_rank")
    use = rows.join(big, ["region", "id_source"])
    med = exact_median(use, ("id_source",), "t_h", "source_median").drop("n")
    gap = F.abs(F.col("t_h") - F.col("source_median"))
    return top_by_group(salted_join(use, med, ["id_source"], ["id_plume"]), ("region", "id_source"), [gap, F.col("id_plume")], per_source, "row_rank")


def channel_statistics(pixels: DataFrame, channels: list[str], per_chip: int | None = None, seed: int = 0) -> DataFrame:
    """Median and MAD per channel over all finite pixels, or over at most ``per_chip`` of each chip.

    The sample is the first pixels in hashed order; the per-chip limit is applied before the shuffle.
    """
    picked = pixels.unpivot(["chip_id", "y", "x"], channels, "channel", "v").where("v IS NOT NULL")
    if per_chip is not None:
        key = F.concat_ws("|", "chip_id", "channel", "y", "x")
        picked = top_by_group(picked.withColumn("_h", order_key(seed, key)), ("chip_id", "channel"), [F.col("_h")], per_chip, "_i")
    spread = robust_spread(picked, ("channel",), "v")
    return spread.select("channel", "median", "mad", "n")


def fold_sharing(rows: DataFrame) -> DataFrame:
    """How many scenes occur, and how many of them in more than one fold."""
    per = rows.groupBy("scene_id").agg(F.count_distinct("fold").alias("n_folds"))
    return per.agg(F.count("*").alias("n_scenes"), F.count_if(F.col("n_folds") > 1).alias("n_shared"))


def split_inventory(samples: DataFrame) -> DataFrame:
    """Per split and in total: samples, positives, negatives and the range of sizes."""
    return samples.groupingSets([["split"], []], "split").agg(
        F.count("*").alias("n"), F.count_if("positive").alias("n_pos"), F.count_if(~F.col("positive")).alias("n_neg"),
        F.min("size").alias("min_size"), F.max("size").alias("max_size"),
    )


def signature_inventory(values: DataFrame) -> DataFrame:
    """Per path signature (digits blanked): extremes, distinct values and whether it looks binary."""
    sig = F.regexp_replace("path", "[0-9]+", "#")
    per = values.groupBy(sig.alias("signature")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_if(~F.col("value").isin(0.0, 1.0)).alias("_other")
    )
    return per.select("signature", "n", "lo", "hi", (F.col("_other") == 0).alias("looks_binary"))


def recovery_statistics(tiles: DataFrame) -> DataFrame:
    """Shares of sited, dated and confident tiles per site and in total, with split consistency.

    A positive is usable with a confident date, a negative with any date at a site.
    """
    sited, dated = F.col("site_id").isNotNull(), F.col("date").isNotNull()
    sure = sited & F.coalesce(F.col("date_confident"), F.lit(False))
    usable = F.when(F.col("positive"), sure).otherwise(sited & dated)
    year = F.year("date")
    fits = F.when(F.col("split") == "test", year == 2021).otherwise(year <= 2020)
    t = tiles.withColumns({"sited": sited, "dated": dated, "sure": sure, "usable": usable, "fits": sure & dated & fits})
    return t.groupingSets([["site_id"], []], "site_id").agg(
        F.count("*").alias("n"), F.count_if("sited").alias("n_sited"), F.count_if("dated").alias("n_dated"), F.count_if("sure").alias("n_confident"),
        F.count_if("usable").alias("n_usable"), F.coalesce(F.try_divide(F.count_if("fits"), F.count_if("sure")), F.lit(0.0)).alias("split_consistency"),
        F.grouping("site_id").alias("is_total"),
    )


def label_gate(integrals: DataFrame) -> DataFrame:
    """Positives whose label integrates to nothing or less are excluded; every negative stays."""
    out = F.col("positive") & ~(F.coalesce(F.col("integral"), F.lit(0.0)) > 0)
    return integrals.withColumn("gate", F.when(out, "excluded").otherwise("kept"))


def nominal_label_rate(n_pixels: Column, integral: Column) -> Column:
    """Order-of-magnitude rate of a label at nominal wind and pixel size."""
    from skylattice.operators.emission import KG_PER_MOL
    from skylattice.operators.winds import effective_wind

    mass = integral * NOMINAL_AREA_M2 * KG_PER_MOL
    return F.when(n_pixels == 0, F.lit(0.0)).otherwise(F.try_divide(effective_wind(F.lit(NOMINAL_U10)), F.sqrt(n_pixels * NOMINAL_AREA_M2)) * mass * 3600.0)
