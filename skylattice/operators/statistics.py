"""Regression, detection and evaluation statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skylattice.functions.joins import salted_join, with_single_row
from skylattice.functions.quantiles import exact_median, exact_percentiles, pearson, robust_spread
from skylattice.functions.ranks import average_rank
from skylattice.operators.pair_slopes import median_pair_slope

# Fixed values.
RATE_BIN_EDGES = (500.0, 1000.0, 2000.0, 3000.0, 5000.0, 7500.0, 10000.0, 15000.0, 25000.0, 50001.0)
MIN_DETECT_RATE = 0.5
VALID_SHARE = 0.2
PUBLISHED_SLOPE = 0.33
PUBLISHED_OFFSET = 0.45
MIN_WIND_SPAN = 3.0
TRUTH_SHARE = 0.05
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
K_GRID = tuple(1.0 + 0.25 * i for i in range(13))


def origin_slope(x: Column, y: Column) -> Column:
    """Aggregate: least-squares slope of ``y`` on ``x`` through the origin."""
    return F.try_divide(F.sum(x * y), F.sum(x * x))


def ratio_statistics(pairs: DataFrame, keys: tuple[str, ...], ours: str = "q_ours", ref: str = "q_ref") -> DataFrame:
    """n, slope through the origin, median ratio and robust scatter of log10 ratios."""
    p = pairs.withColumns({"_ratio": F.try_divide(F.col(ours), F.col(ref))}).withColumn("_log", F.log10("_ratio"))
    slope = p.groupBy(*keys).agg(F.count("*").alias("n"), origin_slope(F.col(ref), F.col(ours)).alias("slope"))
    med = exact_median(p, keys, "_ratio", "median_ratio").drop("n")
    spread = robust_spread(p, keys, "_log").select(*keys, F.col("sigma").alias("log_scatter"))
    return slope.join(med, list(keys), "left").join(spread, list(keys), "left")


def theil_sen(points: DataFrame, keys: tuple[str, ...], x: str = "q_ref", y: str = "q_ours") -> DataFrame:
    """Median slope over all pairs with distinct x."""
    return median_pair_slope(points, keys, x, y)


def spearman(pairs: DataFrame, keys: tuple[str, ...], a: str = "q_ours", b: str = "q_ref") -> DataFrame:
    """Rank correlation with average ranks and its two-sided p; NULL below three pairs."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_rank(average_rank(both, keys, a, "_ra"), keys, b, "_rb")
    per = r.groupBy(*keys).agg(F.count("*").alias("n"), pearson("_ra", "_rb").alias("_rho"))
    per = per.withColumn("rho", F.when(F.col("n") >= 3, F.col("_rho"))).drop("_rho")
    t2 = F.col("rho") * F.col("rho")
    return per.withColumn("p", rank_p(F.col("rho"), F.col("n"), t2))


@F.pandas_udf(DoubleType())
def _t_tail(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(r, k) for r, k in zip(rho, n)])


def rank_p(rho: Column, n: Column, squared: Column) -> Column:
    """Two-sided p-value of a rank correlation: one number per group."""
    return F.when(rho.isNull(), F.lit(None).cast("double")).when(squared >= 1.0, F.lit(0.0)).otherwise(_t_tail(rho, n))


def _two_sided(rho: float, n: float) -> float | None:
    """Student-t tail through the incomplete beta function by Gauss-Legendre quadrature."""
    if rho is None or np.isnan(rho) or n < 3:
        return None
    df = n - 2.0
    if df == 0 or abs(rho) >= 1:
        return 0.0 if abs(rho) >= 1 else 1.0
    # P(|T| > t) = P(|sin U| > |rho|) for the density cos^(df-1) on the angle.
    nodes, weights = np.polynomial.legendre.leggauss(200)

    def mass(lo: float, hi: float) -> float:
        angle = (nodes + 1) * (hi - lo) / 2 + lo
        return float((weights * np.cos(angle) ** (df - 1)).sum() * (hi - lo) / 2)

    cut, reach = float(np.arcsin(abs(rho))), 12.0 / np.sqrt(df)
    tail, body = mass(cut, min(np.pi / 2, cut + reach)), mass(0.0, min(cut, reach))
    return tail / (tail + body)


def rate_bins(spark: SparkSession, edges: Sequence[float] = RATE_BIN_EDGES) -> DataFrame:
    rows = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "bin int, q_lo double, q_hi double")


def bin_of(q: Column, edges: Sequence[float] = RATE_BIN_EDGES) -> Column:
    """Index of the half-open bin that holds ``q``; NULL outside all."""
    steps = F.array(*[F.lit(e) for e in edges])
    at = F.size(F.filter(steps, lambda e: e <= q)) - 1
    return F.when((at >= 0) & (at < len(edges) - 1), at)


def detection_curve(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Detected share per rate bin, all bins present."""
    bins = rate_bins(scores.sparkSession)
    counted = scores.withColumn("bin", bin_of(F.col("q_true"))).where("bin IS NOT NULL").groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(F.col("detected").cast("int")).alias("detect_rate")
    )
    all_bins = scores.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(RATE_BIN_EDGES) - 2))))
    full = all_bins.join(counted, [*keys, "bin"], "left").join(F.broadcast(bins), "bin")
    return full.select(*keys, "bin", "q_lo", "q_hi", F.coalesce("n", F.lit(0)).alias("n"), F.round("detect_rate", 4).alias("detect_rate"))


def min_detectable(curve: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lower edge of the lowest bin that reaches the detection rate."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("detect_rate") >= MIN_DETECT_RATE, F.col("q_lo"))).alias("min_detectable"))


def recoverable() -> Column:
    """Detected, positive and inside the range where the model holds."""
    return F.col("detected") & (F.col("q_ours") > 0) & (F.col("invalid_fraction") <= VALID_SHARE)


def recovery(scores: DataFrame, keys: tuple[str, ...], truth: str = "q_true") -> DataFrame:
    """Slope, ratio, scatter, Theil-Sen and rank correlation of recoverable rates; below three only n."""
    use = scores.where(recoverable())
    base = ratio_statistics(use, keys, "q_ours", truth)
    ts = theil_sen(use, keys, truth, "q_ours")
    sp = spearman(use, keys, "q_ours", truth).drop("n")
    out = base.join(ts, list(keys), "left").join(sp, list(keys), "left")
    enough = F.col("n") >= 3
    names = ("slope", "median_ratio", "log_scatter", "theil_sen", "rho", "p")
    return out.select(*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in names])


def coverage(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Share of rates whose one-sigma band holds the truth."""
    inside = F.abs(F.col("q_true") - F.col("q_ours")) <= F.col("sigma")
    return scores.where(F.col("sigma").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("coverage"))


def benchmark_report(scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Counts, recovery, minimum detectable rate and medians per group."""
    n = scores.groupBy(*keys).agg(F.count("*").alias("n_products"), F.count_if("detected").alias("n_detected"))
    iou = exact_median(scores.where("detected"), keys, "iou", "median_iou").drop("n")
    bias = exact_median(scores, keys, "bias_ppb", "median_bias").drop("n")
    low = min_detectable(detection_curve(scores, keys), keys)
    slope = scores.where(recoverable()).groupBy(*keys).agg(F.count("*").alias("n_recovered"), origin_slope(F.col("q_ref"), F.col("q_ours")).alias("slope"))
    out = n
    for part in (iou, bias, low, slope):
        out = out.join(part, list(keys), "left")
    return out


def wind_fit(points: DataFrame, keys: tuple[str, ...], u: str = "u10", ueff: str = "u_eff") -> DataFrame:
    """Line with 95 per cent intervals and whether to adopt it over the published constants.

    Errors are in closed form: residual sum over n-2, scaled as a least-squares covariance.
    """
    x, y = F.col(u), F.col(ueff)
    agg = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("alpha"), F.regr_intercept(y, x).alias("beta"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.avg(x).alias("_mx"),
        (F.max(F.round(x, 3)) - F.min(F.round(x, 3))).alias("span"),
    )
    s2 = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (F.col("n") - 2)
    fitted = (F.col("n") >= 3) & (F.col("span") > 1e-6)
    df = agg.where(fitted).withColumns({
        "se_alpha": F.sqrt(s2 / F.col("_sxx")), "se_beta": F.sqrt(s2 * (1 / F.col("n") + F.col("_mx") * F.col("_mx") / F.col("_sxx"))),
    })

    def misses(value: str, se: str, published: float) -> Column:
        return F.abs(F.col(value) - published) > 1.96 * F.col(se)

    excludes = misses("alpha", "se_alpha", PUBLISHED_SLOPE) | misses("beta", "se_beta", PUBLISHED_OFFSET)
    adopt = (F.col("span") >= MIN_WIND_SPAN) & excludes
    decision = F.when(adopt, "adopt_refit").when(F.col("span") < MIN_WIND_SPAN, "insufficient_wind_diversity").otherwise("interval_includes_published")
    return df.select(*keys, "n", "span", "alpha", "beta", "se_alpha", "se_beta", decision.alias("decision"))


def confusion(rows: DataFrame, keys: Sequence[str], truth: Column, pred: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and F1; a ratio without a denominator is zero."""
    c = rows.groupBy(*keys).agg(
        F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"),
        F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    c = c.withColumns({
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    p, r = F.col("precision"), F.col("recall")
    return c.withColumn("f1", ratio(2 * p * r, p + r))


def threshold_sweep(rows: DataFrame, truth: Column, score: Column, params: Sequence[float] = THRESHOLDS, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion at every threshold of a fixed list, in one pass."""
    each = rows.withColumn("param", F.explode(F.array(*[F.lit(float(p)) for p in params])))
    return confusion(each, [*keys, "param"], truth, score >= F.col("param"))


def best_param(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parameter with the highest F1, the lowest on a tie."""
    return sweep.groupBy(*keys).agg(
        F.max_by("param", F.struct(F.col("f1"), -F.col("param"))).alias("best_param"), F.max("f1").alias("best_f1")
    )


def bias_rms(pixels: DataFrame, keys: Sequence[str], ours: str, truth: str) -> DataFrame:
    """Mean and root-mean-square difference where the truth reaches a share of its own peak."""
    peak = pixels.groupBy(*keys).agg(F.max(truth).alias("_peak"))
    sel = salted_join(pixels, peak, keys, [truth]).where((F.col("_peak") > 0) & (F.col(truth) >= TRUTH_SHARE * F.col("_peak")) & F.col(ours).isNotNull())
    d = F.col(ours) - F.col(truth)
    return sel.groupBy(*keys).agg(F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rms"), F.count("*").alias("n"))


def noise_floors(rows: DataFrame, site: str = "site", q: str = "q_ours") -> DataFrame:
    """Detection rate and median detected rate per site, and pooled as one more row (site NULL)."""
    rate = F.avg(F.col("detected").cast("int")).alias("detect_rate")
    per = rows.groupBy(site).agg(F.count("*").alias("n_pairs"), rate).join(
        exact_median(rows.where("detected"), (site,), q, "floor").drop("n"), site, "left"
    )
    pooled_floor = exact_median(rows.where("detected"), (), q, "floor").drop("n")
    pooled = with_single_row(rows.agg(F.count("*").alias("n_pairs"), rate), pooled_floor)
    return per.unionByName(pooled.withColumn(site, F.lit(None).cast("string")))


def distribution_summary(rows: DataFrame, keys: tuple[str, ...], value: str, bins: int = 24) -> DataFrame:
    """Percentiles, median and population spread per group."""
    pct = exact_percentiles(rows, keys, value, {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    std = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    return pct.join(std, list(keys))


def histogram(rows: DataFrame, keys: tuple[str, ...], value: str, bins: int = 24) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed, empty bins included."""
    span = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))).otherwise(0)
    counted = salted_join(rows, span, keys, [value]).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(float(bins))
    return every.join(counted, [*keys, "bin"], "left").select(*keys, "bin", edge.alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def event_gate(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Retrieved mean against the published rate: PASS within half and overlapping, MARGINAL overlapping only."""
    per = rows.groupBy(*keys).agg(
        F.avg("q_ours").alias("q_mean"), F.first("q_ref").alias("q_ref"), F.avg("sigma").alias("sigma"), F.first("sigma_ref").alias("sigma_ref")
    )
    gap = F.abs(F.col("q_mean") - F.col("q_ref"))
    within, overlap = gap <= 0.5 * F.col("q_ref"), gap <= F.col("sigma") + F.col("sigma_ref")
    return per.withColumn("verdict", F.when(within & overlap, "PASS").when(overlap, "MARGINAL").otherwise("FAIL"))
