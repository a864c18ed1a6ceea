"""Regression, detection, evaluation and inventory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.joins import with_single_row
from skylattice.operators import folds, plume, statistics
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6

_THEIL = """ts AS (SELECT a.site, median((b.{y} - a.{y}) / (b.{x} - a.{x})) AS theil_sen FROM {t} a JOIN {t} b ON a.site = b.site AND a.id < b.id AND a.{x} <> b.{x} GROUP BY a.site)"""
_RANKS = """rk AS (SELECT site, rank() OVER (PARTITION BY site ORDER BY {y}) + (count(*) OVER (PARTITION BY site, {y}) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY site ORDER BY {x}) + (count(*) OVER (PARTITION BY site, {x}) - 1) / 2.0 AS rb FROM {t}),
 sp AS (SELECT site, count(*) AS k, corr(ra, rb) AS rho FROM rk GROUP BY site)"""
_RATIO = """
 b AS (SELECT site, count(*) AS n, sum({y} * {x}) / sum({x} * {x}) AS slope, median({y} / {x}) AS median_ratio, median(log10({y} / {x})) AS lm FROM {t} GROUP BY site),
 sc AS (SELECT site, 1.4826 * median(abs(log10({y} / {x}) - lm)) AS log_scatter FROM {t} JOIN b USING (site) GROUP BY site)"""


@query(
    "ag17_ratio_statistics", "truth",
    oracle="WITH " + _RATIO.format(t="truth", x="q_ref", y="q_ours") + " SELECT site, n, round(slope, 6) AS slope, round(median_ratio, 6) AS median_ratio, round(log_scatter, 6) AS log_scatter FROM b JOIN sc USING (site)",
)
def ratio_statistics(spark, sf):
    df = statistics.ratio_statistics(v.truth(spark, sf), ("site",))
    return df.select("site", "n", *[r6(c).alias(c) for c in ("slope", "median_ratio", "log_scatter")])


@query("ag18_theil_sen", "truth", oracle="WITH " + _THEIL.format(t="truth", x="q_ref", y="q_ours") + " SELECT site, round(theil_sen, 6) AS theil_sen FROM ts")
def theil_sen(spark, sf):
    return statistics.theil_sen(v.truth(spark, sf), ("site",)).select("site", r6("theil_sen").alias("theil_sen"))


@query("ag19_rank_correlation", "truth", oracle="WITH " + _RANKS.format(t="truth", x="q_ref", y="q_ours") + " SELECT site, k AS n, round(rho, 6) AS rho FROM sp")
def rank_correlation(spark, sf):
    return statistics.spearman(v.truth(spark, sf), ("site",)).select("site", "n", r6("rho").alias("rho"))


@query("ag19_rank_correlation_p")
def rank_correlation_p(spark, sf):
    return statistics.spearman(v.truth(spark, sf), ("site",)).select("site", "n", r6("rho").alias("rho"), r6("p").alias("p"))


_EDGES = (500, 1000, 2000, 3000, 5000, 7500, 10000, 15000, 25000, 50001)
_BINS = "bins(bin, q_lo, q_hi) AS (VALUES " + ", ".join(f"({i}, {a}.0, {b}.0)" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + ")"
_CURVE = _BINS + """, curve AS (SELECT s.site, bin, q_lo, q_hi, count(t.id) AS n, avg(CAST(t.detected AS INTEGER)) AS rate
  FROM (SELECT DISTINCT site FROM truth) s CROSS JOIN bins LEFT JOIN truth t ON t.site = s.site AND t.q_true >= q_lo AND t.q_true < q_hi GROUP BY ALL)"""


@query("ag20_detection_curve", "truth", oracle=f"WITH {_CURVE} SELECT c.site, c.bin, c.q_lo, c.n, round(c.rate, 4) AS detect_rate, m.min_detectable FROM curve c LEFT JOIN (SELECT site, min(q_lo) AS min_detectable FROM curve WHERE round(rate, 4) >= 0.5 GROUP BY site) m USING (site)")
def detection_curve(spark, sf):
    curve = statistics.detection_curve(v.truth(spark, sf), ("site",))
    low = statistics.min_detectable(curve, ("site",))
    return curve.join(low, "site", "left").select("site", "bin", "q_lo", "n", "detect_rate", "min_detectable")


_USE = "use AS (SELECT * FROM truth WHERE detected AND q_ours > 0 AND invalid_fraction <= 0.2)"


@query(
    "ag21_recovery", "truth",
    oracle=f"WITH {_USE}, " + _RATIO.format(t="use", x="q_true", y="q_ours") + ", " + _THEIL.format(t="use", x="q_true", y="q_ours") + ", " + _RANKS.format(t="use", x="q_true", y="q_ours")
    + """ SELECT site, n, round(CASE WHEN n >= 3 THEN slope END, 6) AS slope, round(CASE WHEN n >= 3 THEN median_ratio END, 6) AS median_ratio, round(CASE WHEN n >= 3 THEN log_scatter END, 6) AS log_scatter,
      round(CASE WHEN n >= 3 THEN theil_sen END, 6) AS theil_sen, round(CASE WHEN n >= 3 THEN rho END, 6) AS rho FROM b LEFT JOIN sc USING (site) LEFT JOIN ts USING (site) LEFT JOIN sp USING (site)""",
)
def recovery(spark, sf):
    df = statistics.recovery(v.truth(spark, sf), ("site",))
    return df.select("site", "n", *[r6(c).alias(c) for c in ("slope", "median_ratio", "log_scatter", "theil_sen", "rho")])


@query("ag22_interval_coverage", "truth", oracle="SELECT site, count(*) AS n, round(avg(CAST(abs(q_true - q_ours) <= sigma * 100 AS INTEGER)), 6) AS coverage FROM truth GROUP BY site")
def interval_coverage(spark, sf):
    t = v.truth(spark, sf).withColumn("sigma", F.col("sigma") * 100)
    return statistics.coverage(t, ("site",)).select("site", "n", r6("coverage").alias("coverage"))


@query(
    "ag23_benchmark_report", "truth",
    oracle="""
    WITH n AS (SELECT site, method, mode, count(*) AS n_products, count(CASE WHEN detected THEN 1 END) AS n_detected, median(CASE WHEN detected THEN iou END) AS median_iou, median(bias_ppb) AS median_bias,
      count(CASE WHEN detected AND q_ours > 0 AND invalid_fraction <= 0.2 THEN 1 END) AS k,
      sum(CASE WHEN detected AND q_ours > 0 AND invalid_fraction <= 0.2 THEN q_ours * q_ref END) / sum(CASE WHEN detected AND q_ours > 0 AND invalid_fraction <= 0.2 THEN q_ref * q_ref END) AS slope FROM truth GROUP BY ALL),
    bins(q_lo, q_hi) AS (VALUES """ + ", ".join(f"({a}.0, {b}.0)" for a, b in zip(_EDGES, _EDGES[1:])) + """),
    m AS (SELECT site, method, mode, min(q_lo) AS min_detectable FROM (SELECT site, method, mode, q_lo, round(avg(CAST(detected AS INTEGER)), 4) AS rate FROM truth JOIN bins ON q_true >= q_lo AND q_true < q_hi GROUP BY ALL) WHERE rate >= 0.5 GROUP BY ALL)
    SELECT site, method, mode, n_products, n_detected, round(median_iou, 6) AS median_iou, round(median_bias, 6) AS median_bias, min_detectable, CASE WHEN k > 0 THEN k END AS n_recovered, round(slope, 6) AS slope
    FROM n LEFT JOIN m USING (site, method, mode)""",
)
def benchmark_report(spark, sf):
    df = statistics.benchmark_report(v.truth(spark, sf), ("site", "method", "mode"))
    return df.select("site", "method", "mode", "n_products", "n_detected", r6("median_iou").alias("median_iou"), r6("median_bias").alias("median_bias"),
                     "min_detectable", "n_recovered", r6("slope").alias("slope"))


@query(
    "ag24_wind_fit", "truth",
    oracle="""
    WITH p AS (SELECT site, u10, u10 * 0.36 + 0.4 + q_ours / 19997.0 AS y FROM truth WHERE detected),
    a AS (SELECT site, count(*) AS n, max(round(u10, 3)) - min(round(u10, 3)) AS span, regr_slope(y, u10) AS alpha, regr_intercept(y, u10) AS beta, regr_sxx(y, u10) AS sxx, regr_syy(y, u10) AS syy, regr_sxy(y, u10) AS sxy, avg(u10) AS mx FROM p GROUP BY site),
    s AS (SELECT *, greatest(0, syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM a WHERE n >= 3 AND span > 1e-6),
    e AS (SELECT *, sqrt(s2 / sxx) AS sa, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS sb FROM s)
    SELECT site, n, span, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(sa, 6) AS se_alpha, round(sb, 6) AS se_beta,
      CASE WHEN span >= 3 AND (abs(alpha - 0.33) > 1.96 * sa OR abs(beta - 0.45) > 1.96 * sb) THEN 'adopt_refit' WHEN span < 3 THEN 'insufficient_wind_diversity' ELSE 'interval_includes_published' END AS decision FROM e""",
)
def wind_fit(spark, sf):
    pts = v.truth(spark, sf).where("detected").withColumn("u_eff", F.col("u10") * 0.36 + 0.4 + F.col("q_ours") / 19997.0)
    df = statistics.wind_fit(pts, ("site",))
    return df.select("site", "n", "span", *[r6(c).alias(c) for c in ("alpha", "beta", "se_alpha", "se_beta")], "decision")


_CONF = """tp, fp, fn, tn, round(prec, 6) AS precision, round(rec, 6) AS recall, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS f1 FROM (
  SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS prec, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS rec FROM ({inner}))"""
_COUNTS = "count(CASE WHEN t AND p THEN 1 END) AS tp, count(CASE WHEN NOT t AND p THEN 1 END) AS fp, count(CASE WHEN t AND NOT p THEN 1 END) AS fn, count(CASE WHEN NOT t AND NOT p THEN 1 END) AS tn"


@query(
    "ag25_confusion", "truth",
    oracle="SELECT site, " + _CONF.format(inner=f"SELECT site, {_COUNTS} FROM (SELECT site, detected AS t, iou >= 0.4 AS p FROM truth) GROUP BY site"),
)
def confusion(spark, sf):
    df = statistics.confusion(v.truth(spark, sf), ("site",), F.col("detected"), F.col("iou") >= 0.4)
    return df.select("site", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "ag26_threshold_sweep", "truth",
    oracle="WITH sw AS (SELECT site, param, " + _CONF.format(inner=f"SELECT site, param, {_COUNTS} FROM (SELECT site, param, detected AS t, iou >= param AS p FROM truth CROSS JOIN (SELECT unnest(range(1, 20)) * 5 / 100.0 AS param)) GROUP BY ALL")
    + """), b AS (SELECT site, arg_max(param, {'f': f1, 'p': -param}) AS best_param, max(f1) AS best_f1 FROM sw GROUP BY site)
    SELECT sw.site, param, f1, round(best_param, 6) AS best_param, best_f1 FROM sw JOIN b USING (site)""",
)
def threshold_sweep(spark, sf):
    sweep = statistics.threshold_sweep(v.truth(spark, sf), F.col("detected"), F.col("iou"), keys=("site",)).withColumn("f1", r6("f1"))
    best = statistics.best_param(sweep, ("site",))
    return sweep.join(best, "site").select("site", "param", "f1", r6("best_param").alias("best_param"), "best_f1")


@query(
    "ag27_mask_overlap", "chips",
    oracle="""SELECT chip_id, round(coalesce(i * 1.0 / nullif(u, 0), 0.0), 6) AS iou_benchmark, round(coalesce(i * 1.0 / nullif(u, 0), 1.0), 6) AS iou_learning FROM (
      SELECT chip_id, count(CASE WHEN a AND b THEN 1 END) AS i, count(CASE WHEN a OR b THEN 1 END) AS u FROM (
        SELECT chip_id, chip_id % 3 <> 0 AND truth_do >= 0.1 AS a, chip_id % 3 <> 0 AND b12 / b11 < 0.76 AS b FROM chips WHERE pass = 1) GROUP BY chip_id)""",
)
def mask_overlap(spark, sf):
    c = v.chips(spark, sf).where("pass = 1")
    on = F.col("chip_id") % 3 != 0
    a = c.select("chip_id", "y", "x", (on & (F.col("truth_do") >= 0.1)).alias("m"))
    b = c.select("chip_id", "y", "x", (on & (F.col("b12") / F.col("b11") < 0.76)).alias("m"))
    bench = plume.mask_overlap(a, b, ("chip_id",), 0.0).select("chip_id", r6("iou").alias("iou_benchmark"))
    learn = plume.mask_overlap(a, b, ("chip_id",), 1.0).select("chip_id", r6("iou").alias("iou_learning"))
    return bench.join(learn, "chip_id")


@query(
    "ag28_bias_rms", "chips",
    oracle="""SELECT chip_id, count(*) AS n, round(avg(d), 6) AS bias, round(sqrt(avg(d * d)), 6) AS rms FROM (
      SELECT chip_id, (0.8 - b12 / b11) * 10 - truth_do AS d, truth_do, max(truth_do) OVER (PARTITION BY chip_id) AS peak FROM chips WHERE pass = 1) WHERE peak > 0 AND truth_do >= 0.05 * peak GROUP BY chip_id""",
)
def bias_rms(spark, sf):
    c = v.chips(spark, sf).where("pass = 1").withColumn("ours", (0.8 - F.col("b12") / F.col("b11")) * 10)
    return statistics.bias_rms(c, ("chip_id",), "ours", "truth_do").select("chip_id", "n", r6("bias").alias("bias"), r6("rms").alias("rms"))


@query(
    "ag33_noise_floors", "truth",
    oracle="""SELECT site, count(*) AS n_pairs, round(avg(CAST(detected AS INTEGER)), 6) AS detect_rate, round(median(CASE WHEN detected THEN q_ours END), 6) AS floor FROM truth GROUP BY GROUPING SETS ((site), ())""",
)
def noise_floors(spark, sf):
    df = statistics.noise_floors(v.truth(spark, sf))
    return df.select("site", "n_pairs", r6("detect_rate").alias("detect_rate"), r6("floor").alias("floor"))


v.VIEW_SQL["tiles"] = ((), """SELECT l_orderkey AS k, l_linenumber AS ln, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key,
  CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS site_id, CASE WHEN l_partkey % 3 = 0 THEN 'test' WHEN l_partkey % 3 = 1 THEN 'val' ELSE 'train' END AS split,
  l_partkey % 7 = 0 AS positive, l_linenumber <> 3 AS usable, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_shipdate + INTERVAL 20 YEAR AS DATE) END AS date,
  l_orderkey % 5 <> 0 AND l_quantity > 25 AS date_confident, l_quantity AS size FROM lineitem""")


def tiles(spark, sf):
    """Chip records: one per line item with site, split, label and recovered date."""
    li = v.read(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    m = F.col("l_partkey") % 3
    dated = k % 5 != 0
    return li.select(
        k.alias("k"), F.col("l_linenumber").alias("ln"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("site_id"),
        F.when(m == 0, "test").when(m == 1, "val").otherwise("train").alias("split"), (F.col("l_partkey") % 7 == 0).alias("positive"),
        (F.col("l_linenumber") != 3).alias("usable"), F.when(dated, F.to_date(F.add_months("l_shipdate", 240))).alias("date"),
        (dated & (F.col("l_quantity") > 25)).alias("date_confident"), F.col("l_quantity").alias("size"),
    )


@query(
    "ag34_recovery_statistics", "tiles",
    oracle="""SELECT site_id, CAST(grouping(site_id) AS BIGINT) AS is_total, count(*) AS n, count(site_id) AS n_sited, count(date) AS n_dated, count(CASE WHEN sure THEN 1 END) AS n_confident,
      count(CASE WHEN CASE WHEN positive THEN sure ELSE site_id IS NOT NULL AND date IS NOT NULL END THEN 1 END) AS n_usable,
      round(coalesce(count(CASE WHEN sure AND CASE WHEN split = 'test' THEN year(date) = 2021 ELSE year(date) <= 2020 END THEN 1 END) * 1.0 / nullif(count(CASE WHEN sure THEN 1 END), 0), 0), 6) AS split_consistency
      FROM (SELECT *, site_id IS NOT NULL AND coalesce(date_confident, false) AS sure FROM tiles) GROUP BY GROUPING SETS ((site_id), ())""",
)
def recovery_statistics(spark, sf):
    df = folds.recovery_statistics(tiles(spark, sf))
    return df.select("site_id", F.col("is_total").cast("bigint").alias("is_total"), "n", "n_sited", "n_dated", "n_confident", "n_usable", r6("split_consistency").alias("split_consistency"))


@query(
    "ag36_distribution_summary", "truth",
    oracle="""
    WITH s AS (SELECT site, min(q_ours) AS lo, max(q_ours) AS hi, count(*) AS n FROM truth GROUP BY site),
    b AS (SELECT t.site, least(23, CAST(floor((q_ours - lo) / ((hi - lo) / 24.0)) AS INTEGER)) AS bin FROM truth t JOIN s USING (site)),
    h AS (SELECT s.site, i.bin, count(b.bin) AS k FROM s CROSS JOIN (SELECT unnest(range(24)) AS bin) i LEFT JOIN b ON b.site = s.site AND b.bin = i.bin GROUP BY ALL),
    p AS (SELECT site, quantile_cont(q_ours, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, stddev_pop(q_ours) AS std FROM truth GROUP BY site)
    SELECT p.site, round(q[1], 6) AS p05, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p95, round(std, 6) AS std, string_agg(CAST(k AS VARCHAR), ',' ORDER BY bin) AS histogram
    FROM p JOIN h USING (site) GROUP BY ALL""",
)
def distribution_summary(spark, sf):
    t = v.truth(spark, sf)
    s = statistics.distribution_summary(t, ("site",), "q_ours")
    h = statistics.histogram(t, ("site",), "q_ours").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["n"].cast("string")), ",")
    return s.join(h, "site").select("site", *[r6(c).alias(c) for c in ("p05", "p25", "p50", "p75", "p95", "std")], text.alias("histogram"))


@query(
    "ag37_site_centroids", "dets",
    oracle="""SELECT det_id // 25 AS site_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) AS n FROM dets GROUP BY 1""",
)
def site_centroids(spark, sf):
    return v.dets(spark, sf).groupBy(F.expr("det_id div 25").alias("site_id")).agg(
        r6(F.avg("lon")).alias("lon"), r6(F.avg("lat")).alias("lat"), F.count("*").alias("n")
    )


@query(
    "ag39_hot_summary", "truth",
    oracle="""SELECT site, count(*) AS n_products, count(CASE WHEN h > 0 THEN 1 END) AS products_fired, CAST(sum(h) AS BIGINT) AS total_hot FROM (
      SELECT site, id // 3 AS product, max(n_hot) AS h FROM truth GROUP BY ALL) GROUP BY site""",
)
def hot_summary(spark, sf):
    per = v.truth(spark, sf).groupBy("site", F.expr("id div 3").alias("product")).agg(F.max("n_hot").alias("h"))
    return per.groupBy("site").agg(F.count("*").alias("n_products"), F.count_if(F.col("h") > 0).alias("products_fired"), F.sum("h").alias("total_hot"))


@query(
    "ag40_fold_summaries", "tiles",
    oracle="""
    WITH f AS (SELECT k % 5 AS fold, 'S' || CAST(ln * 1000 + k % 777 AS VARCHAR) AS scene_id, positive, size FROM tiles),
    m AS (SELECT fold, avg(size) AS metric, count(CASE WHEN positive THEN 1 END) AS n_pos FROM f GROUP BY fold), s AS (SELECT scene_id, count(DISTINCT fold) AS k FROM f GROUP BY scene_id)
    SELECT round((SELECT avg(metric) FROM m), 6) AS mean_metric, (SELECT count(*) FROM s) AS n_scenes, (SELECT count(CASE WHEN k > 1 THEN 1 END) FROM s) AS n_shared""",
)
def fold_summaries(spark, sf):
    f = tiles(spark, sf).select((F.col("k") % 5).alias("fold"), F.concat(F.lit("S"), (F.col("ln") * 1000 + F.col("k") % 777).cast("string")).alias("scene_id"), "size")
    mean = f.groupBy("fold").agg(F.avg("size").alias("metric")).agg(r6(F.avg("metric")).alias("mean_metric"))
    return with_single_row(mean, folds.fold_sharing(f))


@query(
    "ag41_dataset_inventory", "tiles",
    oracle="""
    SELECT 'split' AS kind, split AS name, count(*) AS n, count(CASE WHEN positive THEN 1 END) AS n_pos, min(size) AS lo, max(size) AS hi, NULL AS looks_binary FROM tiles GROUP BY GROUPING SETS ((split), ())
    UNION ALL SELECT 'signature', regexp_replace(path, '[0-9]+', '#', 'g'), count(*), NULL, min(v), max(v), count(CASE WHEN v NOT IN (0, 1) THEN 1 END) = 0 FROM (
      SELECT split || CASE WHEN ln % 2 = 0 THEN '/label/' ELSE '/image/' END || k || '.npy' AS path, CASE WHEN ln % 2 = 0 THEN CAST(positive AS DOUBLE) ELSE size END AS v FROM tiles) GROUP BY 2""",
)
def dataset_inventory(spark, sf):
    t = tiles(spark, sf)
    s = folds.split_inventory(t).select(F.lit("split").alias("kind"), F.col("split").alias("name"), "n", "n_pos", F.col("min_size").alias("lo"), F.col("max_size").alias("hi"), F.lit(None).cast("boolean").alias("looks_binary"))
    label = F.col("ln") % 2 == 0
    vals = t.select(F.concat("split", F.when(label, "/label/").otherwise("/image/"), F.col("k").cast("string"), F.lit(".npy")).alias("path"),
                    F.when(label, F.col("positive").cast("double")).otherwise(F.col("size")).alias("value"))
    g = folds.signature_inventory(vals).select(F.lit("signature").alias("kind"), F.col("signature").alias("name"), "n", F.lit(None).cast("bigint").alias("n_pos"), "lo", "hi", "looks_binary")
    return s.unionByName(g)


@query(
    "wn04_representative_rows", "truth",
    oracle="""
    WITH r AS (SELECT site AS region, part_no % 20 AS id_source, id AS id_plume, q_ours / 100.0 AS t_h FROM truth),
    s AS (SELECT region, id_source, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, id_source) AS source_rank FROM r GROUP BY region, id_source),
    u AS (SELECT r.* FROM r JOIN s USING (region, id_source) WHERE source_rank <= 3), m AS (SELECT id_source, median(t_h) AS med FROM u GROUP BY id_source)
    SELECT region, id_source, id_plume, row_rank FROM (SELECT u.*, row_number() OVER (PARTITION BY region, id_source ORDER BY abs(t_h - med), id_plume) AS row_rank FROM u JOIN m USING (id_source)) WHERE row_rank <= 2""",
)
def representative_rows(spark, sf):
    r = v.truth(spark, sf).select(F.col("site").alias("region"), (F.col("part_no") % 20).alias("id_source"), F.col("id").alias("id_plume"), (F.col("q_ours") / 100.0).alias("t_h"))
    df = folds.representative_rows(r, 2, 3)
    return df.select("region", "id_source", "id_plume", F.col("row_rank").cast("bigint").alias("row_rank"))


@query(
    "wn05_fold_assignment", "tiles",
    oracle="""SELECT site_id, size, (row_number() OVER (ORDER BY size DESC, site_id) - 1) % 5 AS fold FROM (SELECT site_id, count(*) AS size FROM tiles WHERE site_id IS NOT NULL GROUP BY site_id)""",
)
def fold_assignment(spark, sf):
    return folds.size_ordered_folds(tiles(spark, sf).where("site_id IS NOT NULL"), "site_id")


@query(
    "wn06_negative_sampling", "tiles",
    oracle="""
    WITH u AS (SELECT * FROM tiles WHERE usable AND site_id IS NOT NULL), q AS (SELECT site_id, greatest(round_even(count(CASE WHEN positive THEN 1 END) * 2.0, 0), 25) AS quota FROM u GROUP BY site_id),
    n AS (SELECT u.*, quota, row_number() OVER (PARTITION BY site_id ORDER BY substr(md5('0|' || key), 1, 13), key) AS i FROM u JOIN q USING (site_id) WHERE NOT positive)
    SELECT site_id, count(*) AS n, count(CASE WHEN positive THEN 1 END) AS n_pos, CAST(sum(length(key)) AS BIGINT) AS key_length, max(key) AS last_key FROM (
      SELECT key, site_id, positive FROM u WHERE positive UNION ALL SELECT key, site_id, positive FROM n WHERE i <= quota) GROUP BY site_id""",
)
def negative_sampling(spark, sf):
    df = folds.sample_negatives(tiles(spark, sf))
    return df.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if("positive").alias("n_pos"), F.sum(F.length("key")).cast("bigint").alias("key_length"), F.max("key").alias("last_key"))


@query(
    "me09_event_gate", "truth",
    oracle="""SELECT site, round(q, 6) AS q_mean, CASE WHEN abs(q - p) <= 0.5 * p AND abs(q - p) <= s + 300 THEN 'PASS' WHEN abs(q - p) <= s + 300 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM (
      SELECT site, avg(q_ours) AS q, 900.0 + 100.0 * (CAST(substr(site, 7) AS INTEGER) % 14) AS p, avg(sigma) / 2.0 AS s FROM truth GROUP BY site)""",
)
def event_gate(spark, sf):
    t = v.truth(spark, sf)
    ref = 900.0 + 100.0 * (F.substring("site", 7, 4).cast("int") % 14)
    rows = t.select("site", "q_ours", (F.col("sigma") / 2.0).alias("sigma"), ref.alias("q_ref"), F.lit(300.0).alias("sigma_ref"))
    return statistics.event_gate(rows, ("site",)).select("site", r6("q_mean").alias("q_mean"), "verdict")
