"""Model preparation, scoring, evaluation and embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import emission, folds, learning, lookups, vectors
from skylattice.operators.composites import latest_mosaic
from skylattice.operators.scene_choice import pick_reference
from skylattice.plans import views as v
from skylattice.plans.methane_queries import chip_scenes, chip_sites
from skylattice.plans.raster_sql import labels_sql, retrieval_sql
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6
from skylattice.plans.scene_queries import _PAIRS

CHIP = ("chip_id",)
WEIGHTS, BIAS = [-0.5, -0.25, -0.125, 0.0625, 0.0], -1.5

v.VIEW_SQL["rawpass"] = (("chips",), "SELECT chip_id, pass, y, x, b11, b12, false AS excl FROM chips")
_CH = f"""{retrieval_sql('rawpass', 'rt', 'chip_id, pass', False)},
 ch AS (SELECT t.chip_id, t.y, t.x, t.delta_r - r.delta_r AS mbmp_delta_r, t.delta_r AS mbsp_delta_r, t.b12 / t.b11 AS ratio_b12_b11, t.b12, t.b11
   FROM (SELECT * FROM rt WHERE pass = 1) t LEFT JOIN (SELECT * FROM rt WHERE pass = 0) r USING (chip_id, y, x))"""
_STATS = """
 lg AS (UNPIVOT ch ON mbmp_delta_r, mbsp_delta_r, ratio_b12_b11, b12, b11 INTO NAME channel VALUE v),
 pk AS (SELECT * FROM lg WHERE v IS NOT NULL),
 md AS (SELECT channel, median(v) AS med FROM pk GROUP BY channel), st AS (SELECT channel, any_value(med) AS med, median(abs(v - med)) AS mad, count(*) AS n FROM pk JOIN md USING (channel) GROUP BY channel)"""
_Z = """
 w AS (SELECT """ + ", ".join(f"max(CASE WHEN channel = '{c}' THEN med END) AS m_{c}, max(CASE WHEN channel = '{c}' THEN mad END) AS s_{c}" for c in learning.CHANNELS) + """ FROM st),
 z AS (SELECT chip_id, y, x, """ + ", ".join(f"coalesce(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN 1.4826 * s_{c} ELSE 1 END, 0) AS {c}" for c in learning.CHANNELS) + """ FROM ch, w)"""
_PROB = f"""
 pr AS (SELECT chip_id, y, x, 1.0 / (1.0 + exp(-({BIAS} {" ".join(f"{w:+} * {c}" for w, c in zip(WEIGHTS, learning.CHANNELS, strict=True))}))) AS prob FROM z)"""


def channels(spark, sf):
    c = v.chips(spark, sf)
    return learning.build_channels(c.where("pass = 1"), c.where("pass = 0"), CHIP)


def channel_stats(spark, sf):
    return folds.channel_statistics(channels(spark, sf), list(learning.CHANNELS))


def probabilities(spark, sf):
    """A probability table: a logistic curve over the normalised channels."""
    z = learning.normalise(channels(spark, sf), channel_stats(spark, sf))
    logit = F.lit(BIAS)
    for weight, c in zip(WEIGHTS, learning.CHANNELS, strict=True):
        logit = logit + F.lit(weight) * F.col(c)
    return z.select("chip_id", "y", "x", (1.0 / (1.0 + F.exp(-logit))).alias("prob"))


@query("ag32_channel_statistics", "rawpass", oracle=f"WITH {_CH}, {_STATS} SELECT channel, round(med, 6) AS median, round(mad, 6) AS mad, n FROM st")
def channel_statistics(spark, sf):
    return channel_stats(spark, sf).select("channel", r6("median").alias("median"), r6("mad").alias("mad"), "n")


@query(
    "ml01_channels", "rawpass",
    oracle=f"WITH {_CH} SELECT chip_id, y, x, round(mbmp_delta_r, 6) AS mbmp_delta_r, round(mbsp_delta_r, 6) AS mbsp_delta_r, round(ratio_b12_b11, 6) AS ratio_b12_b11 FROM ch",
)
def model_channels(spark, sf):
    return channels(spark, sf).select("chip_id", "y", "x", *[r6(c).alias(c) for c in ("mbmp_delta_r", "mbsp_delta_r", "ratio_b12_b11")])


@query("ml02_normalised_channels", "rawpass", oracle=f"WITH {_CH}, {_STATS}, {_Z} SELECT chip_id, y, x, " + ", ".join(f"round({c}, 5) AS {c}" for c in learning.CHANNELS) + " FROM z")
def normalised_channels(spark, sf):
    z = learning.normalise(channels(spark, sf), channel_stats(spark, sf))
    return z.select("chip_id", "y", "x", *[r6(c, 5).alias(c) for c in learning.CHANNELS])


@query(
    "ml04_candidates", "rawpass",
    oracle=f"WITH RECURSIVE {_CH}, {_STATS}, {_Z}, {_PROB}, hp AS (SELECT * FROM pr WHERE prob >= 0.6), {labels_sql('hp', 'lb')} SELECT chip_id, label, count(*) AS n_px, round(avg(prob), 4) AS mean_prob, round(max(prob), 4) AS score FROM lb JOIN hp USING (chip_id, y, x) GROUP BY ALL HAVING count(*) >= 5",
)
def model_candidates(spark, sf):
    c = learning.candidates(probabilities(spark, sf), CHIP, 0.6)
    return c.select("chip_id", "label", "n_px", r6("mean_prob", 4).alias("mean_prob"), r6("score", 4).alias("score")).orderBy(F.desc("score"))


def tiles(spark, sf):
    """Fingerprints of tiles: the label's direction stretched, so that tiles of one label correlate."""
    e = v.read(spark, sf, "embeddings")
    bump = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i % 10 == F.col("label"), 0.4).otherwise(0.0))
    return e.select(F.col("vec_id").alias("tile_id"), (F.col("vec_id") % 3).alias("shape"), bump.alias("v"), "label")


@query("ml07_content_clusters")
def content_clusters(spark, sf):
    t = tiles(spark, sf).drop("label")
    c = learning.content_clusters(t)
    a = learning.assign_clusters(t, c, 3).select("tile_id", F.col("cluster").alias("assigned"), r6("corr").alias("corr"))
    return c.join(a, "tile_id", "left")


_CORR = """list_sum(list_transform(range(1, 65), lambda i: (a[i] - list_avg(a)) * (b[i] - list_avg(b)))) / ((sqrt(list_sum(list_transform(a, lambda q: (q - list_avg(a)) * (q - list_avg(a))))) + 1e-9) * (sqrt(list_sum(list_transform(b, lambda q: (q - list_avg(b)) * (q - list_avg(b))))) + 1e-9))"""


@query(
    "ml07_overpass_dating",
    oracle=f"""
    WITH t AS (SELECT vec_id AS tile_id, vec_id // 5 AS site_id, CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CAST(embedding AS DOUBLE[64])::DOUBLE[] AS a FROM embeddings),
    o AS (SELECT vec_id // 5 AS site_id, DATE '2019-01-01' + CAST(vec_id * 97 % 1000 AS INTEGER) AS date, CAST(embedding AS DOUBLE[64])::DOUBLE[] AS b FROM embeddings),
    s AS (SELECT tile_id, date, {_CORR} AS corr FROM t JOIN o USING (site_id) WHERE CASE WHEN split = 'test' THEN year(date) = 2021 ELSE year(date) <= 2020 END),
    m AS (SELECT tile_id, arg_max(date, {{'c': corr, 'd': date}}) AS date, max(corr) AS c FROM s GROUP BY tile_id)
    SELECT t.tile_id, CAST(date AS VARCHAR) AS date, round(c, 5) AS date_corr, coalesce(c >= 0.5, false) AS confident FROM t LEFT JOIN m USING (tile_id)""",
)
def overpass_dating(spark, sf):
    e = v.read(spark, sf, "embeddings")
    k = F.col("vec_id")
    t = e.select(k.alias("tile_id"), F.expr("vec_id div 5").alias("site_id"), F.when(k % 4 == 0, "test").otherwise("train").alias("split"), F.col("embedding").alias("v"))
    o = e.select(F.expr("vec_id div 5").alias("site_id"), F.date_add(F.lit("2019-01-01").cast("date"), (k * 97 % 1000).cast("int")).alias("date"), F.col("embedding").alias("o"))
    d = learning.best_overpass(t, o, 0.5)
    return d.select("tile_id", F.col("date").cast("string").alias("date"), r6("date_corr", 5).alias("date_corr"), "confident")


@query(
    "ml08_export_manifest", "scenes",
    oracle=f"""WITH {_PAIRS}, s AS (SELECT scene_no AS key, strftime(ts, '%Y%m%dT%H%M%S') AS datatake, CASE WHEN scene_no % 5 = 0 THEN 'T99XXX' ELSE 'T' || CAST(scene_no % 3 + 38 AS VARCHAR) || 'RUN' END AS tile FROM scenes WHERE scene_no % 4 <> 0),
      f AS (SELECT s.key, c.scene_id, c.scene_no FROM s LEFT JOIN scenes c ON starts_with(c.scene_id, datatake) AND contains(c.scene_id, '_' || tile))
      SELECT key, scene_id, ref_id, CASE WHEN scene_id IS NULL THEN 'no_scene' WHEN ref_id IS NULL THEN 'no_reference' WHEN scene_no % 9 = 0 THEN 'sparse' ELSE 'ok' END AS status FROM f LEFT JOIN (SELECT target_id, ref_id FROM ranked WHERE rank = 1) r ON r.target_id = scene_id""",
)
def export_manifest(spark, sf):
    s = v.scenes(spark, sf)
    n = F.col("scene_no")
    samples = s.select(
        n.alias("key"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("datatake"),
        F.when(n % 5 == 0, "T99XXX").otherwise(F.concat(F.lit("T"), (n % 3 + 38).cast("string"), F.lit("RUN"))).alias("tile"),
    )
    refs = pick_reference(s, s).select("scene_id", F.col("reference.scene_id").alias("ref_id"))
    valid = s.select("scene_id", (n % 9 != 0).alias("valid"))
    done = s.where(n % 4 == 0).select(n.alias("key"))
    return learning.export_manifest(samples, s, refs, valid, done)


_F1 = "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query(
    "ml09_fold_evaluation", "truth",
    oracle=f"""
    WITH r AS (SELECT id % 5 AS fold, unnest(CASE WHEN id % 3 <> 0 THEN ['all', 'primary'] ELSE ['all'] END) AS truth_set, detected AS t, iou AS score, 1.0 + id % 14 * 0.25 AS k_max FROM truth),
    m AS (SELECT fold, truth_set, count(CASE WHEN t AND score >= 0.5 THEN 1 END) AS tp, count(CASE WHEN NOT t AND score >= 0.5 THEN 1 END) AS fp, count(CASE WHEN t AND score < 0.5 THEN 1 END) AS fn FROM r GROUP BY ALL),
    b AS (SELECT fold, truth_set, k, count(CASE WHEN t AND k_max >= k THEN 1 END) AS tp, count(CASE WHEN NOT t AND k_max >= k THEN 1 END) AS fp, count(CASE WHEN t AND k_max < k THEN 1 END) AS fn FROM r CROSS JOIN (SELECT 1.0 + unnest(range(13)) * 0.25 AS k) GROUP BY ALL),
    bf AS (SELECT fold, truth_set, k, {_F1} AS f1 FROM b)
    SELECT fold, truth_set, round({_F1}, 6) AS model_f1, round(max(CASE WHEN k = 2.0 THEN f1 END), 6) AS baseline_f1, round(max(f1), 6) AS baseline_best_f1 FROM m JOIN bf USING (fold, truth_set) GROUP BY fold, truth_set, tp, fp, fn""",
)
def fold_evaluation(spark, sf):
    t = v.truth(spark, sf)
    rows = t.select((F.col("id") % 5).alias("fold"), F.col("detected").alias("truth"), (F.col("id") % 3 != 0).alias("primary"), F.col("iou").alias("score"), (1.0 + F.col("id") % 14 * 0.25).alias("k_max"))
    d = learning.evaluate_folds(rows)
    return d.select("fold", "truth_set", *[r6(c).alias(c) for c in ("model_f1", "baseline_f1", "baseline_best_f1")])


def mosaic(spark, sf):
    return latest_mosaic(v.vectors(spark, sf), ("pixel_id", "year"), "embedding", ("zone", "vec_id")).withColumn("year", F.col("year").cast("bigint"))


_MOS = "mos AS (SELECT pixel_id, year, arg_max(embedding, zone) AS e FROM vectors GROUP BY ALL)"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


@query("em01_seed_vectors", "vectors", oracle=f"WITH {_MOS} SELECT pixel_id, year, len(e) AS n, round(CAST(e[1] AS DOUBLE), 4) AS first, round({_DOT.format(a='e', b='e')}, 4) AS norm FROM mos WHERE pixel_id % 2 = year % 2")
def seed_vectors(spark, sf):
    m = mosaic(spark, sf)
    pts = m.where("pixel_id % 2 = year % 2").select("pixel_id", "year")
    s = vectors.seed_at(m, pts)
    return s.select("pixel_id", "year", F.size("seed").cast("bigint").alias("n"), r6(F.col("seed")[0].cast("double"), 4).alias("first"), r6(learning.dot("seed", "seed"), 4).alias("norm"))


_SEED = "sd AS (SELECT e AS s FROM mos WHERE pixel_id = 0 AND year = 2020)"


def _seed(spark, sf):
    m = mosaic(spark, sf)
    return m, m.where("pixel_id = 0 AND year = 2020").select(F.col("embedding").alias("seed"))


@query("em02_similarity", "vectors", oracle=f"WITH {_MOS}, {_SEED} SELECT pixel_id, year, round({_DOT.format(a='e', b='s')}, 4) AS similarity FROM mos, sd")
def similarity(spark, sf):
    m, seed = _seed(spark, sf)
    return vectors.similarity(m, seed).select("pixel_id", "year", r6("similarity", 4).alias("similarity"))


@query("em02_most_similar", "vectors", oracle=f"WITH {_MOS}, {_SEED} SELECT pixel_id, round(sim, 4) AS similarity FROM (SELECT pixel_id, {_DOT.format(a='e', b='s')} AS sim FROM mos, sd WHERE year = 2020) ORDER BY sim DESC, pixel_id LIMIT 10")
def most_similar(spark, sf):
    m, seed = _seed(spark, sf)
    return vectors.most_similar(m.where("year = 2020"), seed, 10).select("pixel_id", r6("similarity", 4).alias("similarity"))


@query("em03_yearly_change", "vectors", oracle=f"WITH {_MOS} SELECT a.pixel_id, round(1.0 - {_DOT.format(a='a.e', b='b.e')}, 4) AS change FROM mos a JOIN mos b ON a.pixel_id = b.pixel_id AND a.year = 2020 AND b.year = 2021")
def yearly_change(spark, sf):
    return vectors.change(mosaic(spark, sf), 2020, 2021).select("pixel_id", r6("change", 4).alias("change"))


@query("em04_vector_clusters")
def vector_clusters(spark, sf):
    return vectors.cluster(mosaic(spark, sf), 10).select("pixel_id", "year", "cluster")
