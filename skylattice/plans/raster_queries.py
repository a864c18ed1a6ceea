"""Neighbourhood operators on chips."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.quantiles import chip_spread
from skylattice.operators import morphology as mo
from skylattice.operators import plume, retrieval
from skylattice.plans import views as v
from skylattice.plans.raster_sql import labels_sql, opening_sql, plume_sql, select_sql
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6

CHIP = ("chip_id",)

# A blob with ragged edges and loose pixels, from the plume-carrying pass: mean B11 above 0.234, judged on whole sums.
v.VIEW_SQL["blob"] = (("chip_sums",), "SELECT chip_id, y, x FROM chip_sums WHERE pass = 1 AND (truth_do >= 0.15 OR s > 234000 * n)")
v.VIEW_SQL["field"] = (("chips",), "SELECT chip_id, y, x, 0.8 - b12 / b11 AS value FROM chips WHERE pass = 1")
v.VIEW_SQL["sources"] = (("chips",), "SELECT DISTINCT chip_id, CAST(8 AS BIGINT) AS sy, CAST(CASE WHEN chip_id % 3 = 0 THEN 1 ELSE 6 END AS BIGINT) AS sx FROM chips")


def blob(spark, sf):
    c = v.chip_sums(spark, sf).where("pass = 1")
    return c.where((F.col("truth_do") >= 0.15) | (F.col("s") > 234_000 * F.col("n"))).select("chip_id", "y", "x")


def field(spark, sf):
    return v.chips(spark, sf).where("pass = 1").select("chip_id", "y", "x", (F.lit(0.8) - F.col("b12") / F.col("b11")).alias("value"))


def sources(spark, sf):
    # the numbers alone: the pixels of the chips need not be gathered for them
    ids = v.read(spark, sf, "lineitem").select(F.expr("l_suppkey div 4").alias("chip_id")).distinct()
    return ids.select("chip_id", F.lit(8).cast("bigint").alias("source_y"), F.when(F.col("chip_id") % 3 == 0, 1).otherwise(6).cast("bigint").alias("source_x"))


@query("nb01_binary_opening", "blob", oracle=f"WITH {opening_sql('blob', 'op')} SELECT chip_id, y, x FROM op")
def binary_opening(spark, sf):
    return mo.opening(blob(spark, sf), CHIP)


@query(
    "nb02_components", "blob",
    oracle=f"WITH RECURSIVE {labels_sql('blob', 'lb')} SELECT chip_id, label, count(*) AS size FROM lb GROUP BY ALL HAVING count(*) >= 3",
)
def components(spark, sf):
    lab = mo.label_components(blob(spark, sf), CHIP, block=8)
    return lab.groupBy("chip_id", "label").agg(F.count("*").alias("size")).where("size >= 3")


@query(
    "nb03_dilation_ring", "blob", "chips",
    oracle="""SELECT DISTINCT c.chip_id, c.y, c.x FROM chips c JOIN blob b ON b.chip_id = c.chip_id AND abs(c.y - b.y) <= 2 AND abs(c.x - b.x) <= 2
      WHERE c.pass = 1 AND NOT EXISTS (SELECT 1 FROM blob m WHERE m.chip_id = c.chip_id AND m.y = c.y AND m.x = c.x)""",
)
def dilation_ring(spark, sf):
    grid = v.chips(spark, sf).where("pass = 1")
    return mo.ring(blob(spark, sf), CHIP, 2, grid)


@query(
    "nb04_component_selection", "blob", "field", "sources",
    oracle=f"""WITH RECURSIVE kb AS (SELECT *, 2.0 AS k FROM blob), {labels_sql('kb', 'lb', 'chip_id, k')}, {select_sql('lb', 'field', 'sel', source='sources')}
      SELECT chip_id, label, count(*) AS size FROM sel GROUP BY ALL""",
)
def component_selection(spark, sf):
    b = blob(spark, sf).withColumn("k", F.lit(2.0))
    lab = mo.label_components(b, ("chip_id", "k")).join(field(spark, sf), ["chip_id", "y", "x"])
    sel = plume.select_components(lab, CHIP, sources(spark, sf))
    return sel.groupBy("chip_id", "label").agg(F.count("*").alias("size"))


@query("nb05_plume_detection", "field", "sources", oracle=f"WITH RECURSIVE {plume_sql('field', 'pl', '1.5, 2.0, 3.0', source='sources')} SELECT chip_id, k, y, x, label FROM pl")
def plume_detection(spark, sf):
    return plume.detect_plumes(field(spark, sf), CHIP, ks=(1.5, 2.0, 3.0), sources=sources(spark, sf))


_HOT = """coalesce((b12 * CASE WHEN s = 'A' THEN 85.25 ELSE 87.75 END > b11 * CASE WHEN s = 'A' THEN 245.59 ELSE 247.08 END
  OR b11 * CASE WHEN s = 'A' THEN 245.59 ELSE 247.08 END > b8a * CASE WHEN s = 'A' THEN 955.19 ELSE 953.93 END) AND b12 >= 0.01 AND b8a >= 0 AND b11 >= 0, false)"""


@query(
    "nb06_flare_mask", "chips",
    oracle=f"""WITH h AS (SELECT chip_id, pass, y, x, {_HOT} AS hot FROM (SELECT *, CASE WHEN chip_id % 2 = 0 THEN 'A' ELSE 'B' END AS s FROM chips)),
      g AS (SELECT DISTINCT h.chip_id, h.pass, h.y, h.x FROM h JOIN h o ON o.chip_id = h.chip_id AND o.pass = h.pass AND abs(o.y - h.y) <= 1 AND abs(o.x - h.x) <= 1 AND o.hot)
      SELECT h.chip_id, h.pass, count(CASE WHEN hot THEN 1 END) AS n_hot, count(g.y) AS n_excluded FROM h LEFT JOIN g USING (chip_id, pass, y, x) GROUP BY ALL""",
)
def flare_mask(spark, sf):
    keys = ["chip_id", "pass"]
    c = v.chips(spark, sf)
    craft = F.when(F.col("chip_id") % 2 == 0, "Sentinel-2A").otherwise("Sentinel-2B")
    tagged = c.select(*keys, "y", "x", retrieval.hot_pixel(craft, F.col("b8a"), F.col("b11"), F.col("b12")).alias("hot"))
    grown = mo.dilate(tagged.where("hot"), keys, 1).withColumn("grown", F.lit(1))
    out = tagged.join(grown, [*keys, "y", "x"], "left")
    return out.groupBy(*keys).agg(F.count_if("hot").alias("n_hot"), F.count("grown").alias("n_excluded"))


@query(
    "nb07_focal_median", "chips",
    oracle="""SELECT a.chip_id, a.y, a.x, round(median(b.b11 / 0.9973), 6) AS value FROM chips a JOIN chips b ON a.chip_id = b.chip_id AND b.pass = 0 AND pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 6.25 WHERE a.pass = 0 GROUP BY ALL""",
)
def focal_median(spark, sf):
    c = v.chips(spark, sf).where("pass = 0").select("chip_id", "y", "x", (F.col("b11") / 0.9973).alias("value"))
    return mo.focal_median(c, CHIP, 2.5).select("chip_id", "y", "x", r6("value").alias("value"))


@query(
    "nb08_mask_outline", "blob",
    oracle=f"""WITH RECURSIVE {labels_sql('blob', 'lb')},
      e AS (SELECT chip_id, label, y, x, unnest([[y - 1, x], [y + 1, x], [y, x - 1], [y, x + 1]]) AS n FROM lb),
      o AS (SELECT e.* FROM e LEFT JOIN blob b ON b.chip_id = e.chip_id AND b.y = n[1] AND b.x = n[2] WHERE b.y IS NULL)
      SELECT l.chip_id, l.label, CAST(l.n AS DOUBLE) AS area_px, CAST(o.n AS DOUBLE) AS perimeter FROM (SELECT chip_id, label, count(*) AS n FROM lb GROUP BY ALL) l JOIN (SELECT chip_id, label, count(*) AS n FROM o GROUP BY ALL) o USING (chip_id, label)""",
)
def mask_outline(spark, sf):
    lab = mo.label_components(blob(spark, sf), CHIP)
    rings = mo.outline_rings(lab, CHIP, 0.0, 0.0, 1.0, 1.0)
    n = F.size("points")
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.abs(F.get("points", i)["lon"] - F.get("points", i + 1)["lon"]) + F.abs(F.get("points", i)["lat"] - F.get("points", i + 1)["lat"]))
    length = F.aggregate(steps, F.lit(0.0), lambda a, b: a + b)
    return rings.groupBy("chip_id", "label").agg(F.sum("area_px").alias("area_px"), F.sum(length).alias("perimeter"))


@query(
    "nb09_reflect_pad", "chips",
    oracle="""WITH g AS (SELECT i AS py, CASE WHEN i % 30 < 16 THEN i % 30 ELSE 30 - i % 30 END AS y FROM (SELECT unnest(range(32)) AS i)), h AS (SELECT py AS px_, y AS x FROM g)
      SELECT chip_id, count(*) AS n, round(sum(b11 * (py * 32 + px_)), 3) AS weighted FROM chips JOIN g USING (y) JOIN h USING (x) WHERE pass = 1 GROUP BY chip_id""",
)
def reflect_pad(spark, sf):
    c = v.chips(spark, sf).where("pass = 1").select("chip_id", "y", "x", "b11")
    padded = mo.reflect_pad(c, CHIP, 16, 16, 32)
    return padded.groupBy("chip_id").agg(F.count("*").alias("n"), r6(F.sum(F.col("b11") * (F.col("y") * 32 + F.col("x"))), 3).alias("weighted"))


@query(
    "nb10_eight_ways", "chips",
    oracle="""SELECT chip_id, k, round(sum(b11 * (CASE k % 4 WHEN 0 THEN y WHEN 1 THEN 15 - x WHEN 2 THEN 15 - y ELSE x END)), 4) AS wy,
      round(sum(b11 * CASE WHEN k >= 4 THEN 15 - c ELSE c END), 4) AS wx FROM (
        SELECT *, CASE k % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 15 - x ELSE 15 - y END AS c FROM chips CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS k) WHERE pass = 1) GROUP BY ALL""",
)
def eight_ways(spark, sf):
    c = v.chips(spark, sf).where("pass = 1").select("chip_id", "y", "x", "b11")
    e = mo.eight_ways(c, 16)
    return e.groupBy("chip_id", "k").agg(r6(F.sum(F.col("b11") * F.col("y")), 4).alias("wy"), r6(F.sum(F.col("b11") * F.col("x")), 4).alias("wx"))


@query(
    "nb11_block_fingerprint", "chips",
    oracle="""WITH b AS (SELECT chip_id, y // 3 AS y, x // 3 AS x, avg(b11) AS value FROM chips WHERE pass = 0 AND y < 15 AND x < 15 GROUP BY ALL),
      m AS (SELECT chip_id, median(value) AS med FROM b GROUP BY chip_id), s AS (SELECT chip_id, any_value(med) AS med, 1.4826 * median(abs(value - med)) + 1e-6 AS sc FROM b JOIN m USING (chip_id) GROUP BY chip_id)
      SELECT chip_id, y, x, round((value - med) / sc, 5) AS value FROM b JOIN s USING (chip_id)""",
)
def block_fingerprint(spark, sf):
    c = v.chips(spark, sf).where("pass = 0").select("chip_id", "y", "x", F.col("b11").alias("value"))
    b = mo.block_means(c, CHIP, 16, 16, 3)
    s = chip_spread(b, CHIP, "value")
    return b.join(s, "chip_id").select("chip_id", "y", "x", r6((F.col("value") - F.col("median")) / (F.col("sigma") + 1e-6), 5).alias("value"))


@query(
    "nb11_nearest_resize", "chips",
    oracle="""SELECT chip_id, i AS y, j AS x, round(b11, 6) AS value FROM chips JOIN (SELECT i, least(15, i * 16 // 10) AS y FROM (SELECT unnest(range(10)) AS i)) USING (y) JOIN (SELECT j, least(15, j * 16 // 24) AS x FROM (SELECT unnest(range(24)) AS j)) USING (x) WHERE pass = 0""",
)
def nearest_resize(spark, sf):
    c = v.chips(spark, sf).where("pass = 0").select("chip_id", "y", "x", "b11")
    return mo.resize_nearest(c, 16, 16, 10, 24).select("chip_id", "y", "x", r6("b11").alias("value"))


def _template_pairs(spark, sf):
    c = v.chips(spark, sf)
    ref = mo.pack(c.where("pass = 0"), ("chip_id",), ("b11",), 16, 16).select(F.col("chip_id").alias("ref_id"), F.col("b11").cast("array<double>").alias("ref"))
    cut = c.where("pass = 0 AND y BETWEEN 3 AND 10 AND x BETWEEN 5 AND 13").select("chip_id", (F.col("y") - 3).alias("y"), (F.col("x") - 5).alias("x"), "b11")
    tmpl = mo.pack(cut, ("chip_id",), ("b11",), 8, 9).select(F.col("chip_id").alias("template_id"), F.col("b11").cast("array<double>").alias("tmpl"))
    near = tmpl.withColumn("ref_id", F.explode(F.array(*[F.col("template_id") + i for i in (-1, 0, 1)])))
    return near.join(ref, "ref_id").select(
        "template_id", "ref_id", "tmpl", F.lit(8).alias("t_h"), F.lit(9).alias("t_w"), "ref", F.lit(16).alias("ref_h"), F.lit(16).alias("ref_w")
    )


PLACES_SQL = """WITH c AS (SELECT chip_id, y, x, CAST(CAST(b11 AS FLOAT) AS DOUBLE) AS v FROM chips WHERE pass = 0),
t AS (SELECT chip_id, y - 3 AS ty, x - 5 AS tx, v FROM c WHERE y BETWEEN 3 AND 10 AND x BETWEEN 5 AND 13 AND v IS NOT NULL),
size AS (SELECT chip_id, count(*) AS n FROM t GROUP BY 1),
places AS (SELECT t.chip_id AS template_id, r.chip_id AS ref_id, r.y - ty AS y, r.x - tx AS x, round(corr(r.v, t.v), 9) AS peak
FROM (SELECT *, unnest([chip_id - 1, chip_id, chip_id + 1]) AS ref_id FROM t) t JOIN c r ON r.chip_id = t.ref_id AND r.v IS NOT NULL
WHERE r.y - ty BETWEEN 0 AND 8 AND r.x - tx BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4
HAVING var_pop(r.v) > 1e-12 AND var_pop(t.v) > 1e-12 AND 2 * count(*) >= (SELECT n FROM size WHERE size.chip_id = t.chip_id)) """


@query(
    "nb12_template_match", "chips",
    oracle=PLACES_SQL + """SELECT template_id, ref_id AS best_ref, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM places
QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY peak DESC, ref_id, places.y, places.x) = 1""",
)
def template_match(spark, sf):
    m = mo.template_match(_template_pairs(spark, sf)).where("peak IS NOT NULL")
    best = F.min(F.struct((-F.col("peak")).alias("p"), "ref_id", "y", "x")).alias("b")
    return m.groupBy("template_id").agg(best).select("template_id", F.col("b.ref_id").alias("best_ref"), "b.y", "b.x")


@query(
    "nb12_template_peaks", "chips",
    oracle=PLACES_SQL + """SELECT template_id, ref_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(places.peak, 6) AS peak FROM places
QUALIFY row_number() OVER (PARTITION BY template_id, ref_id ORDER BY places.peak DESC, places.y, places.x) = 1""",
)
def template_peaks(spark, sf):
    m = mo.template_match(_template_pairs(spark, sf)).where("peak IS NOT NULL")
    return m.select("template_id", "ref_id", "y", "x", r6("peak").alias("peak"))
