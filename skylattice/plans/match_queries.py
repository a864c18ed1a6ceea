"""Cross-matches, de-duplication and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.inversion import invert_signal
from skylattice.operators import lookups, matching, series
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6

_KM = """(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
  + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"""


def km_sql(a: str, b: str) -> str:
    return _KM.format(a=a, b=b)


@query(
    "jn09_event_match", "dets", "refs",
    oracle=f"""
    WITH p AS (SELECT d.det_id, r.event_id, abs(epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 AS dt FROM dets d JOIN refs r
      ON abs(d.lat - r.lat) < 0.2 AND {km_sql('d', 'r')} <= 15 WHERE abs(epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 <= 60),
    h AS (SELECT det_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids, bool_or(dt <= 14) AS sure FROM p GROUP BY det_id)
    SELECT d.det_id, CASE WHEN sure THEN 'confirmed' WHEN sure IS NOT NULL THEN 'plausible' ELSE 'unvalidated' END AS verdict, coalesce(ids, '') AS event_ids
    FROM dets d LEFT JOIN h USING (det_id)""",
)
def event_match(spark, sf):
    df = matching.match_events(v.dets(spark, sf), v.refs(spark, sf))
    return df.select("det_id", "verdict", F.array_join(F.col("event_ids").cast("array<string>"), ",").alias("event_ids"))


_PLUME_PAIRS = f"""p AS (SELECT d.det_id, r.event_id, {km_sql('d', 'r')} AS km, (epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 AS dt
  FROM dets d JOIN refs r ON abs(d.lat - r.lat) < 0.2 WHERE {km_sql('d', 'r')} <= 12 AND abs(epoch_us(r.ts) - epoch_us(d.ts)) / 8.64e10 <= 9)"""


@query(
    "jn10_plume_match", "dets", "refs",
    oracle=f"""WITH {_PLUME_PAIRS}, c AS (SELECT det_id, count(*) AS n FROM p GROUP BY det_id)
    SELECT d.det_id, CASE WHEN d.det_id % 4 <> 0 THEN coalesce(n, 0) END AS n_matches FROM dets d LEFT JOIN c USING (det_id)""",
)
def plume_match(spark, sf):
    d = v.dets(spark, sf)
    m = matching.match_plumes(d, v.refs(spark, sf), 12.0, 9.0)
    return matching.match_counts(d, m, F.col("det_id") % 4 != 0)


@query(
    "tk03_match_order", "dets", "refs",
    oracle=f"""WITH {_PLUME_PAIRS} SELECT det_id, event_id, round(km, 6) AS km, round(dt, 7) AS dt_days,
      row_number() OVER (PARTITION BY det_id ORDER BY km, abs(dt), event_id) AS rank FROM p""",
)
def match_order(spark, sf):
    m = matching.match_plumes(v.dets(spark, sf), v.refs(spark, sf), 12.0, 9.0)
    return m.select("det_id", "event_id", r6("km").alias("km"), r6("dt_days", 7).alias("dt_days"), F.col("rank").cast("bigint").alias("rank"))


v.VIEW_SQL["twins"] = (("refs",), """
SELECT event_id, lat, lon, ts, q_kg_h, provenance FROM refs
UNION ALL SELECT event_id + 1000000000, lat + event_id % 3 * 0.004, lon, ts + to_seconds(event_id % 5 * 20), q_kg_h, CASE WHEN event_id % 2 = 0 THEN 'mirror' ELSE 'live' END FROM refs
UNION ALL SELECT event_id + 2000000000, lat, lon + event_id % 2 * 0.001, ts, q_kg_h, 'mirror' FROM refs""")


def twins(spark, sf):
    """Plume records of three feeds with near copies."""
    r = v.refs(spark, sf).select("event_id", "lat", "lon", "ts", "q_kg_h", "provenance")
    k = F.col("event_id")
    a = r.select((k + 1000000000).alias("event_id"), (F.col("lat") + k % 3 * F.lit(0.004)).alias("lat"), "lon",
                 F.timestamp_seconds(F.unix_seconds("ts") + k % 5 * 20).alias("ts"), "q_kg_h",
                 F.when(k % 2 == 0, "mirror").otherwise("live").alias("provenance"))
    b = r.select((k + 2000000000).alias("event_id"), "lat", (F.col("lon") + k % 2 * F.lit(0.001)).alias("lon"), "ts", "q_kg_h", F.lit("mirror").alias("provenance"))
    return r.unionByName(a).unionByName(b)


_DEDUP = f"""WITH RECURSIVE e AS (SELECT a.event_id AS i, b.event_id AS j FROM twins a JOIN twins b ON abs(a.lat - b.lat) < 0.02
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000 AND {km_sql('a', 'b')} <= 1),
  reach(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i),
  g AS (SELECT i AS event_id, min(j) AS grp FROM reach GROUP BY i),
  k AS (SELECT t.*, row_number() OVER (PARTITION BY grp ORDER BY (provenance = 'live') DESC, ts, event_id) AS rn FROM twins t JOIN g USING (event_id))"""


@query("jn19_plume_dedup", "twins", oracle=_DEDUP + " SELECT event_id, provenance, CAST(ts AS VARCHAR) AS ts FROM k WHERE rn = 1")
def plume_dedup(spark, sf):
    return matching.dedup_plumes(twins(spark, sf)).select("event_id", "provenance", F.col("ts").cast("string").alias("ts"))


@query(
    "set01_union_then_dedup", "twins",
    oracle=_DEDUP + " SELECT provenance, count(*) AS n, round(sum(q_kg_h), 4) AS q FROM k WHERE rn = 1 GROUP BY provenance",
)
def union_then_dedup(spark, sf):
    t = twins(spark, sf)
    live, mirror = t.where("provenance = 'live'"), t.where("provenance = 'mirror'")
    d = matching.dedup_plumes(mirror.unionByName(live))
    return d.groupBy("provenance").agg(F.count("*").alias("n"), r6(F.sum("q_kg_h"), 4).alias("q"))


def chip_boxes(spark, sf):
    """Chip footprints with folds: one per customer, on a jittered grid."""
    c = v.read(spark, sf, "customer")
    k = F.col("c_custkey")
    lon = (F.col("c_custkey") % 1500) % 40 * F.lit(0.008) + F.expr("c_custkey div 1500")
    lat = (k % 37 * F.lit(0.006)).cast("double")
    return c.select(k.alias("id"), lon.alias("west"), lat.alias("south"), (lon + 0.02).alias("east"), (lat + 0.015).alias("north"), (k % 5).alias("fold"))


v.VIEW_SQL["chip_boxes"] = ((), """SELECT c_custkey AS id, c_custkey % 1500 % 40 * 0.008 + c_custkey // 1500 AS west, c_custkey % 37 * 0.006 AS south,
  c_custkey % 1500 % 40 * 0.008 + c_custkey // 1500 + 0.02 AS east, c_custkey % 37 * 0.006 + 0.015 AS north, c_custkey % 5 AS fold FROM customer""")


@query(
    "jn18_fold_overlap", "chip_boxes",
    oracle="""SELECT least(a.fold, b.fold) AS fold_a, greatest(a.fold, b.fold) AS fold_b, count(*) AS n_pairs FROM chip_boxes a JOIN chip_boxes b ON a.id < b.id AND a.fold <> b.fold
      AND least(a.east, b.east) > greatest(a.west, b.west) AND least(a.north, b.north) > greatest(a.south, b.south)
      AND (least(a.east, b.east) - greatest(a.west, b.west)) * (least(a.north, b.north) - greatest(a.south, b.south)) / least((a.east - a.west) * (a.north - a.south), (b.east - b.west) * (b.north - b.south)) > 0.1
      GROUP BY ALL""",
)
def fold_overlap(spark, sf):
    return matching.overlap_pairs(chip_boxes(spark, sf), 0.05)


@query(
    "jn11_model_physics_agreement", "feed",
    oracle="""
    WITH p AS (SELECT site_id, scene_id, bool_or(NOT contains(result_json, 'no_plume') AND CAST(json_extract(result_json, '$.plume.n_pixels') AS BIGINT) > 0) AS found FROM feed WHERE source = 'physics' GROUP BY ALL)
    SELECT m.det_id, CASE WHEN p.scene_id IS NULL THEN 'physics_not_run' WHEN found THEN 'agree' ELSE 'physics_no_plume' END AS agreement
    FROM feed m LEFT JOIN p ON m.site_id IS NOT DISTINCT FROM p.site_id AND m.scene_id = p.scene_id WHERE m.source = 'ml'""",
)
def model_physics_agreement(spark, sf):
    f = v.feed(spark, sf)
    out = lookups.physics_agreement(f.where("source = 'ml'"), f.where("source = 'physics'"))
    return out.select("det_id", "agreement")


@query(
    "jn12_noise_floor_lookup", "feed",
    oracle="""
    WITH f AS (SELECT site_name, min(q_kg_h) * 1.5 AS floor FROM feed WHERE site_id % 2 = 0 GROUP BY ALL), g AS (SELECT avg(floor) AS pooled FROM f)
    SELECT det_id, round(coalesce(floor, pooled), 4) AS noise_floor, CASE WHEN floor IS NOT NULL THEN 'site' ELSE 'global' END AS floor_source,
      coalesce(q_kg_h <= coalesce(floor, pooled), false) AS below_floor FROM feed LEFT JOIN f USING (site_name) CROSS JOIN g""",
)
def noise_floor_lookup(spark, sf):
    f = v.feed(spark, sf)
    floors = f.where("site_id % 2 = 0").groupBy("site_name").agg((F.min("q_kg_h") * 1.5).alias("floor"))
    out = lookups.noise_floor(f, floors, floors.agg(F.avg("floor")).scalar())
    return out.select("det_id", r6("noise_floor", 4).alias("noise_floor"), "floor_source", "below_floor")


@query(
    "jn13_scene_resolution", "scenes",
    oracle="""
    WITH c AS (SELECT scene_no AS id, strftime(ts, '%Y%m%dT%H%M%S') AS datatake, 'T' || CAST(scene_no % 4 + 38 AS VARCHAR) || 'RUN' AS tile FROM scenes)
    SELECT c.id, min(s.scene_id) AS scene_id FROM c LEFT JOIN scenes s ON starts_with(s.scene_id, c.datatake) AND contains(s.scene_id, '_' || c.tile) GROUP BY c.id""",
)
def scene_resolution(spark, sf):
    s = v.scenes(spark, sf)
    cand = s.select(
        F.col("scene_no").alias("id"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("datatake"),
        F.concat(F.lit("T"), (F.col("scene_no") % 4 + 38).cast("string"), F.lit("RUN")).alias("tile"),
    )
    return lookups.resolve_scene(cand, s).select("id", "scene_id")


@query(
    "jn14_region_boxes",
    oracle="""
    WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 90 - 40 AS DOUBLE) + 0.25 AS lat, CAST(c_custkey * 13 % 240 - 120 AS DOUBLE) + 0.25 AS lon FROM customer),
    b(pr, name, w, e, s, n) AS (VALUES (1,'Turkmenistan',50,60,35,45),(2,'Algeria',-5,12,25,38),(3,'Libya',12,26,24,34),(4,'Persian Gulf',44,60,24,34),
      (5,'Yemen/Arabia',40,50,12,22),(6,'US Permian',-110,-95,28,38),(7,'Mexico',-98,-88,16,24),(8,'Turkmenistan-N/Kazakhstan',50,65,45,55),
      (9,'SE Asia offshore',95,120,0,15),(10,'Argentina',-72,-62,-42,-32),(11,'Venezuela',-70,-60,6,14)),
    m AS (SELECT id, arg_min(name, pr) AS name FROM p JOIN b ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY id)
    SELECT id, coalesce(name, 'other(' || CAST(CAST(round_even(lat, 0) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round_even(lon, 0) AS BIGINT) AS VARCHAR) || ')') AS region FROM p LEFT JOIN m USING (id)""",
)
def region_boxes(spark, sf):
    k = F.col("c_custkey")
    p = v.read(spark, sf, "customer").select(k.alias("id"), ((k * 7 % 90 - 40) + 0.25).alias("lat"), ((k * 13 % 240 - 120) + 0.25).alias("lon"))
    return p.select("id", lookups.region_of(F.col("lat"), F.col("lon")).alias("region"))


SRC_GRID = {"x0": 0.0, "y0": 1.0, "xscale": 0.01, "yscale": 0.01, "width": 16, "height": 16}
DST_GRID = {"x0": -0.013, "y0": 1.007, "xscale": 0.02, "yscale": 0.02, "width": 9, "height": 9}


@query(
    "jn15_mask_regrid", "chips",
    oracle="""
    WITH src AS (SELECT chip_id, y, x, truth_do >= 0.1 AS value FROM chips WHERE pass = 1),
    d AS (SELECT DISTINCT chip_id, y // 2 AS y, x // 2 AS x FROM chips WHERE pass = 1),
    m AS (SELECT *, greatest(0, least(15, CAST(round_even((1.0 - (1.007 - (y + 0.5) * 0.02)) / 0.01 - 0.5, 0) AS BIGINT))) AS sy,
      greatest(0, least(15, CAST(round_even((-0.013 + (x + 0.5) * 0.02 - 0.0) / 0.01 - 0.5, 0) AS BIGINT))) AS sx FROM d)
    SELECT m.chip_id, m.y, m.x, value FROM m LEFT JOIN src ON src.chip_id = m.chip_id AND src.y = sy AND src.x = sx""",
)
def mask_regrid(spark, sf):
    c = v.chips(spark, sf).where("pass = 1")
    mask = c.select("chip_id", "y", "x", (F.col("truth_do") >= 0.1).alias("value"))
    targets = c.select("chip_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).distinct()
    return lookups.regrid_nearest(mask, targets, SRC_GRID, DST_GRID).select("chip_id", "y", "x", "value")


SIGNAL_SQL = "CASE WHEN qi % 10 <> 3 THEN (l_linenumber * 1009 + l_partkey * 31 + l_orderkey * 17) % 9001 / 10000.0 - 0.75 END"
v.VIEW_SQL["signals"] = ((), f"""SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, CASE WHEN l_suppkey % 2 = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS spacecraft,
  1.9 + l_suppkey % 23 * 0.1 AS amf, {SIGNAL_SQL} AS signal FROM (SELECT *, CAST(l_quantity AS BIGINT) AS qi FROM lineitem)""")


def signals(spark, sf):
    """One fractional signal per line item, some missing, some beyond the table."""
    li = v.read(spark, sf, "lineitem")
    s = (F.col("l_linenumber") * 1009 + F.col("l_partkey") * 31 + F.col("l_orderkey") * 17) % 9001 / F.lit(10000.0) - 0.75
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"),
        F.when(F.col("l_suppkey") % 2 == 0, "Sentinel-2A").otherwise("Sentinel-2B").alias("spacecraft"),
        (1.9 + F.col("l_suppkey") % 23 * F.lit(0.1)).alias("amf"),
        F.when(F.col("l_quantity").cast("bigint") % 10 != 3, s).alias("signal"),
    )


# Interpolated curve per air mass, then the segment holding each signal.
LUT_CTES = """
 amfs AS (SELECT DISTINCT spacecraft, amf, greatest(2.0, least(4.0, amf)) AS a FROM {src}),
 curve AS (SELECT c.spacecraft, c.amf, l.lut_version, l.delta_omega AS g, l.m + (h.m - l.m) * ((c.a - l.amf) / 0.25) AS m,
     row_number() OVER (PARTITION BY c.spacecraft, c.amf, l.lut_version ORDER BY l.delta_omega) AS n
   FROM amfs c JOIN lut l ON l.spacecraft = c.spacecraft AND l.amf = 2.0 + 0.25 * least(7, greatest(0, floor((c.a - 2.0) / 0.25)))
   JOIN lut h ON h.spacecraft = l.spacecraft AND h.lut_version = l.lut_version AND h.amf = l.amf + 0.25 AND h.delta_omega = l.delta_omega),
 seg AS (SELECT a.spacecraft, a.amf, a.lut_version, a.n, a.g AS g0, b.g AS g1, a.m AS m0, b.m AS m1, min(b.m) OVER (PARTITION BY a.spacecraft, a.amf, a.lut_version) AS mlo,
     max(a.m) OVER (PARTITION BY a.spacecraft, a.amf, a.lut_version) AS mhi
   FROM curve a JOIN curve b ON b.spacecraft = a.spacecraft AND b.amf = a.amf AND b.lut_version = a.lut_version AND b.n = a.n + 1)
"""
BRACKET = """{v} IS NOT NULL AND greatest({s}.mlo, least({s}.mhi, {v})) <= {s}.m0 AND (greatest({s}.mlo, least({s}.mhi, {v})) > {s}.m1 OR ({s}.m1 = {s}.mlo AND {v} <= {s}.mlo))"""
INVERTED = "CASE WHEN {v} IS NOT NULL THEN {s}.g0 + ({s}.g1 - {s}.g0) * (({s}.m0 - greatest({s}.mlo, least({s}.mhi, {v}))) / ({s}.m0 - {s}.m1)) END"


@query(
    "jn16_lut_bracket", "signals", "lut",
    oracle="WITH " + LUT_CTES.format(src="signals") + f"""
    SELECT k, ln, pk, round({INVERTED.format(s='s', v='p.signal')}, 6) AS delta_omega FROM signals p
    LEFT JOIN seg s ON s.lut_version = 'report' AND s.spacecraft = p.spacecraft AND s.amf = p.amf AND {BRACKET.format(s='s', v='p.signal')}""",
)
def lut_bracket(spark, sf):
    df = invert_signal(signals(spark, sf), v.lut(spark), "report", "signal", "delta_omega")
    return df.select("k", "ln", "pk", r6("delta_omega").alias("delta_omega"))


@query(
    "jn17_coarse_fine_merge", "obs",
    oracle="""
    WITH c AS (SELECT series_id, date, avg(CASE WHEN event_id % 3 <> 0 THEN value END) AS value, count(*) AS count FROM obs GROUP BY ALL),
    f AS (SELECT series_id, date, avg(value) AS value, count(*) AS count FROM obs WHERE weight > 2 GROUP BY ALL)
    SELECT series_id, CAST(date AS VARCHAR) AS date, round(coalesce(f.value, c.value), 6) AS value, coalesce(f.count, c.count) AS count, f.count IS NOT NULL AS is_fine
    FROM c FULL OUTER JOIN f USING (series_id, date)""",
)
def coarse_fine_merge(spark, sf):
    o = v.obs(spark, sf)
    keys = ("series_id", "date")
    coarse = o.groupBy(*keys).agg(F.avg(F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("value"), F.count("*").alias("count"))
    fine = o.where("weight > 2").groupBy(*keys).agg(F.avg("value").alias("value"), F.count("*").alias("count"))
    df = series.merge_coarse_fine(coarse, fine, keys)
    return df.select("series_id", F.col("date").cast("string").alias("date"), r6("value").alias("value"), "count", "is_fine")


@query(
    "jn21_site_names", "feed",
    oracle="""SELECT det_id, c_name AS site_name, n_name AS region FROM feed LEFT JOIN customer ON c_custkey = site_id LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def site_names(spark, sf):
    rows = v.feed(spark, sf).select("det_id", "site_id")
    c = v.read(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("site_name"), "c_nationkey")
    n = v.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    return rows.join(c, "site_id", "left").join(n, "c_nationkey", "left").select("det_id", "site_name", "region")


@query(
    "jn23_point_inspection", "px",
    oracle="""
    WITH p AS (SELECT o_orderkey AS id, -168.2 + o_orderkey % 521 * 0.01 + 0.0011 AS lon, 50.02 - o_orderkey % 23 * 0.01 - 0.0037 AS lat FROM orders),
    c AS (SELECT CAST(tile_id % 1400 * 16 + x AS BIGINT) AS gx, CAST(tile_id // 1400 * 16 + y AS BIGINT) AS gy, avg(CASE WHEN B2 % 5 <> 0 THEN B8 / 9973.0 END) AS value FROM px GROUP BY ALL)
    SELECT id, round(value, 6) AS value FROM p LEFT JOIN c ON gx = CAST(floor((lon - -168.005) / 0.01) AS BIGINT) AND gy = CAST(floor((50.005 - lat) / 0.01) AS BIGINT)""",
)
def point_inspection(spark, sf):
    k = F.col("o_orderkey")
    pts = v.read(spark, sf, "orders").select(
        k.alias("id"), (F.lit(-168.2) + k % 521 * F.lit(0.01) + 0.0011).alias("lon"), (F.lit(50.02) - k % 23 * F.lit(0.01) - 0.0037).alias("lat")
    )
    comp = v.px(spark, sf).groupBy(
        (F.col("tile_id") % v.TILES_ACROSS * v.TILE_PX + F.col("x")).alias("gx"), (F.floor(F.col("tile_id") / v.TILES_ACROSS) * v.TILE_PX + F.col("y")).alias("gy")
    ).agg(F.avg(F.when(F.col("B2") % 5 != 0, F.col("B8") / 9973.0)).alias("value"))
    return lookups.inspect_points(pts, comp, -168.005, 50.005, 0.01).select("id", r6("value").alias("value"))


@query(
    "sc01_great_circle", "dets",
    oracle=f"SELECT a.det_id, round({km_sql('a', 'b')}, 5) AS km FROM dets a JOIN dets b ON b.det_id = a.det_id + 1",
)
def great_circle(spark, sf):
    d = v.dets(spark, sf)
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, F.col("b.det_id") == F.col("a.det_id") + 1)
    return j.select("a.det_id", r6(geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 5).alias("km"))


@query(
    "ml06_site_clusters", "dets",
    oracle="""WITH RECURSIVE s AS (SELECT det_id // 10 AS site_id, avg(lon) * 3 AS lon, avg(lat) * 3 AS lat FROM dets GROUP BY 1),
    m AS (SELECT avg(lat) AS a FROM s),
    e AS (SELECT p.site_id AS i, q.site_id AS j FROM s p, s q, m WHERE sqrt(pow((p.lon - q.lon) * cos(radians(a)), 2) + pow(p.lat - q.lat, 2)) * 111.32 <= 5),
    reach(i, j) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i)
    SELECT i AS site_id, min(j) AS cluster FROM reach GROUP BY i""",
)
def site_clusters(spark, sf):
    sites = v.dets(spark, sf).groupBy(F.expr("det_id div 10").alias("site_id")).agg((F.avg("lon") * 3).alias("lon"), (F.avg("lat") * 3).alias("lat"))
    return matching.link_sites(sites, 5.0)


@query(
    "tk02_newest_pages", "feed",
    oracle="SELECT det_id, CAST(created AS VARCHAR) AS created FROM feed ORDER BY created DESC, det_id DESC LIMIT 100 OFFSET 300",
)
def newest_pages(spark, sf):
    page = lookups.newest_first(v.feed(spark, sf), "created", "det_id", 100, 300)
    return page.select("det_id", F.col("created").cast("string").alias("created"))


