"""Scalar functions: geometry, time, units, identifiers and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geo, identifiers, rates, times
from skylattice.operators import emission, winds
from skylattice.plans import views as v
from skylattice.plans.filter_queries import _BOX_REASON, site_boxes
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import r6
from skylattice.sources.scans import air_mass

_VALID = f"SELECT * FROM boxes WHERE {_BOX_REASON} IS NULL"


def valid_boxes(spark, sf):
    from skylattice.operators import gates

    return gates.split_rejects(site_boxes(spark, sf), gates.region_problem())[0]


def _corners():
    return F.col("west"), F.col("south"), F.col("east"), F.col("north")


@query("sc02_air_mass", "scenes", oracle="SELECT scene_id, round(1 / cos(sun_zenith * pi() / 180) + 1 / cos(view_zenith * pi() / 180), 6) AS amf FROM scenes")
def air_mass_query(spark, sf):
    return v.scenes(spark, sf).select("scene_id", r6(air_mass(F.col("sun_zenith"), F.col("view_zenith"))).alias("amf"))


@query(
    "sc04_wind_length_mass", "chips",
    oracle="""SELECT chip_id, round(0.33 * (2 + chip_id % 7) + 0.45, 6) AS u_eff, round(sqrt(n * 400.0), 6) AS length_m, round(m * 400.0 * 0.01604, 6) AS mass_kg FROM (
      SELECT chip_id, count(CASE WHEN truth_do >= 0.1 THEN 1 END) AS n, sum(CASE WHEN truth_do >= 0.1 THEN truth_do END) AS m FROM chips WHERE pass = 1 GROUP BY chip_id)""",
)
def wind_length_mass(spark, sf):
    inside = F.col("truth_do") >= 0.1
    area = F.lit(400.0)
    per = v.chips(spark, sf).where("pass = 1").groupBy("chip_id").agg(
        F.count_if(inside).alias("n"), emission.mass_kg(F.when(inside, F.col("truth_do")), area).alias("mass")
    )
    return per.select(
        "chip_id", r6(winds.effective_wind(F.lit(2) + F.col("chip_id") % 7)).alias("u_eff"),
        r6(emission.length_m(F.col("n"), area)).alias("length_m"), r6("mass").alias("mass_kg"),
    )


@query(
    "sc05_pixel_grid", "boxes",
    oracle=f"""SELECT id, greatest(1, CAST(ceil((east - west) / xs) AS BIGINT)) AS width, greatest(1, CAST(ceil((north - south) / ys) AS BIGINT)) AS height, round(xs, 9) AS xscale,
      CAST(ceil(greatest(1, ceil((north - south) / ys)) / 1024.0) AS BIGINT) * CAST(ceil(greatest(1, ceil((east - west) / xs)) / 1024.0) AS BIGINT) AS n_windows
      FROM (SELECT *, 60.0 / (111320.0 * cos(radians((south + north) / 2))) AS xs, 60.0 / 111320.0 AS ys FROM ({_VALID}))""",
)
def pixel_grid(spark, sf):
    g = geo.grid_columns(*_corners(), 60.0)
    df = valid_boxes(spark, sf).select("id", *[c.alias(k) for k, c in g.items()])
    tiles = F.ceil(F.col("height") / 1024.0) * F.ceil(F.col("width") / 1024.0)
    return df.select("id", "width", "height", r6("xscale", 9).alias("xscale"), tiles.cast("bigint").alias("n_windows"))


@query(
    "sc06_pixel_area", "boxes",
    oracle=f"""SELECT id, round(xs * 111320.0 * cos(radians(north - 0.5 * h * ys)) * ys * 111320.0, 4) AS area_m2 FROM (
      SELECT *, greatest(1, ceil((north - south) / ys)) AS h FROM (SELECT *, 20.0 / (111320.0 * cos(radians((south + north) / 2))) AS xs, 20.0 / 111320.0 AS ys FROM ({_VALID})))""",
)
def pixel_area(spark, sf):
    g = geo.grid_columns(*_corners(), 20.0)
    area = geo.pixel_area_m2(g["y0"], g["height"], g["xscale"], g["yscale"])
    return valid_boxes(spark, sf).select("id", r6(area, 4).alias("area_m2"))


@query(
    "sc07_point_to_pixel", "dets",
    oracle="""SELECT det_id, CASE WHEN ok THEN r END AS row, CASE WHEN ok THEN c END AS col FROM (SELECT *, r >= 0 AND r < 120 AND c >= 0 AND c < 150 AS ok FROM (
      SELECT det_id, CAST(round_even((-58.0 - lat) / 0.013, 0) AS BIGINT) AS r, CAST(round_even((lon - -169.9) / 0.011, 0) AS BIGINT) AS c FROM dets))""",
)
def point_to_pixel(spark, sf):
    row, col = geo.to_row_col(F.col("lon"), F.col("lat"), F.lit(-169.9), F.lit(-58.0), F.lit(0.011), F.lit(0.013), F.lit(150), F.lit(120))
    return v.dets(spark, sf).select("det_id", row.alias("row"), col.alias("col"))


@query(
    "sc08_box_geometry", "boxes",
    oracle=f"""SELECT id, round((south + north) / 2, 6) AS center_lat, round(east - west, 6) AS width_deg, round((east - west) * cos(radians((south + north) / 2)) / (north - south), 6) AS aspect,
      round_even(east, 5) AS east_r, round(west - 0.5, 6) AS env_west, round(north + 0.25, 6) AS env_north FROM ({_VALID})""",
)
def box_geometry(spark, sf):
    b = valid_boxes(spark, sf)
    m = geo.box_columns(*_corners())

    def vertex(lon, lat):
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    w, s, e, n = _corners()
    ring = F.array(vertex(w - 0.5, s), vertex(e, s - 0.1), vertex(e, n + 0.25), vertex(w, n))
    env = geo.envelope(ring)
    return b.select(
        "id", r6(m["center_lat"]).alias("center_lat"), r6(m["width_deg"]).alias("width_deg"), r6(m["aspect"]).alias("aspect"), m["east_r"].alias("east_r"),
        r6(env["west"]).alias("env_west"), r6(env["north"]).alias("env_north"),
    )


@query(
    "sc09_analysis_boxes", "dets", "boxes",
    oracle=f"""SELECT det_id, round(lon - 7000.0 / (111320.0 * greatest(cos(radians(lat)), 0.01)) / 2, 6) AS west, round(lat + 7000.0 / 111320.0 / 2, 6) AS north,
      round(lon - 200.0 / (111320.0 * cos(radians(lat))), 6) AS point_west, round(lat - 200.0 / 111320.0, 6) AS point_south, size_km FROM dets LEFT JOIN (
        SELECT id, greatest(1.0, floor(least(10.0, (east - west) * 111.32 * greatest(cos(radians((south + north) / 2)), 0.01), (north - south) * 111.32) + 0.5)) AS size_km FROM ({_VALID})) ON id = det_id""",
)
def analysis_boxes(spark, sf):
    d = v.dets(spark, sf)
    a = geo.analysis_box(F.col("lat"), F.col("lon"), F.lit(7.0))
    p = geo.point_box(F.col("lat"), F.col("lon"), F.lit(20.0))
    size = valid_boxes(spark, sf).select(F.col("id").alias("det_id"), geo.default_area_km(*_corners()).alias("size_km"))
    return d.join(size, "det_id", "left").select(
        "det_id", r6(a["west"]).alias("west"), r6(a["north"]).alias("north"), r6(p["west"]).alias("point_west"), r6(p["south"]).alias("point_south"), "size_km"
    )


@query(
    "sc10_cell_lattice", "dets",
    oracle="""WITH c AS (SELECT i AS idx, -170.0 + (i % 20) * 0.1 AS west, -58.0 - (i // 20) * 0.1 AS north FROM (SELECT unnest(range(400)) AS i)),
      n AS (SELECT CAST(floor((-58.0 - lat) / 0.1) AS BIGINT) * 20 + CAST(floor((lon - -170.0) / 0.1) AS BIGINT) AS idx, count(*) AS n FROM (SELECT lat + 0.0013 AS lat, lon + 0.0013 AS lon FROM dets) WHERE lon >= -170 AND lon < -168 AND lat > -60 AND lat <= -58 GROUP BY 1)
      SELECT c.idx, round(west + 0.05, 6) AS lon, round(north - 0.05, 6) AS lat, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (idx)""",
)
def cell_lattice(spark, sf):
    box = geo.box(-170.0, -60.0, -168.0, -58.0)
    nx, ny = geo.lattice_shape(box, 0.1)
    d = v.dets(spark, sf)
    idx = geo.cell_index(F.col("lon") + 0.0013, F.col("lat") + 0.0013, box, nx, ny)
    n = d.groupBy(idx.alias("idx")).agg(F.count("*").alias("n"))
    cells = geo.lattice(spark, box, nx, ny)
    return cells.join(n, "idx", "left").select("idx", r6("lon").alias("lon"), r6("lat").alias("lat"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "sc12_event_times",
    oracle="""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN epoch_us(o_orderdate) // 1000000 + 3723 WHEN 1 THEN epoch_us(o_orderdate) // 1000000 + 36000 - 7200 WHEN 2 THEN epoch_us(o_orderdate) // 1000000
      WHEN 3 THEN epoch_us(o_orderdate) // 1000000 WHEN 4 THEN NULL ELSE epoch_us(o_orderdate) // 1000000 + 29730 END AS epoch FROM orders""",
)
def event_times(spark, sf):
    o = v.read(spark, sf, "orders")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(d, F.lit("T01:02:03Z"))).when(k == 1, F.concat(d, F.lit("T10:00:00+02:00"))).when(k == 2, d)
        .when(k == 3, F.concat(d, F.lit(" morning pass"))).when(k == 4, F.concat(F.lit("pass of "), d)).otherwise(F.concat(F.lit(" "), d, F.lit(" 08:15:30 ")))
    )
    return o.select(F.col("o_orderkey").alias("id"), F.unix_seconds(times.parse_event_time(text)).alias("epoch"))


@query(
    "sc13_rate_units",
    oracle="""SELECT id, round(CASE k WHEN 0 THEN q * 1000 WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END, 6) AS q_kg_h,
      CASE k WHEN 0 THEN 't_h' WHEN 1 THEN 'kg_h' WHEN 2 THEN 'kg_h' WHEN 3 THEN NULL WHEN 4 THEN 't_h' END AS rate_unit,
      CASE k WHEN 3 THEN 'ambiguous_unit' WHEN 4 THEN 'over_500_th_guard' END AS dropped, round(CASE k WHEN 0 THEN s * 1000 WHEN 1 THEN s WHEN 2 THEN s * 1000 WHEN 3 THEN NULL WHEN 4 THEN s * 1000 END, 4) AS sigma,
      round(CASE k WHEN 3 THEN q * 1000 END, 6) AS q_told FROM (
      SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_totalprice / 10000.0 AS q, o_orderkey % 50 + 1.5 AS s FROM orders)""",
)
def rate_units(spark, sf):
    o = v.read(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    q = (F.col("o_totalprice") / 10000.0).cast("string")
    s = (F.col("o_orderkey") % 50 + 1.5).cast("string")

    def rec(*pairs):
        return F.array(*[F.struct(F.lit(a).alias("key"), b.alias("value")) for a, b in pairs])

    none = F.lit("")
    record = (
        F.when(k == 0, rec(("id", F.lit("1")), ("source_rate_t_h", q), ("uncertainty", s)))
        .when(k == 1, rec(("rate", F.lit("7")), ("ch4_fluxrate_std", s), ("ch4_fluxrate", q)))
        .when(k == 2, rec(("sigma_t_h", s), ("flux_kg_h", q), ("rate_t_h", q)))
        .when(k == 3, rec(("rate", q), ("uncertainty", s)))
        .when(k == 4, rec(("rate_th", F.lit("999")), ("sigma", s)))
        .otherwise(rec(("note", F.lit("x")), ("rate", none), ("error", none)))
    )
    found = rates.with_candidates(o.select(F.col("o_orderkey").alias("id"), record.alias("record")))
    df = found.withColumn("r", rates.resolve_rate())
    told = rates.resolve_rate("t_h")["q_kg_h"]
    return df.select(
        "id", r6("r.q_kg_h").alias("q_kg_h"), F.col("r.rate_unit").alias("rate_unit"), F.col("r.dropped").alias("dropped"),
        r6(rates.resolve_sigma(F.col("r.rate_unit")), 4).alias("sigma"), F.when(F.col("r.dropped") == "ambiguous_unit", r6(told)).alias("q_told"),
    )


@query(
    "sc14_identifiers", "scenes",
    oracle="""SELECT scene_no, regexp_extract(scene_id, '_T([0-9]{2}[A-Z]{3})', 1) AS tile, strftime(ts, '%Y-%m-%d') AS sensed,
      CASE scene_no % 4 WHEN 0 THEN 'hassi' WHEN 1 THEN 'permian' WHEN 2 THEN 'korpeje' END AS site, CASE WHEN scene_no % 4 < 3 THEN scene_no % 5 END AS plume, CASE WHEN scene_no % 4 < 3 THEN CAST(scene_no % 300 * 100 AS DOUBLE) END AS q_true,
      scene_no % 2 = 0 AS id_ok FROM scenes""",
)
def identifier_parsing(spark, sf):
    s = v.scenes(spark, sf)
    n = F.col("scene_no")
    tile = F.when(n % 4 == 0, "32SKA").when(n % 4 == 1, "13SGR").when(n % 4 == 2, "40SBH").otherwise("99XXX")
    d = F.date_format("ts", "yyyyMMdd")
    name = F.concat(F.lit("S2A_MSICH4_"), d, F.lit("T101031_N0301_R022_T"), tile, F.lit("_"), d, F.lit("T121947_plume"), (n % 5).cast("string"), F.lit("_Q"), (n % 300 * 100).cast("string"))
    b = identifiers.benchmark_fields(name)
    dataset = F.when(n % 2 == 0, F.concat(F.lit("set_"), n.cast("string"))).otherwise(F.concat(F.lit("Set-"), n.cast("string")))
    return s.select(
        "scene_no", identifiers.tile_of(F.col("scene_id")).alias("tile"), identifiers.sensing_date(F.col("scene_id")).cast("string").alias("sensed"),
        b["site"].alias("site"), b["plume"].alias("plume"), b["q_true"].alias("q_true"), identifiers.valid_dataset_id(dataset).alias("id_ok"),
    )


@query(
    "sc15_time_windows",
    oracle="""SELECT id, CAST(c - h AS VARCHAR) AS start, CAST(least(c + h, DATE '2000-06-30') AS VARCHAR) AS stop, CAST(least(c + h, DATE '2000-06-30') + 1 AS VARCHAR) AS stop_exclusive,
      CAST(a + CAST(floor(greatest(0, date_diff('day', a, b)) / 2.0 + 0.5) AS INTEGER) AS VARCHAR) AS mid, CAST(ceil(greatest(0, date_diff('day', a, b)) / 2.0) AS INTEGER) AS half FROM (
      SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS c, CAST(least(183, greatest(0, o_orderkey % 260 - 20)) AS INTEGER) AS h, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 41 - 3 AS INTEGER) AS b FROM orders)""",
)
def time_windows(spark, sf):
    o = v.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    c, today = F.to_date("o_orderdate"), F.lit("2000-06-30").cast("date")
    h = times.clamp_half_days((k % 260 - 20).cast("double"))
    start, stop = times.window_range(c, h, today)
    _, excl = times.window_mean_dates(c, h, today)
    mid, half = times.range_to_window(c, F.date_add(c, (k % 41 - 3).cast("int")))
    return o.select(k.alias("id"), *[x.cast("string").alias(n) for n, x in (("start", start), ("stop", stop), ("stop_exclusive", excl), ("mid", mid))], half.alias("half"))


_NICE = "[" + ", ".join(f"{k!r}" if "e" not in repr(k) else f"{k:.1f}" for k in geo.NICE_KM) + "]"


@query(
    "sc16_scale_bar", "boxes",
    oracle=f"""SELECT id, km, greatest(1, CAST(round_even(km * 1000 / (w / 800.0), 0) AS BIGINT)) AS px FROM (
      SELECT *, coalesce(list_max(list_filter({_NICE}, lambda k: k * 1000 <= w * 0.25)), 0.01) AS km FROM (SELECT id, (east - west) * 111320.0 * cos(radians((south + north) / 2)) AS w FROM ({_VALID})))""",
)
def scale_bar(spark, sf):
    km, px = geo.scale_bar(*_corners(), 800)
    return valid_boxes(spark, sf).select("id", km.alias("km"), px.cast("bigint").alias("px"))


@query(
    "sc17_output_size", "boxes",
    oracle=f"""SELECT id, w, h, greatest(2, w - w % 2) AS even_w, greatest(2, h - h % 2) AS even_h FROM (
      SELECT id, CASE WHEN a >= 1 THEN 1001 ELSE greatest(1, CAST(round_even(1001 * a, 0) AS BIGINT)) END AS w, CASE WHEN a >= 1 THEN greatest(1, CAST(round_even(1001 / a, 0) AS BIGINT)) ELSE 1001 END AS h FROM (
        SELECT id, (east - west) * cos(radians((south + north) / 2)) / (north - south) AS a FROM ({_VALID})))""",
)
def output_size(spark, sf):
    w, h = geo.geo_dimensions(geo.box_columns(*_corners())["aspect"], 1001)
    df = valid_boxes(spark, sf).select("id", w.alias("w"), h.alias("h"))
    return df.select("id", "w", "h", geo.even(F.col("w")).alias("even_w"), geo.even(F.col("h")).alias("even_h"))


@query(
    "sc18_json_results", "feed",
    oracle="""SELECT det_id, len(CAST(json_extract(result_json, '$.flags') AS VARCHAR[])) AS n_flags, CAST(json_extract_string(result_json, '$.score') AS DOUBLE) AS score, CAST(json_array_length(emit_json, '$.matches') AS BIGINT) AS n_matches FROM feed""",
)
def json_results(spark, sf):
    return v.feed(spark, sf).select(
        "det_id", F.size(identifiers.result_flags(F.col("result_json"))).cast("bigint").alias("n_flags"),
        identifiers.result_score(F.col("result_json")).alias("score"), identifiers.match_count(F.col("emit_json")).cast("bigint").alias("n_matches"),
    )


@query("sc18_event_props", oracle="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf):
    return v.read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "sc19_vertex_mean", "dets",
    oracle="""SELECT det_id, round(CASE WHEN det_id % 2 = 0 THEN (lat * 4 + (lat + 1) + lat) / 6 ELSE (lat * 3 + lat + 1) / 4 END, 6) AS lat, round(CASE WHEN det_id % 2 = 0 THEN (lon * 3 + (lon + 1) * 2 + lon) / 6 ELSE (lon * 3 + lon + 1) / 4 END, 6) AS lon FROM dets""",
)
def vertex_mean(spark, sf):
    x, y = F.col("lon").cast("string"), F.col("lat").cast("string")
    x1, y1 = (F.col("lon") + 1).cast("string"), (F.col("lat") + 1).cast("string")

    def pt(a, b):
        return F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))

    def ring(*pts):
        return F.concat(F.lit("["), F.concat_ws(",", *pts), F.lit("]"))

    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring(pt(x, y), pt(x1, y), pt(x, y)), F.lit("],["), ring(pt(x, y), pt(x1, y1), pt(x, y)), F.lit("]]}"))
    poly = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring(pt(x, y), pt(x1, y), pt(x, y1), pt(x, y)), F.lit("]}"))
    g = F.when(F.col("det_id") % 2 == 0, multi).otherwise(poly)
    mean = identifiers.vertex_mean(g)
    return v.dets(spark, sf).select("det_id", r6(mean["lat"]).alias("lat"), r6(mean["lon"]).alias("lon"))


@query("sc20_closed_range", oracle="SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) < DATE '1999-01-01' AS closed FROM orders")
def closed_range(spark, sf):
    return v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), times.is_closed(F.to_date("o_orderdate"), F.lit("1999-01-01").cast("date")).alias("closed"))
