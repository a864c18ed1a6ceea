"""Import jobs, sinks and the user-defined surface, on files derived from the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from skylattice.operators import builders
from skylattice.plans import views as v
from skylattice.plans.composite_queries import ndvi
from skylattice.plans.registry import query
from skylattice.plans.scan_queries import CLEAR_SQL, r6
from skylattice.plans.series_queries import daily
from skylattice.session import scratch_path
from skylattice.sources import imports, presets, sinks


@query(
    "src08_dataset_specs",
    oracle="""
    WITH b AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS n, p_size FROM part),
    d AS (SELECT n, CASE WHEN n % 7 = 3 THEN 'dup' ELSE 'brand_' || n END AS id, n % 5 = 0 AS broken, p_size FROM b),
    f AS (SELECT id, min(lpad(CAST(n AS VARCHAR), 4, '0')) AS first FROM d WHERE NOT broken GROUP BY id)
    SELECT 'accepted' AS state, d.id AS dataset_id, 'P' || p_size AS key, CAST(p_size AS DOUBLE) AS vis_max, NULL AS reason, CAST(1 AS BIGINT) AS n FROM d JOIN f ON f.id = d.id AND f.first = lpad(CAST(d.n AS VARCHAR), 4, '0') WHERE NOT broken
    UNION ALL SELECT 'rejected', NULL, NULL, NULL, 'duplicate dataset id', count(DISTINCT n) FROM d JOIN f ON f.id = d.id AND f.first <> lpad(CAST(d.n AS VARCHAR), 4, '0') WHERE NOT broken
    UNION ALL SELECT 'rejected', NULL, NULL, NULL, 'vis_max must exceed vis_min', count(DISTINCT n) FROM d WHERE broken""",
)
def dataset_specs(spark, sf):
    n = F.substring("p_brand", 7, 4).cast("int")
    size = F.col("p_size").cast("string")
    low = F.when(n % 5 == 0, "99.0").otherwise("-1.0")
    product = F.concat(
        F.lit("[products.P"), size, F.lit(']\nname = "p"\nvis_min = '), low, F.lit("\nvis_max = "), size,
        F.lit('\nvalid_min = 0\nvalid_max = 100\ndisplay_unit = "x"\nbands = ["A", "B"]\nexpression = "(A - B) / (A + B)"\n'),
    )
    per = v.read(spark, sf, "part").select(n.alias("n"), product.alias("p")).distinct().groupBy("n").agg(F.array_join(F.sort_array(F.collect_list("p")), "\n").alias("p"))
    name = F.when(F.col("n") % 7 == 3, F.lit("dup")).otherwise(F.concat(F.lit("brand_"), F.col("n").cast("string")))
    head = F.concat(F.lit('[dataset]\nid = "'), name, F.lit('"\ntitle = "t"\ncollection_id = "c"\nattribution = "a"\ndefault_scale_m = 10\n'))
    path = scratch_path(spark, "specs")
    per.select(F.lpad(F.col("n").cast("string"), 4, "0").alias("file"), F.concat(head, "p").alias("value")).write.partitionBy("file").text(path)
    good, bad = imports.read_dataset_specs(spark, path, glob="*.txt")
    a = good.select(F.lit("accepted").alias("state"), "dataset_id", "key", "vis_max", F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    why = F.regexp_replace("reason", r"^products\.P\d+: ", "")
    r = bad.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    return a.unionByName(r.select(F.lit("rejected").alias("state"), none.alias("dataset_id"), none.alias("key"), F.lit(None).cast("double").alias("vis_max"), "reason", "n"))


def _event_file(spark, sf):
    """Event records of one CSV, some of them unusable."""
    o = v.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    lat = F.when(k % 13 != 0, (k % 170 - 85).cast("string")).otherwise("n/a")
    when = F.when(k % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    rate = F.when(k % 7 == 0, "999").otherwise((k % 400 / 8.0).cast("string"))
    out = o.select(lat.alias(" Latitude"), (k % 340 - 170).cast("string").alias("LONGITUDE"), when.alias("detection_date"), rate.alias("source_rate_t_h"), (k % 5 + 0.5).cast("string").alias("uncertainty"), k.alias("orderkey"))
    path = scratch_path(spark, "events-csv")
    out.write.csv(path, header=True)
    return path


@query(
    "src09_event_csv",
    oracle="""SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 170 - 85 AS DOUBLE) AS lat, CAST(o_orderkey % 340 - 170 AS DOUBLE) AS lon,
      CASE WHEN o_orderkey % 7 <> 0 THEN round(o_orderkey % 400 / 8.0 * 1000, 4) END AS q_kg_h, round((o_orderkey % 5 + 0.5) * 1000, 4) AS q_sigma, CASE WHEN o_orderkey % 7 = 0 THEN 'over_500_th_guard' END AS rate_dropped
      FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0""",
)
def event_csv(spark, sf):
    good, _ = imports.read_events_csv(spark, _event_file(spark, sf), "sample")
    return good.select(
        F.col("raw")["orderkey"].cast("bigint").alias("k"), F.to_date("event_ts").cast("string").alias("day"), "lat", "lon",
        r6("q_kg_h", 4).alias("q_kg_h"), r6("q_sigma_kg_h", 4).alias("q_sigma"), "rate_dropped",
    )


@query(
    "src09_event_csv_rejects",
    oracle="""SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'no latitude' ELSE 'no time' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 GROUP BY 1""",
)
def event_csv_rejects(spark, sf):
    _, bad = imports.read_events_csv(spark, _event_file(spark, sf), "sample")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "src10_event_geojson",
    oracle="""SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderkey % 80 AS DOUBLE) AS lat, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_orderkey % 170 END AS DOUBLE) AS lon, round(o_orderkey % 300 * 10.0, 4) AS q_kg_h
      FROM orders WHERE o_orderkey % 5 <> 0""",
)
def event_geojson(spark, sf):
    o = v.read(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "LineString").otherwise("Point")
    own_lon = F.when(F.col("o_orderkey") % 3 == 0, F.lit(',"Lon":7')).otherwise("")
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":['), (F.col("o_orderkey") % 170).cast("string"), F.lit(","), (F.col("o_orderkey") % 80).cast("string"),
        F.lit(']},"properties":{"Date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('","flux_kg_h":'), (F.col("o_orderkey") % 300 * 10).cast("string"), F.lit(',"orderkey":'), k, own_lon, F.lit("}}"),
    )
    docs = o.groupBy("o_custkey").agg(F.array_join(F.collect_list(feature), ",").alias("f"))
    path = scratch_path(spark, "events-geojson")
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    good, _ = imports.read_events_geojson(spark, path, "sample", per_line=True)
    return good.select(F.col("raw")["orderkey"].cast("bigint").alias("k"), F.to_date("event_ts").cast("string").alias("day"), "lat", "lon", r6("q_kg_h", 4).alias("q_kg_h"))


@query(
    "src11_plume_geojson", "refs",
    oracle="""SELECT 'P' || event_id AS plume_id, CAST(ts AS VARCHAR) AS ts, CASE WHEN event_id % 4 <> 0 THEN round(q_kg_h, 4) END AS q_kg_h,
      round(CASE WHEN event_id % 4 <> 0 THEN lat ELSE (lat * 4 + 0.01) / 4 END, 6) AS lat, round(CASE WHEN event_id % 4 <> 0 THEN lon ELSE (lon * 4 + 0.01) / 4 END, 6) AS lon, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE 'solo' END AS scenes
      FROM refs WHERE event_id % 7 <> 0 AND event_id % 6 <> 5""",
)
def plume_geojson(spark, sf):
    r = v.refs(spark, sf)
    k = F.col("event_id")
    x, y, x1, y1 = [c.cast("string") for c in (F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.01)]
    ring = F.concat(F.lit("[["), x, F.lit(","), y, F.lit("],["), x1, F.lit(","), y, F.lit("],["), x, F.lit(","), y1, F.lit("],["), x, F.lit(","), y, F.lit("]]"))
    kind = F.when(k % 6 == 5, "Point").otherwise("Polygon")
    has = k % 4 != 0
    num = {n: F.when(has, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(F.lit('"NA"')) for n, c in (("q", F.col("q_kg_h")), ("lat", F.col("lat")), ("lon", F.col("lon")))}
    scenes = F.when(k % 2 == 0, F.lit(',"DAAC Scene Names":["a","b"]')).otherwise(F.lit(',"DAAC Scene Names":"NA","Scene FIDs":"solo"'))
    time = F.when(k % 7 == 0, F.lit("NA")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":['), ring, F.lit(']},"properties":{"Plume ID":"P'), k.cast("string"), F.lit('","UTC Time Observed":"'), time,
        F.lit('","Emissions Rate Estimate (kg/hr)":'), num["q"], F.lit(',"Latitude of max concentration":'), num["lat"], F.lit(',"Longitude of max concentration":'), num["lon"], scenes, F.lit("}}"),
    )
    # Odd ones as bare features, even ones gathered in collections of one.
    text = F.when(k % 2 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))).otherwise(feature)
    path = scratch_path(spark, "plumes")
    r.select(text.alias("value")).write.text(path)
    good, _ = imports.read_plumes_geojson(spark, path, per_line=True)
    return good.select("plume_id", F.col("ts").cast("string").alias("ts"), r6("q_kg_h", 4).alias("q_kg_h"), r6("lat").alias("lat"), r6("lon").alias("lon"), F.array_join("scenes", ",").alias("scenes"))


@query(
    "src12_plume_outlines", "px",
    oracle="""SELECT scene_id || '/' || tile_id AS granule, round(max(e), 6) AS max_enh, count(*) AS n_pixels, round(avg(lat), 6) AS lat, 'mirror' AS provenance FROM (
      SELECT *, vertical_column_enhancement - 5000.0 AS e FROM px) WHERE e > 0 AND relative_orbit <> 5 GROUP BY scene_id, tile_id""",
)
def plume_outlines(spark, sf):
    px = v.px(spark, sf)
    p = px.select(
        F.concat("scene_id", F.lit("/"), F.col("tile_id").cast("string")).alias("granule"), F.when(F.col("relative_orbit") != 5, F.col("ts")).alias("ts"),
        "lat", "lon", (F.col("vertical_column_enhancement") - 5000.0).alias("value"),
    )
    out = imports.plumes_from_pixels(p)
    return out.select("granule", r6("max_enh").alias("max_enh"), "n_pixels", r6("lat").alias("lat"), "provenance")


@query(
    "src16_regions_and_sites", "dets",
    oracle="""
    WITH r(name, w, s, e, n) AS (VALUES ('Europe', -25.0, 34.0, 45.0, 72.0), ('North America', -170.0, 15.0, -50.0, 72.0), ('South America', -82.0, -56.0, -34.0, 13.0), ('Africa', -18.0, -35.0, 52.0, 37.0),
      ('Asia', 25.0, -10.0, 180.0, 75.0), ('Oceania', 110.0, -50.0, 180.0, 0.0), ('Antarctica', -180.0, -90.0, 180.0, -60.0), ('Entire Earth', -180.0, -90.0, 180.0, 90.0), ('CH4: Hassi Messaoud, Algeria', 5.4, 31.2, 6.4, 32.0), ('CH4: Permian Basin (USA)', -104.5, 31.0, -103.0, 32.5)),
    p AS (SELECT det_id, det_id * 37 % 160 - 79.75 AS lat, det_id * 53 % 350 - 174.75 AS lon FROM dets),
    m AS (SELECT det_id, arg_min(name, {'a': (e - w) * (n - s), 'b': name}) AS region FROM p JOIN r ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY det_id)
    SELECT region, count(*) AS n FROM m GROUP BY region""",
)
def regions_and_sites(spark, sf):
    k = F.col("det_id")
    pts = v.dets(spark, sf).select("det_id", (k * 37 % 160 - 79.75).alias("lat"), (k * 53 % 350 - 174.75).alias("lon"))
    region = presets.containing_region(F.col("lat"), F.col("lon"))
    return pts.groupBy(region.alias("region")).agg(F.count("*").alias("n"))


@query(
    "src16_site_seeding",
    oracle="""SELECT name FROM (VALUES ('Galkynysh, Turkmenistan'), ('Permian Basin (USA)'), ('Basra oil fields, Iraq'), ('Four Corners (USA)'), ('Upper Silesia, Poland')) AS t(name) WHERE (SELECT count(*) FROM customer) > 0""",
)
def site_seeding(spark, sf):
    names = F.when(F.col("c_custkey") % 2 == 0, "Korpezhe, Turkmenistan").otherwise("Hassi Messaoud, Algeria")
    known = v.read(spark, sf, "customer").select(names.alias("name")).distinct()
    return presets.seed_sites(known).select("name")


@query(
    "src17_checksum_audit",
    oracle="""SELECT state, count(*) AS n FROM (SELECT DISTINCT c_custkey // 50 AS f, CASE WHEN c_custkey // 50 % 5 = 4 THEN 'missing' WHEN c_custkey // 50 % 5 = 3 THEN 'mismatch' ELSE 'ok' END AS state FROM customer) GROUP BY state""",
)
def checksum_audit(spark, sf):
    c = v.read(spark, sf, "customer")
    body = c.groupBy(F.expr("c_custkey div 50").alias("f")).agg(F.array_join(F.sort_array(F.collect_list("c_name")), ";").alias("value"))
    path = scratch_path(spark, "downloads")
    files = body.where("f % 5 <> 4").select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), "value")
    # Few bytes but many files: the stated number of tasks is not merged down to one, and each commits its own files.
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    spread.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file").text(path)
    sums = F.md5(F.concat("value", F.when(F.col("f") % 5 == 3, "tampered\n").otherwise("\n")))
    manifest = body.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), sums.alias("md5"))
    report = imports.audit_checksums(spark, path, manifest, r"file=([^/]+)/")
    return report.groupBy("state").agg(F.count("*").alias("n"))


@query(
    "snk01_series_export", "daily",
    oracle="SELECT format, series_id, CAST(date AS VARCHAR) AS date, round(value, 6) AS value, count, 'ppb' AS unit FROM daily CROSS JOIN (SELECT unnest(['csv', 'parquet']) AS format)",
)
def series_export(spark, sf):
    d = daily(spark, sf)
    out = None
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"series-{fmt}")
        tagged = d.withColumn("date", F.concat_ws("|", "series_id", F.col("date").cast("string")))
        sinks.write_series(tagged, path, fmt, "ppb")
        back = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema("date string, value double, count bigint, unit string").csv(path, header=True)
        parts = F.split("date", r"\|")
        back = back.select(F.lit(fmt).alias("format"), parts[0].alias("series_id"), parts[1].alias("date"), r6("value").alias("value"), "count", "unit")
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "snk02_window_export", "px",
    oracle="SELECT y // 7 AS win_row, x // 7 AS win_col, count(*) AS n, CAST(sum(B4) AS BIGINT) AS b4 FROM px GROUP BY ALL",
)
def window_export(spark, sf):
    path = scratch_path(spark, "windows")
    sinks.write_windows(v.px(spark, sf).select("tile_id", "y", "x", "B4"), path, 7)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("win_row").cast("bigint").alias("win_row"), F.col("win_col").cast("bigint").alias("win_col")).agg(F.count("*").alias("n"), F.sum("B4").alias("b4"))


@query(
    "snk03_detection_records", "truth",
    oracle="""SELECT id, CASE WHEN id % 10 <> 0 AND id % 10 <> 1 THEN round(q_ours, 4) END AS q_kg_h, CASE WHEN id % 3 <> 0 THEN 'ring' END AS outline, id % 3 AS n_pixels, CASE WHEN id % 10 <> 0 AND id % 10 <> 1 THEN round(q_ours, 4) END AS json_q FROM truth""",
)
def detection_records(spark, sf):
    k = F.col("id")
    q = F.when(k % 10 == 0, F.lit(float("nan"))).when(k % 10 == 1, F.lit(float("inf"))).otherwise(r6("q_ours", 4))
    res = v.truth(spark, sf).select("id", q.alias("q_kg_h"), F.lit("ring").alias("outline"), (k % 3).alias("n_pixels"))
    path = scratch_path(spark, "detections")
    sinks.write_detections(res, path)
    back = spark.read.parquet(path)
    return back.select("id", "q_kg_h", "outline", "n_pixels", F.from_json("result_json", "q_kg_h double")["q_kg_h"].alias("json_q"))


@query(
    "snk05_detection_arrays", "chips",
    oracle="""SELECT chip_id, CAST(256 AS BIGINT) AS n, 256 - count(*) AS n_missing, round(sum(CAST(b11 AS FLOAT)::DOUBLE), 3) AS b11, round(max(CAST(truth_do AS FLOAT)::DOUBLE), 5) AS peak FROM chips WHERE pass = 1 GROUP BY chip_id""",
)
def detection_arrays(spark, sf):
    c = v.chips(spark, sf).where("pass = 1")
    a = sinks.detection_arrays(c, ("chip_id",), ("b11", "truth_do"), 16, 16)
    have = F.filter("b11", lambda x: x.isNotNull())
    return a.select(
        "chip_id", F.size("b11").cast("bigint").alias("n"), (F.size("b11") - F.size(have)).cast("bigint").alias("n_missing"),
        r6(F.aggregate(have, F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("b11"), r6(F.array_max("truth_do").cast("double"), 5).alias("peak"),
    )


@query(
    "snk04_event_import",
    oracle="""SELECT count(CASE WHEN ok THEN 1 END) AS imported, count(CASE WHEN NOT ok THEN 1 END) AS skipped, count(CASE WHEN ok AND o_orderkey % 7 = 0 THEN 1 END) AS rates_dropped FROM (SELECT *, o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS ok FROM orders)""",
)
def event_import(spark, sf):
    good, bad = imports.read_events_csv(spark, _event_file(spark, sf), "sample")
    watched, seen = imports.observe_import(good)
    path = scratch_path(spark, "imported")
    watched.write.mode("append").parquet(path)
    counts = seen.get
    return bad.agg(F.count("*").alias("skipped")).select(
        F.lit(counts["imported"]).cast("bigint").alias("imported"), "skipped", F.lit(counts["rates_dropped"]).cast("bigint").alias("rates_dropped")
    )


@query(
    "udf01_user_expression", "px",
    oracle="""SELECT tile_id, round(avg((B8 - B4) / nullif(B8 + B4 + 0.5, 0)), 6) AS one_window, round(avg(sqrt(abs(B8 - B4)) + greatest(B2, B3)), 6) AS with_functions FROM px GROUP BY tile_id""",
)
def user_expression(spark, sf):
    a = imports.user_product_column("(B8 - B4) / (B8 + B4 + 0.5)", ["B8", "B4"])
    b = imports.user_product_column("sqrt(abs(B8 - B4)) + max(B2, B3)", ["B8", "B4", "B2", "B3"])
    return v.px(spark, sf).groupBy("tile_id").agg(r6(F.avg(a)).alias("one_window"), r6(F.avg(b)).alias("with_functions"))


@query(
    "udf02_map_and_reduce", "px",
    oracle=f"SELECT scene_id, round(avg(q), 6) AS mean, count(q) AS count, round(max(q), 6) AS max FROM (SELECT scene_id, CASE WHEN {CLEAR_SQL} THEN B12 / nullif(B11, 0) END AS q FROM px) GROUP BY scene_id",
)
def map_and_reduce(spark, sf):
    def ratio(df):
        return df.withColumn("q", F.try_divide("B12", "B11"))

    def clear(df):
        from skylattice.sources.scans import cloud_free

        return df.withColumn("q", F.when(cloud_free(), F.col("q")))

    df = v.px(spark, sf).transform(ratio).transform(clear)
    return df.groupBy("scene_id").agg(r6(F.avg("q")).alias("mean"), F.count("q").alias("count"), r6(F.max("q")).alias("max"))


@query("udf03_named_builder", "ndvi", oracle="SELECT tile_id, round(max(value), 6) AS peak FROM ndvi GROUP BY tile_id")
def named_builder(spark, sf):
    if "peak_value" not in builders.names():
        @builders.register("peak_value")
        def peak_value(pixels):
            return pixels.groupBy("tile_id").agg(F.max("value").alias("peak"))

    return builders.build("peak_value", ndvi(spark, sf)).select("tile_id", r6("peak").alias("peak"))


@query("udf04_observed_progress", "ndvi", oracle="SELECT scene_id, round(avg(value), 6) AS value FROM ndvi GROUP BY scene_id")
def observed_progress(spark, sf):
    """Scene means in chunks of whole years; a scene has one time, so it lies in one chunk."""
    px = ndvi(spark, sf)
    first, last = px.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    if first is None:
        return px.groupBy("scene_id").agg(r6(F.avg("value")).alias("value"))
    years = [px.where((F.col("ts") >= F.lit(date(y, 1, 1))) & (F.col("ts") < F.lit(date(y + 1, 1, 1)))) for y in range(first, last + 1)]
    return builders.run_chunks(spark, [y.groupBy("scene_id").agg(r6(F.avg("value")).alias("value")) for y in years], "value")


@query(
    "udf05_robust_helpers", "ndvi",
    oracle="""WITH m AS (SELECT tile_id, median(value) AS med FROM ndvi GROUP BY tile_id) SELECT tile_id, round(median(abs(value - med)), 6) AS mad, round(1.4826 * median(abs(value - med)), 6) AS sigma FROM ndvi JOIN m USING (tile_id) GROUP BY tile_id""",
)
def robust_helpers(spark, sf):
    from skylattice.functions.quantiles import robust_spread

    return robust_spread(ndvi(spark, sf), ("tile_id",), "value").select("tile_id", r6("mad").alias("mad"), r6("sigma").alias("sigma"))


