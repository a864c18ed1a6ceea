"""Observation tables derived from the driver tables, in Spark and in SQL.

Every view keeps all rows of its source table, so its size grows with the data:
``px`` has one pixel observation per line item, ``scenes`` one acquisition per order,
``obs`` one cell reading per event, and so on. Each entry of ``VIEW_SQL`` states the
same view for the comparison engine as ``(views it needs, SQL)``.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Digital numbers per band: offset + q*quantity + d*discount% + t*tax% + price mod m.
BAND_MIX = {
    "B1": (900, 4, 10, 0, 1),
    "B2": (500, 8, 60, 0, 50),
    "B3": (700, 10, 40, 0, 70),
    "B4": (600, 14, 0, 80, 90),
    "B5": (900, 16, 0, 30, 110),
    "B6": (1400, 18, 50, 0, 130),
    "B7": (1700, 20, 0, 20, 170),
    "B8": (1500, 36, 0, -60, 300),
    "B8A": (1600, 34, 0, -40, 310),
    "B9": (500, 6, 0, 0, 37),
    "B10": (20, 1, 1, 0, 1),
    "B11": (2000, 20, 30, 0, 190),
    "B12": (1500, 16, 0, 40, 210),
}
OPTICAL_BANDS = tuple(BAND_MIX)
TILE_PX = 16
PIXEL_DEG = 0.01
TILES_ACROSS = 1400
LUT_STEP = 0.05

# Raw gas and plume-enhancement bands: price mod m, shifted and scaled.
GAS_MIX = {
    "tropospheric_NO2_column_number_density": (130, -20, 1e-5),
    "SO2_column_number_density": (130, -20, 1e-4),
    "CO_column_number_density": (120, -5, 1e-3),
    "O3_column_number_density": (340, -10, 1e-3),
    "CH4_column_volume_mixing_ratio_dry_air_bias_corrected": (640, 1590, 1.0),
    "tropospheric_HCHO_column_number_density": (600, -60, 1e-5),
    "vertical_column_enhancement": (14000, -3000, 1.0),
}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _dn_sql(band: str) -> str:
    o, q, d, t, m = BAND_MIX[band]
    return f"{o} + {q}*qi + {d}*di + {t}*ti + pi % {m}"


@lru_cache(maxsize=4)
def px(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel observations: one row per line item, bands as digital numbers."""
    li = read(spark, sf, "lineitem")
    qi = F.col("l_quantity").cast("bigint")
    di = F.round(F.col("l_discount") * 100).cast("bigint")
    ti = F.round(F.col("l_tax") * 100).cast("bigint")
    pi = F.floor("l_extendedprice")
    tile = F.expr("l_suppkey div 4")
    y = F.col("l_partkey") % TILE_PX
    x = F.col("l_orderkey") % TILE_PX
    doy = F.dayofyear("l_shipdate")
    day = F.dayofmonth("l_shipdate")
    bands = {}
    for b, (o, q, d, t, m) in BAND_MIX.items():
        bands[b] = F.lit(o) + qi * q + di * d + ti * t + pi % m
    for b, (m, shift, scale) in GAS_MIX.items():
        bands[b] = (pi % m + shift) * F.lit(float(scale))
    vv = (qi * 3 % 20 - 24).cast("double") + di * F.lit(0.1)
    return li.select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("scene_id"),
        F.col("l_shipdate").alias("ts"),
        tile.alias("tile_id"),
        y.alias("y"),
        x.alias("x"),
        (F.lit(-168.0) + (tile % TILES_ACROSS * TILE_PX + x) * F.lit(PIXEL_DEG)).alias("lon"),
        (F.lit(50.0) - (F.floor(tile / TILES_ACROSS) * TILE_PX + y) * F.lit(PIXEL_DEG)).alias("lat"),
        ((doy * 7 + F.year("l_shipdate")) % 100).cast("double").alias("cloud_pct"),
        F.when(day % 10 == 7, "EW").otherwise("IW").alias("mode"),
        F.when(day % 9 == 4, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("pols"),
        F.when(F.month("l_shipdate") % 2 == 0, "ASCENDING").otherwise("DESCENDING").alias("orbit_pass"),
        (doy % 12).cast("bigint").alias("relative_orbit"),
        *[c.alias(b) for b, c in bands.items()],
        vv.alias("VV"),
        (vv - 5.0 - ti * F.lit(0.5)).alias("VH"),
        F.when(qi != 50, (F.col("l_linenumber") * 13 + F.col("l_partkey")) % 100).alias("prob"),
        (day != 1).alias("prob_present"),
    )


_PX_SQL = f"""
SELECT strftime(l_shipdate, '%Y%m%d') AS scene_id, l_shipdate AS ts, tile_id, y, x,
  -168.0 + (tile_id % {TILES_ACROSS} * {TILE_PX} + x) * {PIXEL_DEG} AS lon,
  50.0 - (tile_id // {TILES_ACROSS} * {TILE_PX} + y) * {PIXEL_DEG} AS lat,
  CAST((dayofyear(l_shipdate) * 7 + year(l_shipdate)) % 100 AS DOUBLE) AS cloud_pct,
  CASE WHEN day(l_shipdate) % 10 = 7 THEN 'EW' ELSE 'IW' END AS mode,
  CASE WHEN day(l_shipdate) % 9 = 4 THEN ['VV'] ELSE ['VV', 'VH'] END AS pols,
  CASE WHEN month(l_shipdate) % 2 = 0 THEN 'ASCENDING' ELSE 'DESCENDING' END AS orbit_pass,
  dayofyear(l_shipdate) % 12 AS relative_orbit,
  {", ".join(f"{_dn_sql(b)} AS {b}" for b in BAND_MIX)},
  {", ".join(f"(pi % {m} + {s}) * CAST({k} AS DOUBLE) AS {b}" for b, (m, s, k) in GAS_MIX.items())},
  CAST((qi * 3) % 20 - 24 AS DOUBLE) + di * 0.1 AS VV,
  CAST((qi * 3) % 20 - 24 AS DOUBLE) + di * 0.1 - 5.0 - ti * 0.5 AS VH,
  CASE WHEN qi <> 50 THEN (l_linenumber * 13 + l_partkey) % 100 END AS prob,
  day(l_shipdate) <> 1 AS prob_present
FROM (SELECT *, l_suppkey // 4 AS tile_id, l_partkey % {TILE_PX} AS y, l_orderkey % {TILE_PX} AS x,
        CAST(l_quantity AS BIGINT) AS qi, CAST(round(l_discount * 100) AS BIGINT) AS di,
        CAST(round(l_tax * 100) AS BIGINT) AS ti, CAST(floor(l_extendedprice) AS BIGINT) AS pi
      FROM lineitem)
"""


def _known_plume() -> Column:
    dist2 = F.pow(F.col("y") - 8, 2) + F.pow(F.col("x") - 6, 2)
    return (F.lit(0.8) + F.col("chip_id") % 5 * F.lit(0.1)) * F.exp(-dist2 / 8.0)


@lru_cache(maxsize=4)
def chips(spark: SparkSession, sf: str) -> DataFrame:
    """Dense two-pass chips: (chip, pass, y, x) with reflectances and a known plume.

    Pass 1 carries a Gaussian methane enhancement ``truth_do`` absorbed in B12, pass 0
    is plume free, and every fourth chip has one lit pixel.
    """
    li = read(spark, sf, "lineitem")
    base = li.select(
        F.expr("l_suppkey div 4").alias("chip_id"),
        (F.col("l_linenumber") % 2).cast("bigint").alias("pass"),
        (F.col("l_partkey") % TILE_PX).alias("y"),
        (F.col("l_orderkey") % TILE_PX).alias("x"),
        F.col("l_quantity").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("di"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("ti"),
        F.floor("l_extendedprice").alias("pi"),
    )
    r11 = 0.2 + F.col("q") * 0.001 + (F.col("pi") % 41 - 20) * F.lit(0.0001)
    agg = base.groupBy("chip_id", "pass", "y", "x").agg(
        F.avg(0.08 + F.col("ti") * F.lit(0.002)).alias("b2"),
        F.avg(0.09 + F.col("q") * 0.0004).alias("b3"),
        F.avg(0.1 + F.col("q") * 0.0005).alias("b4"),
        F.avg(0.25 + F.col("di") * F.lit(0.005)).alias("b8a"),
        F.avg(r11).alias("b11"),
        F.avg(r11 * 0.8 * (1.0 + (F.col("pi") % 31 - 15) * F.lit(0.0004))).alias("b12"),
    )
    truth = _known_plume()
    hot = F.when((F.col("chip_id") % 4 == 1) & (F.col("y") == 3) & (F.col("x") == 12), 6.0).otherwise(1.0)
    return agg.select(
        "chip_id", "pass", "y", "x", "b2", "b3", "b4", "b8a", "b11",
        (F.col("b12") * hot * F.when(F.col("pass") == 1, F.exp(-0.115 * truth)).otherwise(1.0)).alias("b12"),
        truth.alias("truth_do"),
    )


_CHIPS_SQL = f"""
SELECT chip_id, pass, y, x, b2, b3, b4, b8a, b11,
  b12 * (CASE WHEN chip_id % 4 = 1 AND y = 3 AND x = 12 THEN 6.0 ELSE 1.0 END)
      * (CASE WHEN pass = 1 THEN exp(-0.115 * truth_do) ELSE 1.0 END) AS b12, truth_do
FROM (SELECT *, (0.8 + chip_id % 5 * 0.1) * exp(-(pow(y - 8, 2) + pow(x - 6, 2)) / 8.0) AS truth_do
  FROM (SELECT chip_id, pass, y, x,
      avg(0.08 + ti * 0.002) AS b2, avg(0.09 + q * 0.0004) AS b3, avg(0.1 + q * 0.0005) AS b4,
      avg(0.25 + di * 0.005) AS b8a, avg(0.2 + q * 0.001 + (pi % 41 - 20) * 0.0001) AS b11,
      avg((0.2 + q * 0.001 + (pi % 41 - 20) * 0.0001) * 0.8 * (1.0 + (pi % 31 - 15) * 0.0004)) AS b12
    FROM (SELECT l_suppkey // 4 AS chip_id, CAST(l_linenumber % 2 AS BIGINT) AS pass,
        l_partkey % {TILE_PX} AS y, l_orderkey % {TILE_PX} AS x, l_quantity AS q,
        CAST(round(l_discount * 100) AS BIGINT) AS di, CAST(round(l_tax * 100) AS BIGINT) AS ti,
        CAST(floor(l_extendedprice) AS BIGINT) AS pi FROM lineitem)
    GROUP BY chip_id, pass, y, x))
"""


@lru_cache(maxsize=4)
def chip_sums(spark: SparkSession, sf: str) -> DataFrame:
    """B11 of the chips as whole sums: ``s`` in millionths over ``n`` readings, the same in every order of the rows."""
    li = read(spark, sf, "lineitem")
    millionths = F.lit(200_000) + F.round(F.col("l_quantity") * 1000).cast("bigint") + (F.floor("l_extendedprice") % 41 - 20) * 100
    return li.groupBy(
        F.expr("l_suppkey div 4").alias("chip_id"),
        (F.col("l_linenumber") % 2).cast("bigint").alias("pass"),
        (F.col("l_partkey") % TILE_PX).alias("y"),
        (F.col("l_orderkey") % TILE_PX).alias("x"),
    ).agg(F.sum(millionths).alias("s"), F.count(millionths).alias("n")).withColumn("truth_do", _known_plume())


_CHIP_SUMS_SQL = f"""
SELECT *, (0.8 + chip_id % 5 * 0.1) * exp(-(pow(y - 8, 2) + pow(x - 6, 2)) / 8.0) AS truth_do
FROM (SELECT l_suppkey // 4 AS chip_id, CAST(l_linenumber % 2 AS BIGINT) AS pass, l_partkey % {TILE_PX} AS y, l_orderkey % {TILE_PX} AS x,
  CAST(sum(200000 + CAST(round(l_quantity * 1000) AS BIGINT) + (CAST(floor(l_extendedprice) AS BIGINT) % 41 - 20) * 100) AS BIGINT) AS s, count(l_quantity + l_extendedprice) AS n
  FROM lineitem GROUP BY ALL)
"""


@lru_cache(maxsize=4)
def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Cell readings: one row per event."""
    ev = read(spark, sf, "events")
    return ev.select(
        F.col("event_type").alias("series_id"),
        F.col("ts"),
        F.to_date("ts").alias("date"),
        F.col("user_id").alias("cell"),
        F.col("value"),
        (F.col("event_id") % 7).alias("weight"),
        F.concat(F.col("event_type"), F.lit("_"), (F.col("event_id") % 11).cast("string")).alias("scene_kind"),
        "event_id",
    )


_OBS_SQL = """
SELECT event_type AS series_id, ts, CAST(ts AS DATE) AS date, user_id AS cell, value,
  event_id % 7 AS weight, event_type || '_' || CAST(event_id % 11 AS VARCHAR) AS scene_kind, event_id
FROM events
"""


def _plus_seconds(day: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds)


@lru_cache(maxsize=4)
def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Acquisitions: one row per order, ten customers to a site."""
    o = read(spark, sf, "orders")
    key = F.col("o_orderkey")
    ts = _plus_seconds(F.col("o_orderdate"), key * 7919 % 86400)
    return o.select(
        F.expr("o_custkey div 10").alias("site_id"),
        F.concat(
            F.date_format(ts, "yyyyMMdd'T'HHmmss"),
            F.lit("_T"), (key % 3 + 38).cast("string"), F.lit("RUN_"), key.cast("string"),
        ).alias("scene_id"),
        ts.alias("ts"),
        (F.floor("o_totalprice") % 100).cast("double").alias("cloud_pct"),
        (key % 5).alias("relative_orbit"),
        F.when(key % 2 == 0, "Sentinel-2A").otherwise("Sentinel-2B").alias("spacecraft"),
        (20 + key % 40).cast("double").alias("sun_zenith"),
        (key % 11).cast("double").alias("view_zenith"),
        key.alias("scene_no"),
    )


_SCENES_SQL = """
SELECT o_custkey // 10 AS site_id,
  strftime(ts, '%Y%m%dT%H%M%S') || '_T' || CAST(o_orderkey % 3 + 38 AS VARCHAR) || 'RUN_' || CAST(o_orderkey AS VARCHAR) AS scene_id,
  ts, CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud_pct,
  o_orderkey % 5 AS relative_orbit,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS spacecraft,
  CAST(20 + o_orderkey % 40 AS DOUBLE) AS sun_zenith, CAST(o_orderkey % 11 AS DOUBLE) AS view_zenith,
  o_orderkey AS scene_no
FROM (SELECT *, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS ts FROM orders)
"""


def _place(key: Column, block: Column, lat_step: int, lon_step: int) -> tuple[Column, Column]:
    lat = F.lit(-60.0) + F.floor(block / 170) * 2 + key * lat_step % 200 * F.lit(0.01)
    lon = F.lit(-170.0) + block % 170 * 2 + key * lon_step % 200 * F.lit(0.01)
    return lat, lon


@lru_cache(maxsize=4)
def dets(spark: SparkSession, sf: str) -> DataFrame:
    """Detections: one per customer, 1500 to a two-degree block."""
    c = read(spark, sf, "customer")
    key = F.col("c_custkey")
    lat, lon = _place(key, F.expr("c_custkey div 1500"), 37, 91)
    ts = F.timestamp_seconds(F.lit(1577836800) + key * 13 % 120 * 86400 + key * 61 % 86400)
    return c.select(key.alias("det_id"), lat.alias("lat"), lon.alias("lon"), ts.alias("ts"), F.col("c_acctbal").alias("q"))


_DETS_SQL = """
SELECT c_custkey AS det_id,
  -60.0 + (c_custkey // 1500 // 170) * 2 + c_custkey * 37 % 200 * 0.01 AS lat,
  -170.0 + (c_custkey // 1500) % 170 * 2 + c_custkey * 91 % 200 * 0.01 AS lon,
  CAST(to_timestamp(1577836800 + c_custkey * 13 % 120 * 86400 + c_custkey * 61 % 86400) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts,
  c_acctbal AS q
FROM customer
"""


@lru_cache(maxsize=4)
def refs(spark: SparkSession, sf: str) -> DataFrame:
    """Published events: one per supplier, 100 to a two-degree block."""
    s = read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    lat, lon = _place(key, F.expr("s_suppkey div 100"), 53, 29)
    ts = F.timestamp_seconds(F.lit(1577836800) + key * 17 % 120 * 86400 + key * 101 % 86400)
    return s.select(
        key.alias("event_id"), lat.alias("lat"), lon.alias("lon"), ts.alias("ts"),
        F.col("s_acctbal").alias("q_kg_h"),
        F.when(key % 3 == 0, "mirror").otherwise("live").alias("provenance"),
    )


_REFS_SQL = """
SELECT s_suppkey AS event_id,
  -60.0 + (s_suppkey // 100 // 170) * 2 + s_suppkey * 53 % 200 * 0.01 AS lat,
  -170.0 + (s_suppkey // 100) % 170 * 2 + s_suppkey * 29 % 200 * 0.01 AS lon,
  CAST(to_timestamp(1577836800 + s_suppkey * 17 % 120 * 86400 + s_suppkey * 101 % 86400) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts,
  s_acctbal AS q_kg_h, CASE WHEN s_suppkey % 3 = 0 THEN 'mirror' ELSE 'live' END AS provenance
FROM supplier
"""


@lru_cache(maxsize=4)
def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Stored detections: one per order with its customer as the site."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer")
    key = F.col("o_orderkey")
    px_n = key % 9
    flags = F.when(px_n == 0, F.lit('["no_plume"]')).when(key % 4 == 1, F.lit('["unstable_mask","flare_lit_target"]')).otherwise(F.lit("[]"))
    score = F.when(key % 2 == 1, F.concat(F.lit(',"score":'), (key % 10).cast("string"))).otherwise(F.lit(""))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("det_id"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("site_id"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("c_name")).alias("site_name"),
        F.concat(F.lit("S"), (F.floor(F.col("o_totalprice")) % 7).cast("string")).alias("scene_id"),
        F.when(key % 2 == 0, "physics").otherwise("ml").alias("source"),
        F.when(key % 5 == 0, "confirmed").when(key % 5 == 1, "rejected").otherwise("new").alias("status"),
        F.when(px_n != 0, F.col("o_totalprice")).alias("q_kg_h"),
        _plus_seconds(F.col("o_orderdate"), key * 31 % 86400).alias("created"),
        F.concat(F.lit('{"flags":'), flags, F.lit(',"plume":{"n_pixels":'), px_n.cast("string"), F.lit("}"), score, F.lit("}")).alias("result_json"),
        F.when(key % 6 == 0, F.lit(None).cast("string"))
        .when(key % 6 == 1, F.lit('{"matches":[]}'))
        .otherwise(F.lit('{"matches":[{"km":1},{"km":2}]}')).alias("emit_json"),
    )


_FEED_SQL = """
SELECT o_orderkey AS det_id, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END AS site_id,
  CASE WHEN o_custkey % 11 <> 0 THEN c_name END AS site_name,
  'S' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 7 AS VARCHAR) AS scene_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'physics' ELSE 'ml' END AS source,
  CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'new' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS q_kg_h,
  o_orderdate + to_seconds(o_orderkey * 31 % 86400) AS created,
  '{"flags":' || CASE WHEN o_orderkey % 9 = 0 THEN '["no_plume"]' WHEN o_orderkey % 4 = 1 THEN '["unstable_mask","flare_lit_target"]' ELSE '[]' END
   || ',"plume":{"n_pixels":' || CAST(o_orderkey % 9 AS VARCHAR) || '}' || CASE WHEN o_orderkey % 2 = 1 THEN ',"score":' || CAST(o_orderkey % 10 AS VARCHAR) ELSE '' END || '}' AS result_json,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"matches":[]}' ELSE '{"matches":[{"km":1},{"km":2}]}' END AS emit_json
FROM orders JOIN customer ON o_custkey = c_custkey
"""


@lru_cache(maxsize=4)
def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Published against retrieved rates: one pair per part."""
    p = read(spark, sf, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("id"),
        F.col("p_brand").alias("site"),
        F.when(key % 2 == 0, "mbsp").otherwise("mbmp").alias("method"),
        F.when(key % 3 == 0, "blind").otherwise("hinted").alias("mode"),
        F.col("p_retailprice").alias("q_ref"),
        (F.col("p_retailprice") * (1.0 + (key * 17 % 101 - 50) / F.lit(125.0))).alias("q_ours"),
        (F.col("p_size") * F.lit(1000.0)).alias("q_true"),
        (key % 4 != 0).alias("detected"),
        (key % 10 * F.lit(0.05)).alias("invalid_fraction"),
        (2.0 + key % 9 * F.lit(0.5)).alias("u10"),
        (key % 97 * F.lit(0.01)).alias("iou"),
        (key % 61 - 30).cast("double").alias("bias_ppb"),
        (50 + key % 700).cast("double").alias("sigma"),
        (key % 6 == 0).cast("int").alias("n_hot"),
        key.alias("part_no"),
    )


_TRUTH_SQL = """
SELECT p_partkey AS id, p_brand AS site, CASE WHEN p_partkey % 2 = 0 THEN 'mbsp' ELSE 'mbmp' END AS method,
  CASE WHEN p_partkey % 3 = 0 THEN 'blind' ELSE 'hinted' END AS mode, p_retailprice AS q_ref,
  p_retailprice * (1.0 + (p_partkey * 17 % 101 - 50) / 125.0) AS q_ours, p_size * 1000.0 AS q_true,
  p_partkey % 4 <> 0 AS detected, p_partkey % 10 * 0.05 AS invalid_fraction, 2.0 + p_partkey % 9 * 0.5 AS u10,
  p_partkey % 97 * 0.01 AS iou, CAST(p_partkey % 61 - 30 AS DOUBLE) AS bias_ppb,
  CAST(50 + p_partkey % 700 AS DOUBLE) AS sigma, CAST(p_partkey % 6 = 0 AS INTEGER) AS n_hot, p_partkey AS part_no
FROM part
"""


@lru_cache(maxsize=4)
def wind(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly wind grids of two collections, one value per hour and cell where present."""
    ev = read(spark, sf, "events")
    base = ev.select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        F.expr("user_id div 10").alias("cell"),
        F.col("value"),
        (F.col("event_type") == "view").alias("is_view"),
    )
    both = base.withColumn(
        "collection_id",
        F.explode(F.when(F.col("is_view"), F.array(F.lit("global"))).otherwise(F.array(F.lit("land"), F.lit("global")))),
    )
    return both.groupBy("collection_id", "ts", "cell").agg(
        (F.avg("value") / 40.0 - 2.0).alias("u"), (F.avg(F.col("value") % 13) / 3.0 - 2.0).alias("v")
    )


_WIND_SQL = """
SELECT collection_id, ts, cell, avg(value) / 40.0 - 2.0 AS u, avg(value % 13) / 3.0 - 2.0 AS v
FROM (SELECT date_trunc('hour', ts) AS ts, user_id // 10 AS cell, value,
        unnest(CASE WHEN event_type = 'view' THEN ['global'] ELSE ['land', 'global'] END) AS collection_id FROM events)
GROUP BY collection_id, ts, cell
"""


@lru_cache(maxsize=4)
def wind_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Moments at which a wind is wanted: one per customer in the event month."""
    c = read(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("req_id"),
        F.expr("c_custkey div 100").alias("cell"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey") * 1709 % 2505600).alias("ts"),
    )


_WIND_REQ_SQL = """
SELECT c_custkey AS req_id, c_custkey // 100 AS cell,
  CAST(to_timestamp(1704067200 + c_custkey * 1709 % 2505600) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts
FROM customer
"""


@lru_cache(maxsize=4)
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding images: two zones and two years per pixel."""
    e = read(spark, sf, "embeddings")
    key = F.col("vec_id")
    return e.select(
        F.expr("vec_id div 4").alias("pixel_id"),
        (2020 + key % 2).alias("year"),
        (key.bitwiseAND(F.lit(2)) / 2).cast("bigint").alias("zone"),
        key.alias("vec_id"), "embedding", "label",
    )


_VECTORS_SQL = """
SELECT vec_id // 4 AS pixel_id, 2020 + vec_id % 2 AS year, CAST((vec_id & 2) // 2 AS BIGINT) AS zone, vec_id, embedding, label
FROM embeddings
"""


def lut(spark: SparkSession) -> DataFrame:
    """Synthetic forward curves of two versions on a (spacecraft, air mass, column) grid.

    Parameter table of fixed size: 2 versions x 2 spacecraft x 9 air masses x 131 steps.
    """
    n = 131
    grid = spark.range(2 * 2 * 9 * n).select(
        F.expr(f"id div {2 * 9 * n}").alias("iv"),
        F.expr(f"id div {9 * n} % 2").alias("isc"),
        F.expr(f"id div {n} % 9").alias("ia"),
        (F.col("id") % n).alias("io"),
    )
    amf = 2.0 + F.col("ia") * 0.25
    d_omega = -0.5 + F.col("io") * F.lit(LUT_STEP)
    k = F.lit(0.05) + F.col("isc") * 0.002 + F.col("iv") * 0.001
    return grid.select(
        F.when(F.col("iv") == 0, "report").otherwise("mask").alias("lut_version"),
        F.when(F.col("isc") == 0, "Sentinel-2A").otherwise("Sentinel-2B").alias("spacecraft"),
        amf.alias("amf"),
        d_omega.alias("delta_omega"),
        (F.exp(-k * amf * d_omega) - 1.0).alias("m"),
    )


_LUT_SQL = f"""
SELECT CASE WHEN iv = 0 THEN 'report' ELSE 'mask' END AS lut_version,
  CASE WHEN isc = 0 THEN 'Sentinel-2A' ELSE 'Sentinel-2B' END AS spacecraft,
  2.0 + ia * 0.25 AS amf, -0.5 + io * {LUT_STEP} AS delta_omega,
  exp(-(0.05 + isc * 0.002 + iv * 0.001) * (2.0 + ia * 0.25) * (-0.5 + io * {LUT_STEP})) - 1.0 AS m
FROM (SELECT unnest(range(2)) AS iv), (SELECT unnest(range(2)) AS isc), (SELECT unnest(range(9)) AS ia), (SELECT unnest(range(131)) AS io)
"""

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), _PX_SQL),
    "chips": ((), _CHIPS_SQL),
    "chip_sums": ((), _CHIP_SUMS_SQL),
    "obs": ((), _OBS_SQL),
    "scenes": ((), _SCENES_SQL),
    "dets": ((), _DETS_SQL),
    "refs": ((), _REFS_SQL),
    "feed": ((), _FEED_SQL),
    "truth": ((), _TRUTH_SQL),
    "wind": ((), _WIND_SQL),
    "wind_requests": ((), _WIND_REQ_SQL),
    "vectors": ((), _VECTORS_SQL),
    "lut": ((), _LUT_SQL),
}
