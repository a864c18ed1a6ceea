"""One query per built-in product: summary per tile over all observations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN, Product, all_products
from skylattice.operators import composites
from skylattice.plans import views as v
from skylattice.plans.registry import REGISTRY, Registered, compose
from skylattice.plans.scan_queries import CLEAR_SQL, r6
from skylattice.sources import scans

ALL = ("1990-01-01", "2010-01-01")
REF = ("1995-01-01", "1998-01-01")
NOW = ("1998-01-01", "2001-01-01")
_REF_SQL = "ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1998-01-01'"
_NOW_SQL = "ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '2001-01-01'"
_IW_SQL = "mode = 'IW' AND list_contains(pols, 'VV') AND list_contains(pols, 'VH')"

# SQL of the products whose text is not plain arithmetic over band names.
_SQL = {
    "CHLA": "4.26 * pow(B5 / B4, 3.94)",
    "RVI": "4 * pow(10, VH / 10) / (pow(10, VV / 10) + pow(10, VH / 10))",
}


def _safe(expression: str) -> str:
    """Divisors guarded so that x/0 is NULL in SQL too."""
    out, i = "", 0
    while i < len(expression):
        ch = expression[i]
        out += ch
        i += 1
        if ch == "/":
            while expression[i] == " ":
                i += 1
            if expression[i] == "(":
                depth, j = 0, i
                while True:
                    depth += {"(": 1, ")": -1}.get(expression[j], 0)
                    j += 1
                    if depth == 0:
                        break
            else:
                j = re.compile(r"\w+").match(expression, i).end()
            out += f" nullif({expression[i:j]}, 0)"
            i = j
    return out


def _summary_sql(body: str) -> str:
    return f"""SELECT tile_id, count(*) AS n, count(value) AS n_valid, round(avg(value), 6) AS mean,
      round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM ({body}) GROUP BY tile_id"""


def _summary(df):
    return df.groupBy("tile_id").agg(
        F.count("*").alias("n"), F.count("value").alias("n_valid"), r6(F.avg("value")).alias("mean"),
        r6(F.min("value")).alias("lo"), r6(F.max("value")).alias("hi"),
    )


def _optical_bands_sql(p: Product) -> str:
    bands = p.bands or (p.band,)
    return ", ".join(f"CASE WHEN {CLEAR_SQL} THEN {b} / 10000.0 END AS {b}" for b in bands)


def _one_window_sql(p: Product) -> str:
    if p.dataset_id == "s2":
        expr = _SQL.get(p.key) or (_safe(p.expression) if p.expression else p.band)
        inner = f"SELECT tile_id, {_optical_bands_sql(p)} FROM px WHERE cloud_pct <= 65"
        return _summary_sql(f"SELECT tile_id, {expr} AS value FROM ({inner})")
    if p.dataset_id == "s1":
        expr = _SQL.get(p.key) or p.expression or p.band
        return _summary_sql(f"SELECT tile_id, {expr} AS value FROM px WHERE {_IW_SQL}")
    band = p.band
    return _summary_sql(
        f"SELECT tile_id, CASE WHEN {band} BETWEEN {p.valid_min:.6f} AND {p.valid_max:.6f} THEN {band} * {p.display_scale:.1f} END AS value FROM px"
    )


def _register(name: str, build, sql: str) -> None:
    REGISTRY[name] = Registered(name, build, compose(sql, ("px",)))


def _one_window(p: Product):
    def build(spark, sf):
        df = scans.collection(v.px(spark, sf), p.key, p.dataset_id, None, *ALL)
        return _summary(df.withColumn("value", F.col("value") * p.display_scale))

    return build


def _rgb(spark, sf):
    df = scans.optical_product(v.px(spark, sf), BUILTIN["s2"].get("RGB"), None, *ALL)
    return df.groupBy("tile_id").agg(
        F.count("*").alias("n"), r6(F.avg("value.B4")).alias("r"), r6(F.avg("value.B3")).alias("g"), r6(F.avg("value.B2")).alias("b")
    )


def _compare(p: Product):
    def build(spark, sf):
        px = v.px(spark, sf)
        if p.dataset_id == "s2":
            base = scans.optical_base(px, None, *ALL, p.bands)
        else:
            base = px.where(scans.radar_filters())
        return _summary(composites.compare_windows(base, p, REF, NOW))

    return build


def _compare_sql(p: Product) -> str:
    if p.dataset_id == "s2":
        base = f"SELECT tile_id, y, x, ts, {_optical_bands_sql(p)} FROM px WHERE cloud_pct <= 65"
    else:
        base = f"SELECT tile_id, y, x, ts, VV FROM px WHERE {_IW_SQL}"
    means = ", ".join(
        f"avg(CASE WHEN {_REF_SQL} THEN {b} END) AS pre_{b}, avg(CASE WHEN {_NOW_SQL} THEN {b} END) AS post_{b}" for b in p.bands
    )
    stacked = f"SELECT tile_id, y, x, {means} FROM ({base}) WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2001-01-01' GROUP BY ALL"
    return _summary_sql(f"SELECT tile_id, {_safe(p.expression)} AS value FROM ({stacked})")


def _anomaly(spark, sf):
    from datetime import date

    base = scans.optical_base(v.px(spark, sf), None, *ALL, ("B11", "B12"))
    return _summary(composites.windowed_anomaly(base, date(1999, 6, 15), 200, REF))


_ANOMALY_SQL = _summary_sql(f"""
  SELECT tile_id, t - r AS value FROM (
    SELECT tile_id, y, x, avg(CASE WHEN ts >= TIMESTAMP '1998-11-27' AND ts < TIMESTAMP '2000-01-02' THEN ratio END) AS t,
      avg(CASE WHEN {_REF_SQL} THEN ratio END) AS r
    FROM (SELECT tile_id, y, x, ts, CASE WHEN {CLEAR_SQL} THEN (B12 / 10000.0) / nullif(B11 / 10000.0, 0) END AS ratio FROM px WHERE cloud_pct <= 65)
    GROUP BY ALL) WHERE t IS NOT NULL OR r IS NOT NULL""")

for _p in all_products():
    _name = f"product_{_p.dataset_id}_{_p.key.lower()}"
    if _p.is_rgb:
        _register(_name, _rgb, f"SELECT tile_id, count(*) AS n, round(avg(B4), 6) AS r, round(avg(B3), 6) AS g, round(avg(B2), 6) AS b FROM (SELECT tile_id, {_optical_bands_sql(_p)} FROM px WHERE cloud_pct <= 65) GROUP BY tile_id")
    elif _p.builder:
        _register(_name, _anomaly, _ANOMALY_SQL)
    elif _p.needs_ref:
        _register(_name, _compare(_p), _compare_sql(_p))
    else:
        _register(_name, _one_window(_p), _one_window_sql(_p))
