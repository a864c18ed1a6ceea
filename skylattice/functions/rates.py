"""Emission rates from loosely named columns, never guessing a unit.

A record is an ordered array of (key, value) text pairs with lower-case keys.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names that mean a rate or its uncertainty (name, kind, unit), the order in
# which names without a unit count, endings that declare a unit, parts that mark an uncertainty,
# names of places and times, and the sanity limit.
NAMES = (
    ("ch4_fluxrate", "rate", "kg_h"), ("rate", "rate", None), ("q", "rate", None), ("emission_rate", "rate", None),
    ("ch4_fluxrate_std", "sigma", "kg_h"), ("sigma", "sigma", None), ("uncertainty", "sigma", None), ("q_sigma", "sigma", None), ("error", "sigma", None),
)
ENDINGS = (("_t_h", "t_h"), ("_th", "t_h"), ("_kg_h", "kg_h"), ("_kgh", "kg_h"))
SIGMA_TOKENS = ("sigma", "uncertainty", "error", "_std")
MAX_KG_H = 500_000.0
LAT_KEYS = ("lat", "latitude")
LON_KEYS = ("lon", "lng", "longitude")
DATE_KEYS = ("date", "datetime", "detection_date", "time", "event_time_utc", "tile_date")


def reading(key: Column, value: Column, place: Column) -> Column:
    """What one pair of a record says: (kind, no unit, order, unit, value); a kind of NULL says nothing.

    Readings sort by preference: with a unit in the order of the record, then without one in the
    order of the names. The column that is made for an uncertainty in kg/h comes before others.
    """
    unit, kind, order = F.lit(None).cast("string"), F.lit(None).cast("string"), place
    for ending, declared in ENDINGS:
        unit = F.when(F.endswith(key, F.lit(ending)), declared).otherwise(unit)
    marked = F.exists(F.array(*[F.lit(t) for t in SIGMA_TOKENS]), lambda t: F.contains(key, t))
    kind = F.when(unit.isNotNull(), F.when(marked, "sigma").otherwise("rate"))
    for i, (name, of, declared) in enumerate(NAMES):
        exact = key == name
        kind, unit = F.when(exact, of).otherwise(kind), F.when(exact, F.lit(declared).cast("string")).otherwise(unit)
        if declared is None:
            order = F.when(exact, F.lit(i)).otherwise(order)
        elif of == "sigma":
            order = F.when(exact, F.lit(-1)).otherwise(order)
    return F.struct(kind.alias("kind"), unit.isNull().alias("no_unit"), order.cast("int").alias("order"), unit.alias("unit"), value.alias("value"))


def telling(key: Column) -> Column:
    """Whether a pair with this key can say anything: most keys of a record cannot, and a reading costs far more than this."""
    return F.array_contains(F.array(*[F.lit(name) for name, _, _ in NAMES]), key) | reduce(or_, [F.endswith(key, F.lit(ending)) for ending, _ in ENDINGS])


def filled(record: Column) -> Column:
    """The pairs of a record that carry a value."""
    return F.filter(record, lambda e: e["value"].isNotNull() & (e["value"] != ""))


def last_per_key(rows: Column) -> Column:
    """One pair per key, the last one given (two headers may differ in case only)."""
    back = F.reverse(rows)
    last = F.filter(back, lambda e, i: F.array_position(back["key"], e["key"]) == i + 1)
    return F.when(F.size(F.array_distinct(rows["key"])) == F.size(rows), back).otherwise(last)


def lookup(rows: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first alias among filled pairs, in the order of the aliases."""

    def first(key: str) -> Column:
        return F.get(rows["value"], F.array_position(rows["key"], key).cast("int") - 1)

    return F.coalesce(*[first(k) for k in keys])


def with_candidates(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds the filled pairs of a record and its preferred reading of a rate and of an uncertainty, as ``_rate_...`` columns."""
    rows = df.withColumn("_rate_rows", filled(F.col(record)))
    told = F.filter("_rate_rows", lambda e: telling(e["key"]))
    rows = rows.withColumn("_rate_read", F.transform(told, lambda e, i: reading(e["key"], e["value"], i)))
    best = lambda kind: F.array_min(F.filter("_rate_read", lambda r: r["kind"] == kind))
    return rows.withColumns({"_rate_best": best("rate"), "_rate_sigma": best("sigma")}).drop("_rate_read")


def resolve_rate(unit: str = "auto") -> Column:
    """Struct (q_kg_h, rate_unit, dropped) from the candidate columns.

    A unit in the column name wins; an unnamed unit is dropped under ``auto``.
    """
    if unit not in ("auto", "t_h", "kg_h"):
        raise ValueError("unit must be auto, t_h or kg_h")
    best = F.col("_rate_best")
    use_unit = F.coalesce(best["unit"], F.lit(None if unit == "auto" else unit).cast("string"))
    raw = best["value"].try_cast("double") * F.when(use_unit == "t_h", 1000.0).otherwise(1.0)
    ambiguous = best.isNotNull() & use_unit.isNull()
    known = best.isNotNull() & use_unit.isNotNull()
    over = known & F.coalesce(F.abs(raw) > MAX_KG_H, F.lit(False))
    return F.struct(
        F.when(known & ~over, raw).alias("q_kg_h"), F.when(known, use_unit).alias("rate_unit"),
        F.when(ambiguous, "ambiguous_unit").when(over, "over_500_th_guard").alias("dropped"),
    )


def resolve_sigma(rate_unit: Column) -> Column:
    """Sigma in kg/h: its own declared unit, else the unit the rate was read in, else NULL."""
    best = F.col("_rate_sigma")
    unit = F.coalesce(best["unit"], rate_unit)
    return best["value"].try_cast("double") * F.when(unit == "t_h", 1000.0).when(unit == "kg_h", 1.0)
