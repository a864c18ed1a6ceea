"""Fractional signal to column enhancement through a tabulated forward curve.

The table is tiny and of fixed size: one array per (version, spacecraft, air mass). The two
arrays that bracket a scene's air mass reach every pixel by a broadcast join, and the segment
that holds the signal is found by bisection inside the row. There is no shuffle and no
exploded table however many scenes and pixels there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_STEPS = 1024


def curve_table(lut: DataFrame) -> DataFrame:
    """One row per (version, spacecraft, air-mass step): lower and upper curve, column grid ascending.

    A table of more than ``MAX_STEPS`` columns per curve is refused, which bounds the broadcast.
    """
    rows = lut.groupBy("lut_version", "spacecraft", "amf").agg(F.sort_array(F.collect_list(F.struct("delta_omega", "m"))).alias("c"))
    w = Window.partitionBy("lut_version", "spacecraft").orderBy("amf")
    n = F.size("c")
    ok = F.when(n > MAX_STEPS, F.raise_error(F.lit("forward curve is too long")).cast("int")).otherwise(n)
    seg = rows.select(
        "lut_version", "spacecraft", "amf", ok.alias("n_steps"),
        F.transform("c", lambda s: s["delta_omega"]).alias("grid"), F.transform("c", lambda s: s["m"]).alias("lo"),
        F.lead("amf").over(w).alias("amf_hi"), F.lead(F.transform("c", lambda s: s["m"])).over(w).alias("hi"),
        F.row_number().over(w).alias("step"), F.min("amf").over(Window.partitionBy("lut_version", "spacecraft")).alias("amf_min"),
        F.max("amf").over(Window.partitionBy("lut_version", "spacecraft")).alias("amf_max"),
    )
    return seg.where(F.col("hi").isNotNull()).withColumnRenamed("amf", "amf_lo")


def invert_signal(pixels: DataFrame, lut: DataFrame, version: str, signal: str, output: str, *, spacecraft: str = "spacecraft",
                  amf: str = "amf") -> DataFrame:
    """Add ``output`` = column enhancement of ``signal`` by linear interpolation.

    The segment of a scene's air mass is found among the air masses that the table itself has for
    the spacecraft, evenly spaced or not. The air mass is held inside the table, signals beyond
    the tabulated ones take the end columns and a NULL signal stays NULL. ``m`` falls with the
    column, so the bisection looks for the last grid point whose ``m`` is still at least the signal.
    """
    table = curve_table(lut.where(F.col("lut_version") == version))
    starts = table.groupBy(F.col("spacecraft").alias("_sc")).agg(F.sort_array(F.collect_set("amf_lo")).alias("_starts"))
    curves = table.select(F.col("spacecraft").alias("_of_sc"), F.col("step").alias("_of_step"), "amf_lo", "amf_hi", "grid", "lo", "hi", "n_steps")
    keyed = pixels.join(F.broadcast(starts), F.col(spacecraft) == F.col("_sc"), "left")
    keyed = keyed.withColumn("_step", F.greatest(F.size(F.filter("_starts", lambda a: a <= F.col(amf))), F.lit(1)))
    j = keyed.join(F.broadcast(curves), (F.col("_sc") == F.col("_of_sc")) & (F.col("_step") == F.col("_of_step")), "left")
    held = F.greatest(F.col("amf_lo"), F.least(F.col("amf_hi"), F.col(amf)))
    t = (held - F.col("amf_lo")) / (F.col("amf_hi") - F.col("amf_lo"))

    def curve_at(i: Column, weight: Column) -> Column:
        a, b = F.get(F.col("lo"), i), F.get(F.col("hi"), i)
        return a + (b - a) * weight

    v = F.col(signal)
    halvings = F.array(*[F.lit(2**e) for e in range(10, -1, -1)])
    seg = F.aggregate(
        halvings, F.lit(0),
        lambda at, step: F.when((at + step <= F.col("n_steps") - 2) & (curve_at(at + step, t) >= v), at + step).otherwise(at),
    )
    located = j.withColumn("_i", F.when(v.isNotNull(), seg)).withColumn("_t", t)
    i = F.col("_i")
    m0, m1 = curve_at(i, F.col("_t")), curve_at(i + 1, F.col("_t"))
    g0, g1 = F.get(F.col("grid"), i), F.get(F.col("grid"), i + 1)
    inner = g0 + (g1 - g0) * F.try_divide(m0 - v, m0 - m1)
    value = F.when(v >= m0, g0).when(v <= m1, g1).otherwise(inner)
    return located.select(*pixels.columns, F.when(v.isNotNull() & F.col(amf).isNotNull(), value).alias(output))
