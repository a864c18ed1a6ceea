"""Emission rates over masks and their uncertainty."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.quantiles import chip_spread
from skylattice.functions.randoms import normals, pool_indices, pool_starts, uniforms
from skylattice.operators.plume import K_SWEEP
from skylattice.operators.winds import UEFF_OFFSET, UEFF_SLOPE, effective_wind

# Fixed values.
KG_PER_MOL = 0.01604
MODEL_SIGMA = 0.15
BLOCK_VALUES = 1 << 20  # indices of one table of draws
DRAWS = 500
WIND_FLOOR = 0.1
STABLE_RATIO = 4.0
HISTOGRAM_BINS = 24


def mass_kg(delta_omega: Column, area_m2: Column) -> Column:
    """Aggregate: column enhancement times pixel area and molar mass; missing pixels add nothing."""
    return F.coalesce(F.sum(delta_omega * area_m2 * KG_PER_MOL), F.lit(0.0))


def length_m(n_pixels: Column, area_m2: Column) -> Column:
    return F.sqrt(n_pixels * area_m2)


def rate_kg_h(u10: Column, length: Column, mass: Column) -> Column:
    """Q = U_eff / L times mass times 3600; NULL for an empty mask."""
    return F.try_divide(effective_wind(u10), length) * mass * 3600.0


def emission_over_mask(pixels: DataFrame, keys: Sequence[str], mask: DataFrame, chips: DataFrame) -> DataFrame:
    """Rate over a given mask, without draws.

    ``pixels``: keys, y, x, delta_omega. ``mask``: keys, y, x. ``chips``: keys, area_m2, u10.
    """
    keys = list(keys)
    tagged = pixels.join(mask.select(*keys, "y", "x").withColumn("m", F.lit(True)), [*keys, "y", "x"], "left")
    inside = F.col("m").isNotNull()
    per = tagged.join(chips, keys).groupBy(*keys).agg(
        F.count_if(inside).alias("n_pixels"), mass_kg(F.when(inside, F.col("delta_omega")), F.col("area_m2")).alias("ime_kg"),
        F.first("area_m2").alias("area_m2"), F.first("u10").alias("u10"),
    )
    noise = chip_spread(tagged.where(~inside), keys, "delta_omega").select(*keys, F.col("sigma").alias("sigma_noise"))
    length = length_m(F.col("n_pixels"), F.col("area_m2"))
    full = F.col("n_pixels") > 0
    return per.join(noise, keys, "left").select(
        *keys, "n_pixels", "ime_kg", F.when(full, length).otherwise(0.0).alias("l_m"), effective_wind(F.col("u10")).alias("u_eff"),
        F.when(full, rate_kg_h(F.col("u10"), length, F.col("ime_kg"))).alias("q_kg_h"),
        F.when(full, F.col("sigma_noise")).alias("sigma_noise"),
    )


def sweep_masses(pixels: DataFrame, keys: Sequence[str], masks: DataFrame, chips: DataFrame, ks: Sequence[float] = K_SWEEP) -> DataFrame:
    """Arrays over the k sweep, in order of k: ``n_k``, ``ime_k``, ``len_k`` per chip (zeros where a k empties the mask)."""
    keys = list(keys)
    at = masks.join(pixels.select(*keys, "y", "x", "delta_omega"), [*keys, "y", "x"], "left").join(chips.select(*keys, "area_m2"), keys)
    n, mass = [], []
    for k in ks:
        hit = F.col("k") == float(k)
        n.append(F.count_if(hit))
        mass.append(mass_kg(F.when(hit, F.col("delta_omega")), F.col("area_m2")))
    per = at.groupBy(*keys).agg(F.array(*n).alias("n_k"), F.array(*mass).alias("ime_k"), F.first("area_m2").alias("area_m2"))
    return per.withColumn("len_k", F.transform("n_k", lambda c: F.sqrt(c * F.col("area_m2"))))


def _noise(pool: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``sizes[i]`` values of the pool along the index sequence that begins at ``starts[i]``; one table of
    indices for all draws of one size, in blocks of ``BLOCK_VALUES``."""
    out = np.zeros(len(sizes))
    for n in np.unique(sizes[sizes > 0]) if len(pool) else ():
        own = np.flatnonzero(sizes == n)
        step = max(1, BLOCK_VALUES // int(n))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            out[some] = pool[pool_indices(starts[some, None], int(n), len(pool))].sum(axis=1)
    return out


def _draw_rates(keys: list[str], draws: int, seed: int):
    """Arrow-batched draws: one chip per row, all its draws as vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            qs = [_rates(row, draws, seed) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, "q": qs})

    def _rates(row, draws: int, seed: int) -> np.ndarray:
        name = row[len(keys)]
        n_k, ime_k, len_k = (np.asarray(a) for a in (row.n_k, row.ime_k, row.len_k))
        pool = np.asarray(row.pool if row.pool is not None else [], dtype=float)
        k = (uniforms(seed, name, draws, "k") * len(n_k)).astype(int)
        u10 = np.maximum(WIND_FLOOR, row.u10 + row.sigma_u10 * normals(seed, name, draws, "wind"))
        model = 1.0 + MODEL_SIGMA * normals(seed, name, draws, "model")
        noise = _noise(pool, n_k[k], pool_starts(seed, name, draws))
        mass = ime_k[k] + noise * row.area_m2 * KG_PER_MOL
        ok = len_k[k] > 0
        return (UEFF_SLOPE * u10[ok] + UEFF_OFFSET) / len_k[k][ok] * mass[ok] * 3600.0 * model[ok]

    return run


def _percentile(sorted_values: Column, n: Column, p: float) -> Column:
    pos = (n - 1) * F.lit(p)
    lo, hi = F.floor(pos).cast("int"), F.ceil(pos).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return a + (b - a) * (pos - F.floor(pos))


def monte_carlo(sweep: DataFrame, off_plume: DataFrame, keys: Sequence[str], name: Column, *, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Rate distribution per chip: median, spread, percentiles and a 24-bin histogram.

    Each draw picks a k, a wind, a model factor and a bootstrap of off-plume noise over as many
    pixels as that mask has. One row per chip holds its draws as arrays, so nothing is
    multiplied out. ``sweep`` carries ``n_k, ime_k, len_k, area_m2, u10, sigma_u10``;
    ``off_plume`` is ``keys, y, x, delta_omega`` outside the display mask; a chip bounds both.
    """
    keys = list(keys)
    pool = off_plume.where(F.col("delta_omega").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("y", "x", F.col("delta_omega").alias("v")))).alias("p")
    ).select(*keys, F.transform("p", lambda s: s["v"]).alias("pool"))
    df = sweep.join(pool, keys, "left").withColumn("_name", name.cast("string"))
    kept = [*keys, "_name", "n_k", "ime_k", "len_k", "area_m2", "u10", "sigma_u10", "pool"]
    types = dict(df.dtypes)
    # Few bytes but much work per row: the session's number of shuffle partitions, stated, is not merged down to one.
    spread = df.select(*kept).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    drawn = spread.mapInPandas(_draw_rates(keys, draws, seed), f"{ddl}, q array<double>")
    qs = drawn.withColumn("q", F.array_sort("q"))
    n = F.size("q")
    mean = F.aggregate("q", F.lit(0.0), lambda a, b: a + b) / n
    stats = qs.withColumns({"n_draws": n, "_mean": mean})
    var = F.aggregate("q", F.lit(0.0), lambda a, b: a + (b - F.col("_mean")) * (b - F.col("_mean"))) / F.col("n_draws")
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.col("n_draws") - 1)
    width = (hi - lo) / F.lit(float(HISTOGRAM_BINS))
    bins = F.sequence(F.lit(0), F.lit(HISTOGRAM_BINS - 1))

    def count(b: Column) -> Column:
        def within(q: Column) -> Column:
            at = F.when(width > 0, F.least(F.lit(HISTOGRAM_BINS - 1), F.floor((q - lo) / width))).otherwise(0)
            return at == b

        return F.size(F.filter("q", within))

    pct = {f"p{int(p * 100):02d}": _percentile(F.col("q"), F.col("n_draws"), p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)}
    return stats.where(F.col("n_draws") > 0).select(
        *keys, "n_draws", pct["p50"].alias("q_kg_h"), F.sqrt(var).alias("q_sigma_kg_h"),
        F.create_map(*[x for k, c in pct.items() for x in (F.lit(k), c)]).alias("percentiles"),
        F.struct(lo.alias("lo"), hi.alias("hi"), F.transform(bins, count).alias("counts")).alias("histogram"),
    )


def unstable(n_k: Column) -> Column:
    """The mask swings fourfold over the sweep, or some k empties it."""
    lo, hi = F.array_min(n_k), F.array_max(n_k)
    return (lo == 0) | (F.try_divide(hi, lo) >= STABLE_RATIO)
