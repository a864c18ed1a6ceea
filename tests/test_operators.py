"""Hand-computed and brute-force expectations for what the tables cannot show."""

from __future__ import annotations

import math
import threading
import time
from datetime import date, datetime

import check_queries
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from skylattice.catalog.expressions import band_math
from skylattice.catalog.products import BUILTIN, all_products
from skylattice.catalog.registry import get_product, refuse, resolve_source
from skylattice.functions import geo, joins, quantiles, randoms, rates, times
from skylattice.functions.inversion import invert_signal
from skylattice.functions.ranks import numbered, value_ranks
from skylattice.operators import builders, emission, frames, learning, matching, plume, retrieval, scene_choice, screening, series, statistics, vectors, winds
from skylattice.operators import morphology as mo
from skylattice.operators.components import connected_components
from skylattice.plans import views
from skylattice.sources import imports, scans
from skylattice.streaming import forms, running


def grid_rows(a, chip=0):
    return [(chip, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a) if not np.isnan(v)]


def chip_frame(spark, a, chip=0):
    return spark.createDataFrame(grid_rows(np.asarray(a, float), chip), "chip_id int, y bigint, x bigint, value double")


def test_catalog_and_refusals():
    assert len(all_products()) == 50
    assert resolve_source("CH4", "methane") == "s5p" and resolve_source("RVI", "methane") == "s1" and resolve_source("NDVI", "methane") == "s2"
    with pytest.raises(ValueError):
        refuse(get_product("DNBR", "s2"))
    with pytest.raises(ValueError):
        refuse(BUILTIN["s2"].get("RGB"), scalar=True)
    with pytest.raises(KeyError):
        get_product("NOPE", "s2")


def test_expressions(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0)], "A double, B double")
    got = [r[0] for r in df.select(band_math("(A - B) / B", {"A": F.col("A"), "B": F.col("B")})).collect()]
    assert got == [1.0, None]
    for bad in ("C + 1", "__import__('os')", "A if B else 1", "(select 1)"):
        with pytest.raises(ValueError):
            band_math(bad, {"A": F.col("A"), "B": F.col("B")})


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_exact_percentiles(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(1)
    values = {
        "hot": rng.lognormal(size=3000), "even": [1, 2, 3, 4], "one": [7.0], "same": [2.0, 2.0], "signs": rng.normal(size=501), "zeros": [-0.0, 0.0, 0.0, 1e-320, -1e-320],
        "wide": np.ldexp(rng.normal(size=400), rng.integers(-1000, 1000, 400)), "close": 1.0 + np.arange(2000) * 2.0**-52, None: [5.0, 6.0], "ends": [float("-inf"), 1.0, 2.0, 3.0, float("inf")],
    }
    rows = [(k, float(x)) for k, own in values.items() for x in own]
    df = spark.createDataFrame(rows + [("even", None), ("none", None)], "g string, v double")
    probs = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in quantiles.exact_percentiles(df, ("g",), "v", probs).collect()}
    assert set(got) == set(values)
    for g, own in values.items():
        assert got[g]["n"] == len(own)
        for name, p in probs.items():
            if g == "ends" and name != "p50":
                continue
            assert math.isclose(got[g][name], np.percentile(np.array(own, float), 100 * p), rel_tol=1e-14, abs_tol=1e-320), (g, name)
    total = quantiles.exact_percentiles(df, (), "v", {"m": 0.5}).first()
    assert math.isclose(total["m"], np.median([x for _, x in rows]))
    assert quantiles.exact_percentiles(df.limit(0), ("g",), "v", {"m": 0.5}).collect() == []
    null_key = quantiles.robust_spread(spark.createDataFrame([(None, 1.0), (None, 3.0), (None, None)], "g string, v double"), ("g",), "v").first()
    assert (null_key["g"], null_key["n"], null_key["median"], null_key["mad"]) == (None, 2, 2.0, 1.0)
    nan = quantiles.exact_percentiles(spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 2.0)], "g string, v double"), ("g",), "v", {"m": 0.5, "top": 1.0}).first()
    assert nan["m"] == 2.0 and math.isnan(nan["top"])


def test_labels_of_wide_chips(spark):
    rng = np.random.default_rng(4)
    picked = {(int(y), int(x)) for y, x in zip(rng.integers(0, 40, 1500), rng.integers(1000, 1060, 1500), strict=True)} | {(0, 1024), (0, 1025), (5, 70_000)}
    df = spark.createDataFrame([(1, y, x) for y, x in picked], "chip int, y bigint, x bigint")
    got = {(r["y"], r["x"]): r["label"] for r in mo.label_components(df, ["chip"], block=16).collect()}
    assert set(got) == picked
    left = set(picked)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            seen.add((y, x))
            near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            todo += near
        first = min(seen)
        assert {got[p] for p in seen} == {first[0] * mo.LABEL_ROW + first[1]}


def test_pack_and_pad_large(spark):
    df = spark.range(1024 * 1024).select(F.lit(1).alias("chip"), F.expr("id div 1024").alias("y"), (F.col("id") % 1024).alias("x"), (F.col("id") % 97).cast("double").alias("v")).where("id % 5 <> 0")
    row = mo.pack(df, ["chip"], ["v"], 1024, 1024).select(F.size("v").alias("n"), F.get("v", F.lit(7)).alias("a"), F.get("v", F.lit(10)).alias("b")).first()
    assert (row["n"], row["a"], row["b"]) == (1024 * 1024, 7.0, None)
    for n, multiple in ((1, 4), (2, 5), (5, 32), (7, 7)):
        line = spark.range(n).select(F.lit(0).cast("bigint").alias("y"), F.col("id").alias("x"), F.col("id").alias("v"))
        got = [r["v"] for r in mo.reflect_pad(line, [], 1, n, multiple).where("y = 0").orderBy("x").collect()]
        full = -(-n // multiple) * multiple
        assert got == np.pad(np.arange(n), (0, full - n), mode="reflect" if n > 1 else "edge").tolist()


def test_ranks_and_numbers(spark):
    df = spark.createDataFrame([("a", float(i % 7), i) for i in range(300)], "g string, v double, i bigint")
    got = {r["v"]: (r["n_equal"], r["n_below"]) for r in value_ranks(df, ("g",), "v").collect()}
    assert sum(n for n, _ in got.values()) == 300 and got[0.0][1] == 0 and got[6.0][1] == 300 - got[6.0][0]
    assert all(r["k"] == r["i"] for r in numbered(df, ("g",), "i", "k").collect())


def test_mass_of_three_pixels():
    expected = 3 * 0.5 * 400.0 * 0.01604
    assert math.isclose(expected, 9.624)


def test_mass_skips_missing(spark):
    df = spark.createDataFrame([(0.5,), (0.5,), (0.5,), (None,)], "d double")
    assert math.isclose(df.agg(emission.mass_kg(F.col("d"), F.lit(400.0))).first()[0], 9.624)
    assert math.isclose(spark.range(1).select(winds.effective_wind(F.lit(4.0))).first()[0], 0.33 * 4 + 0.45)


def test_opening_at_the_border_shrinks(spark):
    m = np.full((6, 6), np.nan)
    m[0:2, 0:5] = 1
    assert mo.opening(chip_frame(spark, m), ("chip_id",)).count() == 0
    m[0:3, 0:3] = 1
    assert {(r.y, r.x) for r in mo.opening(chip_frame(spark, m), ("chip_id",)).collect()} == {(y, x) for y in range(3) for x in range(3)}


def flood(mask):
    label = np.zeros(mask.shape, int)
    out = {}
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        stack, cells = [(y, x)], []
        label[y, x] = 1
        while stack:
            a, b = stack.pop()
            cells.append((int(a), int(b)))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not label[c, d]:
                        label[c, d] = 1
                        stack.append((c, d))
        out.update({c: min(p * mo.LABEL_ROW + q for p, q in cells) for c in cells})
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_labels_equal_flood_fill(spark, block):
    mask = np.random.default_rng(3).random((20, 23)) < 0.42
    df = chip_frame(spark, np.where(mask, 1.0, np.nan))
    got = {(r.y, r.x): r.label for r in mo.label_components(df, ("chip_id",), block).collect()}
    assert got == flood(mask)


def test_outline_counts_holes(spark):
    m = np.full((7, 7), np.nan)
    m[1:6, 1:6] = 1
    m[3, 3] = np.nan
    lab = mo.label_components(chip_frame(spark, m), ("chip_id",))
    areas = sorted(r.area_px for r in mo.outline_rings(lab, ("chip_id",), 0.0, 0.0, 1.0, 1.0).collect())
    assert areas == [-1.0, 25.0]


def test_plume_threshold_is_about_the_median(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 0.02, (30, 30))
    yy, xx = np.mgrid[0:30, 0:30]
    a += 0.6 * np.exp(-((yy - 15) ** 2 + (xx - 15) ** 2) / 18)
    n = [plume.detect_plumes(chip_frame(spark, a + shift), ("chip_id",)).count() for shift in (0.0, 5.0)]
    assert n[0] == n[1] > 20
    assert plume.detect_plumes(chip_frame(spark, np.zeros((9, 9))), ("chip_id",)).count() == 0


def test_hot_pixels(spark):
    rows = [(0.2, 0.2, 0.9), (0.2, 0.2, 0.005), (-0.1, 0.2, 0.2), (0.01, 0.2, 0.05), (None, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = [r[0] for r in df.select(retrieval.hot_pixel(F.lit("Sentinel-2A"), F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [True, False, False, True, False]
    with pytest.raises(Exception, match="unknown spacecraft"):
        df.select(retrieval.hot_pixel(F.lit("X"), F.col("a"), F.col("b"), F.col("c"))).collect()


def test_inversion_round_trip_and_clip(spark):
    amf, do = 2.6, np.array([-0.5, -0.1, 0.0, 0.37, 2.0, 5.9])
    m = np.exp(-0.05 * amf * do) - 1
    rows = [(i, "Sentinel-2A", amf, float(s)) for i, s in enumerate(m)] + [(6, "Sentinel-2A", amf, None), (7, "Sentinel-2A", amf, 9.0), (8, "Sentinel-2A", amf, -0.9)]
    df = spark.createDataFrame(rows, "i int, spacecraft string, amf double, s double")
    got = [r.d for r in invert_signal(df, views.lut(spark), "report", "s", "d").orderBy("i").collect()]
    assert np.allclose(got[:6], do, atol=1e-2)
    assert got[6] is None and got[7] == -0.5 and math.isclose(got[8], 6.0)


def test_retrieval_finds_the_calibration(spark):
    rng = np.random.default_rng(2)
    r12 = rng.uniform(0.15, 0.3, (20, 20))
    rows = [(0, int(y), int(x), float(1.25 * r12[y, x] * (1 + rng.normal(0, 1e-3))), float(r12[y, x] * (0.9 if (y - 10) ** 2 + (x - 10) ** 2 < 16 else 1))) for y in range(20) for x in range(20)]
    df = spark.createDataFrame(rows, "chip_id int, y bigint, x bigint, b11 double, b12 double")
    one = retrieval.single_pass(df, ("chip_id",), robust=True).first()
    assert abs(one.c - 1.25) < 0.01 and one.n_excluded > 40 and abs(one.c - 1.25) < abs(one.c_initial - 1.25)


def brute_reference(scenes):
    out = {}
    for t in scenes:
        best = None
        for c in scenes:
            d = abs((c[2] - t[2]).total_seconds()) / 86400
            if c[1] == t[1] or c[3] > 30 or not 1 <= d <= 120:
                continue
            key = (d + (30 if c[4] != t[4] else 0) + (5 if c[5] != t[5] else 0), c[2], c[1])
            best = min(best, key) if best else key
        out[t[1]] = best[2] if best else None
    return out


def test_reference_choice_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = datetime(2018, 1, 1).timestamp()
    scenes = [(0, f"s{i:03d}", datetime.fromtimestamp(base + float(rng.integers(0, 400 * 86400))), float(rng.integers(0, 60)), int(rng.integers(0, 3)), "AB"[int(rng.integers(0, 2))]) for i in range(150)]
    df = spark.createDataFrame(scenes, "site_id int, scene_id string, ts timestamp, cloud_pct double, relative_orbit bigint, spacecraft string")
    got = {r.scene_id: r.reference.scene_id if r.reference else None for r in scene_choice.pick_reference(df, df).collect()}
    assert got == brute_reference(scenes)


def test_ranked_references_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scene_choice, "_HELD_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    rng = np.random.default_rng(6)
    scenes = [(i % 3, f"s{i:03d}", 1_500_000_000 + int(rng.integers(0, 500)) * 43200, float(rng.integers(0, 60)), int(rng.integers(0, 3)), "AB"[int(rng.integers(0, 2))], i) for i in range(300)]
    df = spark.createDataFrame(scenes, "site_id int, scene_id string, s bigint, cloud_pct double, relative_orbit bigint, spacecraft string, no int")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    ranked = scene_choice.ranked_references(df, df, 4, carry=("no",), own=("cloud_pct",))
    got = {(r.target_id, r["rank"]): (r.c.scene_id, r.c.no, r.cloud_pct) for r in ranked.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t in scenes:
        pairs = [(abs(c[2] - t[2]) / 86400 + 30 * (c[4] != t[4]) + 5 * (c[5] != t[5]), c[2], c[1], c[6])
                 for c in scenes if c[0] == t[0] and c[3] <= 30 and 1 <= abs(c[2] - t[2]) / 86400 <= 120]
        want |= {(t[1], n): (c[2], c[3], t[3]) for n, c in enumerate(sorted(pairs)[:4], 1)}
    assert got == want
    # scenes are brought together once, whatever k is
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_hotspots(spark):
    weeks = [(0, 0, 40.0), (1, 0, 45.0), (2, 0, 38.0)] + [(w, c, v) for w in range(3) for c, v in ((1, 1.0 + w), (2, -1.0 + w * 0.5), (3, 0.5 - w))]
    df = spark.createDataFrame(weeks, "week int, idx int, value double")
    top = screening.hotspots(df).first()
    assert (top.idx, top.mean_enh, top.max_enh, top.weeks_flagged, top.weeks_observed) == (0, 41.0, 45.0, 3, 3)
    flat = spark.createDataFrame([(0, i, 5.0) for i in range(4)], "week int, idx int, value double")
    assert screening.hotspots(flat).count() == 0


def test_regression_pairs(spark):
    df = spark.createDataFrame([("a", i, float(o), float(r)) for i, (r, o) in enumerate(((10, 11), (10, 9), (20, 24), (20, 16)))], "g string, i int, q_ours double, q_ref double")
    r = statistics.ratio_statistics(df, ("g",)).first()
    assert math.isclose(r.slope, 1.0) and math.isclose(r.median_ratio, 1.0)
    assert math.isclose(statistics.theil_sen(df, ("g",)).first().theil_sen, 1.0)
    two = statistics.spearman(df.where("i < 2"), ("g",)).first()
    assert two.rho is None and two.p is None


def test_rank_p_value():
    # Student t with 8 degrees of freedom: t = 2.306 is the two-sided five per cent point.
    t = 2.306004
    rho = t / math.sqrt(8 + t * t)
    assert abs(statistics._two_sided(rho, 10) - 0.05) < 1e-4
    assert statistics._two_sided(0.5, 10_000) < 1e-12


def test_daily_series_rules(spark):
    rows = [("2024-01-01 10:00:00", 2.0, 3), ("2024-01-01 11:00:00", 4.0, 1), ("2024-01-01 12:00:00", None, 9), ("2024-01-02 01:00:00", 5.0, 0), ("2024-01-02 02:00:00", 7.0, 0)]
    df = spark.createDataFrame(rows, "t string, value double, count bigint").withColumn("ts", F.col("t").cast("timestamp"))
    got = [(str(r.date), r.value, r["count"]) for r in series.daily_series(df).orderBy("date").collect()]
    assert got == [("2024-01-01", 2.5, 4), ("2024-01-02", 6.0, 0)]
    with pytest.raises(ValueError):
        series.rolling_trailing(df, (), rows=3, min_periods=4)


def test_frames(spark):
    f = frames.calendar_frames(spark, date(2024, 2, 10), date(2024, 3, 5)).collect()
    assert [(str(r.start), str(r.end), r.label) for r in f] == [("2024-02-10", "2024-02-29", "2024-02"), ("2024-03-01", "2024-03-05", "2024-03")]
    assert frames.interval_frames(spark, date(2024, 1, 1), date(2025, 2, 3), 1).count() == 400
    with pytest.raises(ValueError):
        frames.interval_frames(spark, date(2024, 1, 1), date(2025, 2, 4), 1)


def record(spark, pairs):
    items = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value")) for k, v in pairs]
    return rates.with_candidates(spark.range(1).select(F.array(*items).alias("record")))


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ((("source_rate_t_h", "11.2"), ("uncertainty", "5.2")), (11200.0, "t_h", None, 5200.0)),
        ((("ch4_fluxrate", "1620.4"), ("ch4_fluxrate_std", "540.2")), (1620.4, "kg_h", None, 540.2)),
        ((("rate", "9"), ("sigma", "1")), (None, None, "ambiguous_unit", None)),
        ((("rate_t_h", "999"),), (None, "t_h", "over_500_th_guard", None)),
        ((("note", "x"),), (None, None, None, None)),
    ],
)
def test_rate_units(spark, pairs, expected):
    df = record(spark, pairs).withColumn("q", rates.resolve_rate())
    row = df.select("q.*", rates.resolve_sigma(F.col("q.rate_unit")).alias("s")).first()
    assert (row.q_kg_h, row.rate_unit, row.dropped, row.s) == expected


def test_event_times(spark):
    texts = [("2018-06-19T07:00:00Z", "2018-06-19 07:00:00"), ("2018-06-19T09:00:00+02:00", "2018-06-19 07:00:00"), ("2018-06-19 nonsense", "2018-06-19 00:00:00"), ("soon", None)]
    df = spark.createDataFrame(texts, "t string, e string")
    assert all(r.g == r.e for r in df.select("e", times.parse_event_time(F.col("t")).cast("string").alias("g")).collect())


GOOD = '[dataset]\nid="a"\ntitle="t"\ncollection_id="c"\nattribution="x"\ndefault_scale_m=10\n[products.P]\nname="p"\nvis_min=0\nvis_max=1\nvalid_min=0\nvalid_max=1\ndisplay_unit="u"\n'


def test_dataset_definitions(spark, tmp_path):
    cases = [
        (("vis_max=1", "vis_max=0"), "vis_max must exceed"), (('id="a"', 'id="A!"'), "bad id"), (("default_scale_m=10", "default_scale_m=true"), "default_scale_m must be whole"),
        (("default_scale_m=10", "default_scale_m=0"), "default_scale_m must be positive"), (('name="p"', 'name="p"\nbuilder="b"'), "reserved"),
        (('name="p"', 'name="p"\nexpression="A"'), "needs its bands"), (('name="p"', 'name="p"\npalette=["red"]'), "palette"), (("[dataset]", "[dataset"), "not TOML"),
        (('name="p"', 'name="p"\nbands=[]'), "bands must be a list"), (('name="p"', 'name="p"\nbands=[1]'), "bands must be texts"), (('name="p"\n', ""), "missing key name"),
        (("vis_min=0", 'vis_min="0"'), "vis_min must be number"), (("[products.P]", "[products]\nP=3\n[other]"), "unknown key at the top"),
        (("[products.P]", '[products."P 1"]'), "bad product key"), (('name="p"', 'name="p"\nneeds_ref=true'), "needs an expression"), (('name="p"', 'name="p"\nis_rgb=true'), "colour stack"),
        (('title="t"', 'title="t"\nextra=1'), "unknown key extra"), (("valid_max=1", "valid_max=-1"), "valid_max"),
    ]
    for i, (change, _) in enumerate(cases):
        (tmp_path / f"bad{i:02d}.toml").write_text(GOOD.replace(*change))
    (tmp_path / "head.toml").write_text(GOOD[: GOOD.index("[products")])
    (tmp_path / "flat.toml").write_text(GOOD[: GOOD.index("[products")] + "[products]\nP=3\n")
    (tmp_path / "good.toml").write_text(GOOD + 'bands=["A", "B"]\nexpression="A / B"\ndisplay_scale=2\nneeds_ref=false\n')
    (tmp_path / "later.toml").write_text(GOOD)
    good, bad = imports.read_dataset_specs(spark, str(tmp_path))
    (row,) = good.collect()
    assert (row.dataset_id, row.key, row.vis_max, row.bands, row.expression, row.source_band, row.display_scale, row.is_rgb, row.needs_ref) == (
        "a", "P", 1.0, ["A", "B"], "A / B", "P", 2.0, False, False)
    why = {r.path.rsplit("/", 1)[1].split(".")[0]: r.reason for r in bad.collect()}
    assert len(why) == len(cases) + 3
    assert all(text in why[f"bad{i:02d}"] for i, (_, text) in enumerate(cases))
    assert (why["head"], why["flat"], why["later"]) == ("at least one product is needed", "products.P: must be a table", "duplicate dataset id")


def test_regions():
    with pytest.raises(ValueError):
        geo.box(10, 0, 5, 1)
    with pytest.raises(ValueError):
        geo.outline(((0, 0), (1, 1), (0, 0)))
    assert geo.spans_globe(geo.box(-180, -90, 180, 90))
    with pytest.raises(ValueError):
        geo.lattice_shape(geo.box(0, 0, 10, 10), 0.1)
    with pytest.raises(ValueError):
        scans.check_dates("2024-02-01", "2024-02-01")


def test_matching_across_the_date_line_and_poles(spark):
    pts = [(1, 10.0, 179.99), (2, 89.99, 0.0), (3, -40.0, 20.0)]
    other = [(1, 10.0, -179.99), (2, 89.99, 180.0), (3, -40.1, 20.1)]
    t = F.lit("2024-01-01").cast("timestamp")
    a = spark.createDataFrame(pts, "det_id bigint, lat double, lon double").withColumn("ts", t)
    b = spark.createDataFrame(other, "event_id bigint, lat double, lon double").withColumn("ts", t)
    assert {(r.a.det_id, r.b.event_id) for r in matching.near_pairs(a, b, 15.0, 1.0).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src bigint, dst bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_average_linkage_per_component(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 20))
    v = np.vstack([centres[i % 4] + rng.normal(0, 0.25, 20) for i in range(40)])
    df = spark.createDataFrame([(i, 0, [float(x) for x in r]) for i, r in enumerate(v)], "tile_id bigint, shape int, v array<double>")
    got = {r.tile_id: r.cluster for r in learning.content_clusters(df).collect()}
    assert got == {i: i % 4 for i in range(40)}


def test_average_linkage_equals_one_merge_at_a_time(spark):
    """Blurred groups of two shapes and a chain, against merging the closest pair of all until none is near."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 12))
    v = [centres[i % 5] + rng.normal(0, 0.7, 12) for i in range(50)] + [np.cos(np.arange(12) * 0.5 + 0.35 * i) for i in range(12)]
    rows = [(i, i % 2, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, 0, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "tile_id bigint, shape int, v array<double>")
    want = {100: 0}
    for shape in (0, 1):
        own = [i for i, s, _ in rows if s == shape and i != 100]
        u = np.array([v[i] - v[i].mean() for i in own])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        groups = [[i] for i in range(len(own))]
        while len(groups) > 1:
            d, i, j = min((1 - (u[a] @ u[b].T).mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if d > learning.LINK_DISTANCE:
                break
            groups[i] += groups.pop(j)
        want |= {own[i]: min(own[k] for k in g) for g in groups for i in g}
    want[100] = want[0]
    got = {r.tile_id: r.cluster for r in learning.content_clusters(df).collect()}
    assert got == want and 5 < len(set(want.values())) < 40


def test_vector_clusters_see_every_row(spark):
    rng = np.random.default_rng(9)
    pixels = spark.range(5200).select(F.col("id").alias("pixel_id"), F.lit(2020).cast("bigint").alias("year"))
    order = [r.pixel_id for r in pixels.orderBy(randoms.order_key(0, F.concat_ws("|", "pixel_id", "year"))).collect()]
    rare = set(order[-20:])
    rows = [(i, 2020, [float(x) for x in (-1.0 if i in rare else 1.0, *rng.normal(0, 0.01, 3))]) for i in range(5200)]
    df = spark.createDataFrame(rows, "pixel_id bigint, year bigint, embedding array<float>").repartition(4)

    def parts(out):
        groups = {}
        for r in out.collect():
            groups.setdefault(r.cluster, set()).add(r.pixel_id)
        return {frozenset(g) for g in groups.values()}

    assert parts(vectors.cluster(df, 2)) == {frozenset(rare), frozenset(range(5200)) - rare}
    assert len(parts(vectors.cluster(df, 2, sample=5000)) & {frozenset(rare)}) == 0


def test_draws_recover_the_rate(spark):
    row = (0, [20] * 5, [100.0] * 5, [90.0] * 5, 400.0, 4.0, 0.0)
    sweep = spark.createDataFrame([row], "det_id bigint, n_k array<bigint>, ime_k array<double>, len_k array<double>, area_m2 double, u10 double, sigma_u10 double")
    off = spark.createDataFrame([(0, y, 0, 0.0) for y in range(50)], "det_id bigint, y bigint, x bigint, delta_omega double")
    r = emission.monte_carlo(sweep, off, ["det_id"], F.col("det_id")).first()
    q = (0.33 * 4 + 0.45) / 90 * 100 * 3600
    assert r.n_draws == 500 and abs(r.q_kg_h / q - 1) < 0.03 and abs(r.q_sigma_kg_h / q - 0.15) < 0.02 and sum(r.histogram.counts) == 500


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-{1 + i // 4:02d} {i % 4 * 6:02d}:00:00", float(i), i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, value double, count bigint").select(F.col("t").cast("timestamp").alias("ts"), "value", "count", F.lit("s").alias("series_id"))
    for part in range(4):
        df.where((F.dayofmonth("ts") - 1) % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running.file_stream(spark, str(tmp_path / "in"), df, files_per_batch=1)
    got = forms.daily_series(stream, ("series_id",))
    want = series.daily_series(df, ("series_id",)).select("series_id", "date", "value", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_series_goes_on_after_a_restart(spark, tmp_path):
    kind = "series_id string, value double, count bigint, resolution int"
    folders = (str(tmp_path / "state"), str(tmp_path / "out"))
    land = lambda *rows: spark.createDataFrame(list(rows), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = running.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], kind))
        return sorted(map(tuple, forms.replace_coarse(stream, ["series_id"], folders=folders).collect()))

    land(("a", 1.0, 9, 0), ("b", 2.0, 9, 0), ("c", 3.0, 1, 1))
    assert run() == [("a", 1.0, 9, 0), ("b", 2.0, 9, 0), ("c", 3.0, 1, 1)]
    land(("b", 5.0, 1, 1), ("c", 7.0, 9, 0))
    want = [("a", 1.0, 9, 0), ("b", 5.0, 1, 1), ("c", 3.0, 1, 1)]
    assert run() == want and run() == want


def test_chunks_report_and_can_be_cancelled(spark, tmp_path):
    chunks = [spark.range(10 * i, 10 * i + 10).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("value")) for i in range(4)]
    heard = []
    whole = builders.run_chunks(spark, chunks, "value", heard.append)
    assert sorted(r.id for r in whole.collect()) == list(range(40))
    assert [(p.done, p.total, p.rows, p.values) for p in heard] == [(i, 4, 10, 5) for i in range(1, 5)]
    assert sorted(r.id for r in heard[2].result.collect()) == list(range(20, 30))

    stop = threading.Event()
    stop.set()
    heard.clear()
    with pytest.raises(builders.Cancelled):
        builders.run_chunks(spark, chunks, "value", heard.append, stop)
    assert heard == []

    # between chunks: none starts after it, and the run goes on from what is there
    stop, folder = threading.Event(), str(tmp_path / "run")
    with pytest.raises(builders.Cancelled):
        builders.run_chunks(spark, chunks, "value", lambda p: (heard.append(p), p.done == 2 and stop.set()), stop, folder)
    assert len(heard) == 2
    assert builders.run_chunks(spark, chunks, "value", folder=folder).count() == 40

    # while one runs: its jobs are interrupted
    stop, endless = threading.Event(), spark.range(10**13).agg(F.sum(F.sin("id")).alias("value"))
    threading.Timer(2.0, stop.set).start()
    start = time.monotonic()
    with pytest.raises(builders.Cancelled):
        builders.run_chunks(spark, [endless], "value", None, stop)
    assert time.monotonic() - start < 60
    assert builders.run_chunks(spark, chunks[:1], "value").count() == 10


@pytest.mark.parametrize("lat", [0.0, 60.0, -60.0])
def test_speckle_circle_follows_the_latitude(spark, lat):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(9, 15))
    values[4, 7] = np.nan
    lons = [((179.95 + 0.01 * x) + 180) % 360 - 180 for x in range(15)]  # across the date line
    rows = [("s", lat + 0.01 * (y - 4), lons[x], None if np.isnan(values[y, x]) else float(values[y, x])) for y in range(9) for x in range(15)]
    df = spark.createDataFrame(rows, "scene_id string, lat double, lon double, VV double")
    got = {(round(r.lat / 0.01), round(r.lon, 2)): r.VV for r in mo.focal_median_metres(df, ["scene_id"], 2_500.0, ["VV"], 0.01).collect()}
    assert len(got) == len(rows)
    for y in range(9):
        row = round((lat + 0.01 * (y - 4)) / 0.01)
        wide = 1113.2 * math.cos(math.radians(row * 0.01))
        for x in range(15):
            near = [values[j, i] for j in range(9) for i in range(15) if ((j - y) * 1113.2) ** 2 + ((i - x) * wide) ** 2 <= 2_500.0**2]
            want = None if np.isnan(values[y, x]) else float(np.nanmedian(near))
            assert got[(row, round(lons[x], 2))] == want


def test_speckle_sends_few_pixels_twice(spark):
    """Copies of a place, NULL places, blocks and the date line; no pixel goes to all places of its circle."""
    rng = np.random.default_rng(5)
    rows = [("s", 1 + i, float(rng.integers(0, 80)) * 0.01, (179.7 + 0.01 * float(rng.integers(0, 80)) + 180) % 360 - 180, float(rng.normal()) if i % 9 else None) for i in range(1_500)]
    rows += [("s", 0, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "scene_id string, no int, lat double, lon double, VV double")
    out = mo.focal_median_metres(df, ["scene_id"], 2_500.0, ["VV"], 0.01)
    got = {r.no: r.VV for r in out.collect()}
    assert len(got) == len(rows) and got[0] is None
    gy, gx = np.array([round(r[2] / 0.01) for r in rows[:-1]]), np.array([round(r[3] / 0.01) % 36_000 for r in rows[:-1]])
    value = np.array([np.nan if r[4] is None else r[4] for r in rows[:-1]])
    for i in range(0, 1_500, 7):
        dx = (gx - gx[i] + 18_000) % 36_000 - 18_000
        near = ((gy - gy[i]) * 1113.2) ** 2 + (dx * 1113.2 * math.cos(math.radians(gy[i] * 0.01))) ** 2 <= 2_500.0**2
        want = None if np.isnan(value[i]) else np.nanmedian(value[near])
        assert got[i + 1] == pytest.approx(want, rel=1e-15) if want is not None else got[i + 1] is None
    assert "Generate explode" in (plan := out._jdf.queryExecution().toString()) and "median" not in plan


def test_late_batches_and_a_restart_equal_one_batch(spark, tmp_path):
    """Rows that land weeks late, a restart after every batch, and repeats: each form equals itself over all rows at once."""
    rng = np.random.default_rng(6)
    rows = [(f"2024-01-{d:02d} {h:02d}:{m:02d}:00", float(v), int(c), int(x), int(e), p) for d, h, m, v, c, x, e, p in zip(
        rng.permutation(np.repeat(np.arange(1, 29), 10)), rng.integers(0, 3, 280), rng.integers(0, 60, 280), rng.normal(size=280), rng.integers(0, 3, 280), rng.integers(0, 4, 280),
        rng.permutation(280), rng.choice(["live", "mirror"], 280), strict=True)]
    kind = "t string, value double, count bigint, cell int, event_id bigint, provenance string"
    df = spark.createDataFrame([*rows, (None, 1.0, 1, 0, 999, "live"), ("2024-01-05 00:00:00", None, 1, 1, 998, "live")], kind)
    df = df.select(F.col("t").cast("timestamp").alias("ts"), "value", "count", "cell", F.lit("s").alias("series_id"), "event_id", "provenance", F.lit(1.0).alias("lat"), (F.col("cell") / 1000).alias("lon"), F.col("cell").alias("relative_orbit"), F.lit("A").alias("spacecraft"))
    df = df.persist()
    every = {
        "daily": lambda s, f: forms.daily_series(s, ("series_id",), f), "weekly": lambda s, f: forms.weekly_cells(s, "cell", date(2024, 1, 3), f),
        "frames": lambda s, f: forms.rolling_frames(s, date(2024, 1, 3), 3, 8, f), "best": lambda s, f: forms.prefer_provenance(s, folders=f), "sessions": lambda s, f: forms.overpass_sessions(s, folders=f),
    }
    rounded = lambda t: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()], key=str)
    df.coalesce(1).write.parquet(str(tmp_path / "whole"))
    landed = tmp_path / "in"
    got = {}
    for piece in df.randomSplit([1.0, 1.0, 1.0], seed=3):
        piece.coalesce(1).write.mode("append").parquet(str(landed))
        for name, form in every.items():
            got[name] = rounded(form(running.file_stream(spark, str(landed), df), (str(tmp_path / f"{name}-state"), str(tmp_path / f"{name}-out"))))
    for name, form in every.items():
        assert got[name] == rounded(form(running.file_stream(spark, str(tmp_path / "whole"), df), None)), name
    days = {r.date: (r.vc, r.c) for r in df.where("value IS NOT NULL AND ts IS NOT NULL").groupBy(F.to_date("ts").alias("date")).agg(F.sum(F.col("value") * F.col("count")).alias("vc"), F.sum("count").alias("c")).collect()}
    assert len(got["daily"]) == len(days) and all(days[d][1] == c and (not c or math.isclose(v * c, days[d][0], rel_tol=1e-6, abs_tol=1e-6)) for _, d, v, c in got["daily"])
    assert sum(r[-1] for r in got["sessions"]) == df.where("ts IS NOT NULL").count()
    df.unpersist()


def test_sessions_are_whole_at_the_end_of_the_input(spark, tmp_path):
    times = ["2024-01-01 10:00", "2024-01-01 10:20", "2024-01-09 10:00", "2024-01-09 10:25", "2024-01-09 12:00", "2024-01-01 10:40"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").select("i", F.lit(1).alias("relative_orbit"), F.lit("A").alias("spacecraft"), F.col("t").cast("timestamp").alias("ts"))
    for i in range(len(times)):
        rows.where(f"i = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = running.file_stream(spark, str(tmp_path / "in"), rows, files_per_batch=1)
    got = sorted((str(r.start), str(r.end), r.n) for r in forms.overpass_sessions(stream).collect())
    assert got == [("2024-01-01 10:00:00", "2024-01-01 11:10:00", 3), ("2024-01-09 10:00:00", "2024-01-09 10:55:00", 2), ("2024-01-09 12:00:00", "2024-01-09 12:30:00", 1)]


def test_every_session_of_the_scenes_comes_out(spark):
    sf = "/root/testdata/sf0.001"
    duck = check_queries.connect(sf)
    for name in ("st08_overpass_sessions", "st08_all_overpass_sessions"):
        ok, message, _ = check_queries.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], sf)
        assert ok, message
    n = views.scenes(spark, sf).count()
    assert entry.queries()[name](spark, sf).agg(F.sum("n")).first()[0] == n


def test_degenerate_statistics(spark):
    one_day = spark.createDataFrame([("s", date(2024, 1, 1), 2.0, 1), ("s", date(2024, 1, 1), 3.0, 1)], "series_id string, date date, value double, count bigint")
    r = series.series_statistics(one_day, ("series_id",)).first()
    assert r.trend_per_year == 0.0 and r.n == 2
    flat = spark.createDataFrame([(0, y, x, 0.5, 0.5, 0.5) for y in range(9) for x in range(9)], "chip_id int, y bigint, x bigint, b4 double, b3 double, b2 double")
    assert plume.surface_correlation(flat.where("y = 4 AND x = 4"), flat, ("chip_id",)).first().surface_r == 0.0
    flat_chip = spark.createDataFrame([(0, y, 0, 0.0, 0.0) for y in range(5)], "chip_id int, y bigint, x bigint, b11 double, b12 double")
    assert retrieval.single_pass(flat_chip, ("chip_id",), robust=True).where("delta_r IS NOT NULL").count() == 0


def test_event_csv_tolerates_odd_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Lat,LON , date,flux_kg_h,Note,NOTE\n38.5,53.9,2018-06-19,12,a,b\nx,53.9,2018-06-19,12,a,b\n38.5,53.9,never,1,,\n")
    good, bad = imports.read_events_csv(spark, str(tmp_path / "e.csv"), "s")
    row = good.first()
    assert good.count() == 1 and row.q_kg_h == 12.0
    assert sorted(r.reason for r in bad.collect()) == ["no latitude", "no time"]


def test_event_geojson(spark, tmp_path):
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[53.9,38.5]},"properties":{"Date":"2018-06-19","source_rate_t_h":11.2,"Note":"a","NOTE":"b"}}'
    line = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[]}}'
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[' + point + "," + line + "]}")
    good, bad = imports.read_events_geojson(spark, str(tmp_path / "e.geojson"), "s")
    row = good.first()
    assert good.count() == 1 and bad.count() == 0
    assert (row.lat, row.lon, row.q_kg_h, row.rate_unit, row.raw["note"]) == (38.5, 53.9, 11200.0, "t_h", "b")


def test_inversion_follows_the_tables_own_steps(spark):
    steps = (2.0, 2.5, 3.0, 4.5)
    curve = lambda amf, w: -0.01 * amf * w
    lut = spark.createDataFrame([("v", "S", a, float(w), curve(a, w)) for a in steps for w in range(6)], "lut_version string, spacecraft string, amf double, delta_omega double, m double")
    cases = [(i, "S", amf, curve(amf, 1.7)) for i, amf in enumerate((2.0, 2.2, 2.7, 3.6, 4.5))] + [(9, "S", 2.2, None), (10, "S", 99.0, curve(4.5, 2.0))]
    got = {r["id"]: r["w"] for r in invert_signal(spark.createDataFrame(cases, "id int, spacecraft string, amf double, s double"), lut, "v", "s", "w").collect()}
    assert all(math.isclose(got[i], 1.7, rel_tol=1e-9) for i in range(5)) and got[9] is None and math.isclose(got[10], 2.0, rel_tol=1e-9)


def test_missing_scene_is_an_error(spark):
    from skylattice.operators.composites import single_scene_anomaly

    px = spark.createDataFrame([("a", datetime(2020, 1, 1), 1, 0, 0, 1.0, 2.0)], "scene_id string, ts timestamp_ntz, tile_id int, y int, x int, B12 double, B11 double")
    assert single_scene_anomaly(px, "a", (date(2020, 1, 1), date(2020, 2, 1))).count() == 1
    with pytest.raises(Exception, match="no scene b"):
        single_scene_anomaly(px, "b", (date(2020, 1, 1), date(2020, 2, 1))).collect()


def test_theil_sen_weighs_heavy_multiplicities(spark):
    heavy = spark.range(100_000).select(F.lit("g").alias("g"), F.explode(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), F.struct(F.lit(2.0).alias("x"), F.lit(5.0).alias("y")))).alias("p"))
    few = spark.createDataFrame([("g", (3.0, 100.0))], "g string, p struct<x: double, y: double>")
    points = heavy.unionByName(few).select("g", F.col("p.x").alias("q_ref"), F.col("p.y").alias("q_ours"))
    assert statistics.theil_sen(points, ("g",)).first()["theil_sen"] == 3.0
    rng = np.random.default_rng(8)
    some = [("h", float(x), float(y)) for x, y in zip(rng.integers(0, 9, 60), rng.normal(size=60).round(1), strict=True)]
    slopes = [(b[2] - a[2]) / (b[1] - a[1]) for a in some for b in some if a[1] < b[1]]
    got = statistics.theil_sen(spark.createDataFrame(some, "g string, q_ref double, q_ours double"), ("g",)).first()["theil_sen"]
    assert math.isclose(got, np.median(slopes))


def test_template_peak_equals_correlation_of_every_window():
    rng = np.random.default_rng(5)
    image, template = rng.normal(size=(9, 11)), rng.normal(size=(4, 3))
    image[2, 3] = image[6, 7] = template[1, 2] = np.nan
    got = mo.window_correlations(image, template)
    for y in range(6):
        for x in range(9):
            part = image[y : y + 4, x : x + 3]
            on = np.isfinite(part) & np.isfinite(template)
            assert got[y, x] == pytest.approx(np.corrcoef(part[on], template[on])[0, 1])
    assert np.isnan(mo.window_correlations(np.full((5, 5), 2.0), template)).all()
    assert mo.window_correlations(template, image).size == 0
    assert mo._best_window(np.full((5, 5), np.nan), template) == (None, None, None)
    twice = np.tile(template[:, :2], 2)
    assert mo._best_window(twice, template[:, :2])[1:] == (0, 0)


def test_block_counts_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    n = 700
    west, south = rng.uniform(0, 0.06, n).round(4), rng.uniform(0, 0.06, n).round(4)
    wide, high = rng.uniform(0.002, 0.04, n).round(4), rng.uniform(0.002, 0.04, n).round(4)
    fold = rng.integers(0, 3, n)
    rows = [(float(a), float(b), float(a + c), float(b + d), int(f)) for a, b, c, d, f in zip(west, south, wide, high, fold)]
    rows += rows[:40] + [(None, 0.0, 0.1, 0.1, 1)]
    df = spark.createDataFrame(rows, "west double, south double, east double, north double, fold int")
    want = {}
    for i, a in enumerate(rows[:-1]):
        for b in rows[:i]:
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            smaller = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
            if a[4] != b[4] and w > 0 and h > 0 and w * h / smaller > 0.1:
                key = tuple(sorted((a[4], b[4])))
                want[key] = want.get(key, 0) + 1
    got = matching.overlap_pairs(df, 0.05)
    assert {(r.fold_a, r.fold_b): r.n_pairs for r in got.collect()} == want


def test_sites_of_dense_cells_link_across_a_gap(spark):
    # two dense clouds that face each other at 5 km: one pair in reach, or none
    rng = np.random.default_rng(12)
    for gap, clusters in ((4.9, 1), (5.1, 2)):
        x = np.concatenate([rng.uniform(-2, 0, 2500), [0.0, gap], gap + rng.uniform(0, 2, 2500)])
        rows = [(i, float(v / 111.32), 0.0) for i, v in enumerate(x)]
        got = matching.link_sites(spark.createDataFrame(rows, "site_id bigint, lon double, lat double"), 5.0)
        assert got.select("cluster").distinct().count() == clusters and got.count() == len(rows)
