"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import check_queries
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "flagship_daily_ndvi_series", "src02_optical_base_scan", "src08_dataset_specs", "src11_plume_geojson", "src14_scene_listing", "snk03_detection_records",
    "product_s2_evi", "product_s2_dnbr", "product_s1_rvi", "product_s5p_ch4", "flt04_region_clip", "flt07_vegetation_water_mask", "prj10_palette_colour", "prj11_source_class",
    "jn03_methane_anomaly", "jn04_best_reference", "jn07_wind_fallback", "jn09_event_match", "jn16_lut_bracket", "jn18_fold_overlap", "ag03_median_composite", "ag16_series_statistics",
    "ag24_wind_fit", "ag26_threshold_sweep", "ag41_dataset_inventory", "wn02_centred_smooth", "wn05_fold_assignment", "wn09_frame_table", "sc13_rate_units", "nb01_binary_opening",
    "nb06_flare_mask", "me01_robust_pass", "me02_two_table_inversion", "em03_yearly_change", "st06_repeat_removal",
)


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    ok, message, _ = check_queries.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def test_every_operator_has_a_query():
    names = entry.queries()
    assert len(names) >= 256
    assert set(entry.oracle_sql()) <= set(names)
