"""Steps that must run once, or in more than one task."""

from __future__ import annotations

import re

from skylattice.plans import import_queries, methane_queries
from skylattice.sources import imports

SF = "/root/testdata/sf0.01"


def test_rates_gather_the_pixels_once(spark):
    """What follows the masks reads them and the columns back; only the numbers of the chips come from the table again."""
    plan = methane_queries.rate_uncertainty(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "l_suppkey" in line]) <= 2


def test_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(import_queries, "scratch_path", lambda s, label: str(tmp_path / label))
    assert {r.state: r.n for r in import_queries.checksum_audit(spark, SF).collect()} == {"ok": 18, "mismatch": 6, "missing": 6}
    tasks = {re.match(r"part-(\d+)", p.name).group(1) for p in (tmp_path / "downloads").glob("file=*/part-*")}
    assert len(tasks) > 1


def test_event_records_are_made_once(spark):
    """The filter on rejects does not repeat the reading of the record, and the names of the properties are folded once."""
    plan = import_queries.event_geojson(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(") == 1 and plan.count("map_entries(") == 1


def test_repeated_names_of_event_records(spark, tmp_path):
    """The first filled one counts as place and time, the last one stays in the raw record; names that tell no rate do not stand in the way."""
    text = '{"features":[{"geometry":{"type":"Point","coordinates":[5,6]},"properties":{"LAT":"","Note":"x","Lat":"7"," lat ":"8","date":"2020-01-02","Rate":"3","a_t_h":"2","b_kg_h":"9","error_kgh":"1"}}]}'
    (tmp_path / "e.json").write_text(text)
    good, bad = imports.read_events_geojson(spark, str(tmp_path / "e.json"), "s", per_line=True)
    row = good.first()
    assert (row.lat, row.lon, row.q_kg_h, row.rate_unit, row.q_sigma_kg_h) == (7.0, 5.0, 2000.0, "t_h", 1.0)
    assert row.raw["lat"] == "8" and row.raw["lon"] == "5" and bad.count() == 0
