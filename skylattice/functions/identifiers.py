"""Facts carried in identifiers, and JSON fields of stored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and the sites of the benchmark tiles.
TILE = r"_T(\d{2}[A-Z]{3})"
DATASET_ID = r"^[a-z0-9_]{1,64}$"
PRODUCT_KEY = r"^[A-Za-z0-9_]{1,64}$"
HEX_COLOR = r"^#[0-9a-fA-F]{6}$"
BENCHMARK = r"^(S2[AB])_MSICH4_(\d{8})T\d{6}_N\d+_R(\d+)_T([0-9A-Z]{5})_\d{8}T\d{6}_plume(\d+)_Q(\d+)$"
TILE_SITES = {"32SKA": "hassi", "13SGR": "permian", "40SBH": "korpeje"}


def tile_of(scene_id: Column) -> Column:
    """Grid tile inside a scene id, NULL when there is none."""
    return F.nullif(F.regexp_extract(scene_id, TILE, 1), F.lit(""))


def sensing_date(scene_id: Column) -> Column:
    return F.try_to_date(F.substring(scene_id, 1, 8), "yyyyMMdd")


def benchmark_fields(name: Column) -> Column:
    """Struct of the fields of a benchmark product name; NULL when it is not one or the tile is unknown."""
    def part(i: int) -> Column:
        return F.regexp_extract(name, BENCHMARK, i)

    tile = part(4)
    site = None
    for t, s in TILE_SITES.items():
        site = F.when(tile == t, s) if site is None else site.when(tile == t, s)
    craft = F.when(part(1) == "S2A", "Sentinel-2A").otherwise("Sentinel-2B")
    fields = F.struct(
        site.alias("site"), tile.alias("tile"), craft.alias("spacecraft"), F.try_to_date(part(2), "yyyyMMdd").alias("acquired"),
        part(5).try_cast("bigint").alias("plume"), part(6).try_cast("double").alias("q_true"),
    )
    return F.when(name.rlike(BENCHMARK) & site.isNotNull(), fields)


def valid_dataset_id(x: Column) -> Column:
    return x.rlike(DATASET_ID)


def valid_product_key(x: Column) -> Column:
    return x.rlike(PRODUCT_KEY)


def result_flags(result_json: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(result_json, "flags array<string>")["flags"], empty)


def result_score(result_json: Column) -> Column:
    return F.from_json(result_json, "score double")["score"]


def match_count(emit_json: Column) -> Column:
    """Number of matches; NULL when never checked, which is not the same as none."""
    n = F.size(F.from_json(emit_json, "matches array<string>")["matches"])
    return F.when(emit_json.isNotNull(), F.greatest(F.lit(0), F.coalesce(n, F.lit(0))))


def vertex_mean(geometry_json: Column) -> Column:
    """Mean (lat, lon) of all vertices of a Polygon or MultiPolygon; a closing vertex counts twice."""
    kind = F.get_json_object(geometry_json, "$.type")
    poly = F.from_json(geometry_json, "coordinates array<array<array<double>>>")["coordinates"]
    multi = F.from_json(geometry_json, "coordinates array<array<array<array<double>>>>")["coordinates"]
    points = F.when(kind == "Polygon", F.flatten(poly)).when(kind == "MultiPolygon", F.flatten(F.flatten(multi)))

    def mean(i: int) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[i]) / F.size(points)

    return F.when(F.size(points) > 0, F.struct(mean(1).alias("lat"), mean(0).alias("lon")))
