"""Built-in regions and monitoring sites as dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, west, south, east, north, category, first and last day of the date hint.
REGIONS = (
    ("Europe", -25.0, 34.0, 45.0, 72.0, "continent", None, None),
    ("North America", -170.0, 15.0, -50.0, 72.0, "continent", None, None),
    ("South America", -82.0, -56.0, -34.0, 13.0, "continent", None, None),
    ("Africa", -18.0, -35.0, 52.0, 37.0, "continent", None, None),
    ("Asia", 25.0, -10.0, 180.0, 75.0, "continent", None, None),
    ("Oceania", 110.0, -50.0, 180.0, 0.0, "continent", None, None),
    ("Antarctica", -180.0, -90.0, 180.0, -60.0, "continent", None, None),
    ("Entire Earth", -180.0, -90.0, 180.0, 90.0, "continent", None, None),
    ("Heidelberg (Germany)", 8.58, 49.35, 8.77, 49.46, "city", None, None),
    ("London (UK)", -0.51, 51.28, 0.33, 51.70, "city", None, None),
    ("Berlin (Germany)", 13.09, 52.33, 13.76, 52.68, "city", None, None),
    ("New York (USA)", -74.26, 40.49, -73.69, 40.92, "city", None, None),
    ("Merida (Mexico)", -89.80, 20.85, -89.50, 21.10, "city", None, None),
    ("Barranquilla (Colombia)", -74.93, 10.90, -74.70, 11.10, "city", None, None),
    ("CH4: Korpezhe, Turkmenistan", 53.7, 38.2, 54.7, 38.8, "methane_site", "2024-06-01", "2024-12-01"),
    ("CH4: Galkynysh, Turkmenistan", 61.8, 36.9, 62.9, 37.7, "methane_site", "2024-06-01", "2024-12-01"),
    ("CH4: Permian Basin (USA)", -104.5, 31.0, -103.0, 32.5, "methane_site", "2024-03-01", "2024-09-01"),
    ("CH4: Hassi Messaoud, Algeria", 5.4, 31.2, 6.4, 32.0, "methane_site", "2024-04-01", "2024-10-01"),
    ("CH4: Basra oil fields, Iraq", 46.9, 30.0, 47.8, 31.0, "methane_site", "2024-05-01", "2024-11-01"),
    ("CH4: Four Corners (USA)", -109.6, 36.5, -108.5, 37.5, "methane_site", "2024-03-01", "2024-09-01"),
    ("CH4: Upper Silesia, Poland", 18.5, 50.0, 19.5, 50.5, "methane_site", "2024-04-01", "2024-10-01"),
)
SCHEMA = "name string, west double, south double, east double, north double, category string, hint_start string, hint_end string"


def regions(spark: SparkSession) -> DataFrame:
    """All built-in regions (a fixed dimension of 21 rows)."""
    return spark.createDataFrame(list(REGIONS), SCHEMA)


def seed_sites(existing: DataFrame) -> DataFrame:
    """Sites to append: the built-in methane sites not yet known by name; running it twice adds nothing."""
    sites = regions(existing.sparkSession).where("category = 'methane_site'").withColumn("name", F.regexp_replace("name", "^CH4: ", ""))
    return sites.join(existing.select("name"), "name", "left_anti")


def containing_region(lat: Column, lon: Column) -> Column:
    """Smallest built-in region round a point, as one expression over the fixed list."""
    chain = None
    for name, west, south, east, north, *_ in sorted(REGIONS, key=lambda r: ((r[3] - r[1]) * (r[4] - r[2]), r[0])):
        hit = lon.between(west, east) & lat.between(south, north)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain
