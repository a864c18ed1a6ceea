"""Rule-based source classes from radar and optical mean composites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ClassRules:
    """Thresholds of the source classes."""

    vv_high: float = -10.0
    vv_low: float = -18.0
    ndvi_vegetated: float = 0.35
    ndwi_water: float = 0.1
    methane: float = -0.02
    thermal_b11: float = 0.5
    thermal_b12: float = 0.5
    methane_strong: float = -0.04
    ndvi_barren: float = 0.1


# Class numbers.
CLASS_LABELS = {1: "Industrial / Oil & Gas", 2: "Biogenic / Agricultural", 3: "Wetland / Water", 4: "Geological Seep", 5: "No signal"}


def source_class(vv: Column, b3: Column, b4: Column, b8: Column, b11: Column, b12: Column, rules: ClassRules = ClassRules()) -> Column:
    """Class 1 to 5, the highest-priority rule first; any missing input leaves the pixel masked."""
    ndvi = F.try_divide(b8 - b4, b8 + b4)
    ndwi = F.try_divide(b3 - b8, b3 + b8)
    mbsp = F.try_divide(b12 - b11, b11)
    gas = mbsp < rules.methane
    strong_echo, smooth = vv > rules.vv_high, vv < rules.vv_low
    bare = ndvi < rules.ndvi_vegetated
    burning = (b11 > rules.thermal_b11) & (b12 > rules.thermal_b12)
    industrial = (gas | burning) & strong_echo & bare
    biogenic = gas & (ndvi > rules.ndvi_vegetated)
    wetland = gas & ((ndwi > rules.ndwi_water) | smooth)
    seep = (mbsp < rules.methane_strong) & bare & ~(ndvi < rules.ndvi_barren) & ~smooth & ~strong_echo
    number = F.when(industrial, 1).when(biogenic, 2).when(wetland, 3).when(seep, 4).otherwise(5)
    known = vv.isNotNull() & ndvi.isNotNull() & ndwi.isNotNull() & mbsp.isNotNull()
    return F.when(known, number)
