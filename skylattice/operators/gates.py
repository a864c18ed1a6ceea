"""Row-level validity gates: each adds a reason column instead of dropping silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import MAX_CHIP_PX, box_problem_column, grid_columns

# Fixed values.
INVALID_COLUMN = 3.0
INVALID_SHARE_MAX = 0.20
VALID_SHARE_MIN = 0.95


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``)."""
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def region_problem() -> Column:
    return box_problem_column(F.col("west"), F.col("south"), F.col("east"), F.col("north"))


def date_problem(start: Column, end: Column) -> Column:
    return F.when(end <= start, "end must be after start")


def chip_size_problem(scale_m: float = 20.0) -> Column:
    """Reason when a box needs more than the allowed pixels on a side."""
    g = grid_columns(F.col("west"), F.col("south"), F.col("east"), F.col("north"), scale_m)
    too_big = (g["width"] > MAX_CHIP_PX) | (g["height"] > MAX_CHIP_PX)
    return F.when(too_big, F.concat(g["width"].cast("string"), F.lit("x"), g["height"].cast("string"), F.lit(" exceeds the chip limit")))


def product_problem(wanted: str = "scalar") -> Column:
    """Refusal reason from catalog columns, for a table of requests joined with the catalog."""
    reason = F.when(F.col("builder").isNotNull(), "needs its own builder").when(F.col("needs_ref"), "needs a reference window")
    return reason.when(F.col("is_rgb"), "colour stack") if wanted == "scalar" else reason


def exclusion_reason(n_mask: Column, invalid_share: Column, rate: Column) -> Column:
    """Why a retrieval does not count; NULL when it does."""
    return (
        F.when(n_mask == 0, "no_plume")
        .when(invalid_share > INVALID_SHARE_MAX, "out_of_validity")
        .when(rate.isNull() | F.isnan(rate), "non_finite_rate")
    )


def invalid_share(delta_omega: Column, mask: Column) -> Column:
    """Share of masked pixels beyond the range where the forward model holds."""
    return F.coalesce(F.avg(F.when(mask, (F.abs(delta_omega) >= INVALID_COLUMN).cast("int"))), F.lit(0.0))
