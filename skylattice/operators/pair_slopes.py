"""Median slope over all pairs of points, without the pairs.

A pair has a slope of at most s where its points change order between x and y - s x. The weighted number of such
pairs is a count of inversions, so the slope of a given rank is found by bracketing: counts at some slopes
between the bounds, closer bounds, until no number lies between them.

Groups of at most ``TASK_ROWS`` distinct points, a few megabytes, are solved where they are. Larger ones are cut into
blocks of ``BLOCK_ROWS`` by x. For a slope their points are dealt by y - s x as well; pairs inside one block are
counted there, pairs of two blocks inside one such share are counted there, and all other pairs follow from
the weights of (share, block) alone. So no task holds more than a block or a share, and no pair is ever formed.
The bounds of a large group, a few numbers, are kept by the driver; there are at most rows / ``TASK_ROWS`` such groups.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce
from math import inf, isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from skylattice.session import materialize

BLOCK_ROWS = 1 << 15
TASK_ROWS = 1 << 18  # points of a group that one task may hold: three numbers each
LISTED_POINTS = 1_024  # groups up to here are solved by listing their pairs
STEPS = 4  # evenly placed slopes of a round
CLOSE = 64  # doubles that a bracket may still hold at the end, less than the rounding of slopes
FIRST_SHARES = (0.4, 0.48, 0.495, 0.5, 0.505, 0.52, 0.6)
NEAR = tuple(2.0**-e for e in (6, 10, 14))  # further slopes around the expected one, as parts of the bracket
ROUNDING = 1e-12  # a found slope within this part of a pair's own slope is that slope
SAMPLE_POINTS = 2_048  # of a large group, for cutting shares of similar size


def _number(value: float) -> int:
    """Whole numbers in the order of doubles."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _value(number: int) -> float:
    return struct.unpack("<d", struct.pack("<q", number))[0] if number >= 0 else -_value(-number)


class Bracket:
    """Where the slope of rank ``rank`` among ``total`` lies: above ``low``, at most ``high``."""

    def __init__(self, rank: int, total: int, first: set[float]) -> None:
        self.rank, self.low, self.high = rank, _number(-inf), _number(inf)
        self.below, self.upto, self.first = 0, total, first

    @property
    def found(self) -> float | None:
        return _value(self.high) if self.high - self.low <= CLOSE else None

    def slopes(self) -> set[float]:
        """Slopes whose counts close the bracket; at first those of a few points."""
        if self.first:
            first, self.first = self.first, set()
            return first
        width = self.high - self.low
        out = {self.low + width * i // (STEPS + 1) for i in range(1, STEPS + 1)}
        low, high = _value(self.low), _value(self.high)
        if isfinite(low) and isfinite(high) and isfinite(high - low):
            middle = low + (high - low) * float((2 * self.rank - 1 - 2 * self.below) / (2 * (self.upto - self.below)))
            out |= {_number(middle + side * part * (high - low)) for part in (0.0, *NEAR) for side in (-1, 1)}
        return {_value(n) for n in out if self.low < n < self.high}

    def learn(self, counts: dict[float, int]) -> None:
        for slope, n in counts.items():
            at = _number(slope)
            if n < self.rank and at > self.low:
                self.low, self.below = at, n
            elif n >= self.rank and at < self.high:
                self.high, self.upto = at, n


def brackets(total: int, x: np.ndarray, y: np.ndarray) -> list[Bracket]:
    """The lower and the upper middle, one bracket where they are the same. Some points say where to look first."""
    i, j = np.triu_indices(min(len(x), LISTED_POINTS), 1)
    some = np.unique(np.linspace(0, len(x) - 1, min(len(x), LISTED_POINTS)).astype(int))
    i, j = i[j < len(some)], j[j < len(some)]
    run = x[some][j] - x[some][i]
    slopes = ((y[some][j] - y[some][i])[run != 0]) / run[run != 0]
    first = {float(s) for s in np.quantile(slopes, FIRST_SHARES)} if len(slopes) else set()
    return [Bracket(rank, total, first) for rank in sorted({(total + 1) // 2, total // 2 + 1})]


def _exact(weights: np.ndarray) -> np.ndarray:
    """Weights whose products can be summed without overflow."""
    return weights.astype(np.int64) if int(weights.sum()) < 1 << 31 else weights.astype(object)


def inversions(rank: np.ndarray, weights: np.ndarray) -> int:
    """Sum of w_i w_j over pairs with rank_i < rank_j where j stands before i; one pass per binary digit of the ranks."""
    total, most = 0, int(rank.max(initial=0))
    rank = rank.astype(np.uint16 if most < 1 << 16 else np.int64)  # short numbers are sorted by their digits
    for digit in range(most.bit_length() - 1, -1, -1):
        right = ((rank >> digit) & 1).astype(bool)
        upto = np.concatenate([[0], np.cumsum(np.where(right, weights, 0))])
        node = rank >> (digit + 1)
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        base = np.repeat(upto[starts], np.diff(np.append(starts, len(rank))))
        left = ~right
        total += int((weights[left] * (upto[1:] - base)[left]).sum())
        order = np.argsort(rank >> digit, kind="stable")
        rank, weights = rank[order], weights[order]
    return total


class Moved:
    """Points in the order of y - slope x; of points on one line the later x comes first, of points with one x the smaller y."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.ties = np.lexsort((y, -x))
        self.x, self.y = x[self.ties], y[self.ties]

    def order(self, slope: float) -> np.ndarray:
        return self.ties[np.argsort(self.y - slope * self.x, kind="stable")]

    def nearest(self, slope: float) -> float | None:
        """The slope of two neighbours in that order that is within rounding of ``slope``, the closest one."""
        at = np.argsort(self.y - slope * self.x, kind="stable")
        step = np.diff(self.x[at])
        some = step != 0
        slopes = np.diff(self.y[at])[some] / step[some]
        close = slopes[np.abs(slopes - slope) <= ROUNDING * max(abs(slope), 1e-300)]
        return float(close[np.argmin(np.abs(close - slope))]) if len(close) else None


def _same_x(x: np.ndarray, weights: np.ndarray) -> int:
    """Sum of w_i w_j over pairs with equal x, for points in the order of x."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    w = weights.astype(object)
    return sum((int(s) ** 2 - int(q)) // 2 for s, q in zip(np.add.reduceat(w, starts), np.add.reduceat(w * w, starts), strict=True))


def _listed(x: np.ndarray, y: np.ndarray, w: np.ndarray, total: int) -> float:
    i, j = np.triu_indices(len(x), 1)
    keep = x[i] < x[j]
    i, j = i[keep], j[keep]
    slope = (y[j] - y[i]) / (x[j] - x[i])
    order = np.argsort(slope, kind="stable")
    upto = np.cumsum((w[i] * w[j])[order])
    middle = [slope[order][int(np.searchsorted(upto, rank))] for rank in ((total + 1) // 2, total // 2 + 1)]
    return float((middle[0] + middle[1]) / 2)


def median_slope(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float | None:
    """Of the points of one group; None where all x are equal."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], _exact(weights[order])
    whole = int(w.sum())
    total = (whole**2 - int((w.astype(object) ** 2).sum())) // 2 - _same_x(x, w)
    if total == 0:
        return None
    if len(x) <= LISTED_POINTS:
        return _listed(x, y, w, total)
    x = x - x[len(x) // 2]
    todo, points = brackets(total, x, y), Moved(x, y)
    while any(b.found is None for b in todo):
        counts = {}
        for slope in set().union(*(b.slopes() for b in todo if b.found is None)):
            moved = points.order(slope)
            counts[slope] = inversions(moved, w[moved])
        for b in todo:
            b.learn(counts)
    middle = [b.found if (own := points.nearest(b.found)) is None else own for b in todo]
    return (middle[0] + middle[-1]) / 2


def _whole_groups(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slope = median_slope(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_w"].to_numpy())
        return pdf[keys].head(1).assign(theil_sen=np.array([slope], float)) if slope is not None else pdf[keys].head(0).assign(theil_sen=np.array([], float))

    return run


_COUNTS = "gid int, slope double, n string"


def _inside_blocks(asked: dict[int, list[float]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Pairs of one block, for all slopes asked of its group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_x", "_y"])
        x, y, w = pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), _exact(pdf["_w"].to_numpy())
        gid = int(pdf["gid"].iloc[0])
        found, points = [], Moved(x, y)
        for slope in asked[gid]:
            moved = points.order(slope)
            found.append((gid, slope, str(inversions(moved, w[moved]))))
        return pd.DataFrame(found, columns=["gid", "slope", "n"])

    return run


def _shares(asked: dict[int, list[float]], cuts: dict[tuple[int, float], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Every point once per slope asked, with the share that its offset falls into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for gid, own in pdf.groupby("gid"):
                for slope in asked[gid]:
                    share = np.searchsorted(cuts[gid, slope], own["_y"].to_numpy() - slope * own["_x"].to_numpy(), side="right")
                    yield own.assign(slope=slope, share=share.astype(np.int32))

    return run


def _inside_shares(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights of a share by block; the first row holds the pairs of different blocks in it."""
    slope = pdf["slope"].iloc[0]
    moved = Moved(pdf["_x"].to_numpy(), pdf["_y"].to_numpy()).order(slope)
    block, w = pdf["block"].to_numpy()[moved], _exact(pdf["_w"].to_numpy()[moved])
    blocks, place = np.unique(block, return_inverse=True)
    n = inversions(place, w)
    sums = pd.DataFrame({"block": block, "w": w}).groupby("block")["w"].sum()
    return pd.DataFrame({"gid": pdf["gid"].iloc[0], "slope": slope, "share": pdf["share"].iloc[0], "block": blocks, "w": [str(v) for v in sums], "n": [str(n)] + ["0"] * (len(blocks) - 1)})


def _neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """The slope of a pair of this share that stands for the slope found."""
    slope = float(pdf["slope"].iloc[0])
    own = Moved(pdf["_x"].to_numpy(), pdf["_y"].to_numpy()).nearest(slope)
    return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "slope": [slope], "own": np.array([own], float)})


def _between(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different blocks and shares of one slope, and those inside the shares."""
    blocks, place = np.unique(pdf["block"].to_numpy(), return_inverse=True)
    pdf = pdf.assign(place=place).sort_values("share")
    before = np.zeros(len(blocks), object)  # weights of the shares before, by block
    total = sum(int(n) for n in pdf["n"])
    for _, own in pdf.groupby("share", sort=True):
        later = np.append(np.cumsum(before[::-1])[::-1], 0)
        w = np.array([int(v) for v in own["w"]], object)
        total += int((w * later[own["place"].to_numpy() + 1]).sum())
        before[own["place"].to_numpy()] += w
    return pd.DataFrame({"gid": [pdf["gid"].iloc[0]], "slope": [pdf["slope"].iloc[0]], "n": [str(total)]})


def _large_groups(points: DataFrame, keys: list[str], sizes: DataFrame, block_rows: int) -> DataFrame:
    """(keys, theil_sen) of the groups of ``sizes`` (keys, _n), each larger than a block."""
    spark = points.sparkSession
    names = sizes.select(*keys, "_n").withColumn("gid", F.row_number().over(Window.orderBy("_n")))  # few: one per block of points at most
    names = materialize(names, "large_groups")
    same = [points[k].eqNullSafe(names[k]) for k in keys]
    same = reduce(lambda a, b: a & b, same, F.lit(True))
    own = points.join(F.broadcast(names), same).select("gid", "_n", "_x", "_y", "_w")
    rows = own.agg(F.count("*")).first()[0]
    ranged = own.repartitionByRange(max(2, -(-rows // block_rows)), "gid", "_x", "_y").withColumn("block", F.spark_partition_id())
    ranged = materialize(ranged, "blocks")
    centres = {r.gid: r.x for r in ranged.groupBy("gid").agg(F.avg("_x").alias("x")).collect()}
    table = spark.createDataFrame([(g, float(x)) for g, x in centres.items()], "gid int, _cx double")
    placed = materialize(ranged.join(F.broadcast(table), "gid").select("gid", "_n", "block", (F.col("_x") - F.col("_cx")).alias("_x"), "_y", "_w"), "blocks")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    weights = {r.gid: int(r.w) for r in placed.groupBy("gid").agg(wide("_w").alias("w")).collect()}
    one_x = placed.groupBy("gid", "_x").agg(wide("_w").alias("w")).groupBy("gid").agg(F.sum(F.col("w") * F.col("w")).alias("q")).collect()
    totals = {r.gid: (weights[r.gid] ** 2 - int(r.q)) // 2 for r in one_x}
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    few = placed.where(F.pmod(F.xxhash64("_x", "_y"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / SAMPLE_POINTS))) == 0)
    for gid, part in few.select("gid", "_x", "_y").toPandas().groupby("gid"):
        sample[int(gid)] = (part["_x"].to_numpy(), part["_y"].to_numpy())
    shares = {r.gid: max(1, -(-r.n // block_rows)) for r in placed.groupBy("gid").agg(F.count("*").alias("n")).collect()}
    live_groups = lambda gids: placed.where(F.col("gid").isin(list(gids))).drop("_n")

    def dealt(asked: dict[int, list[float]]) -> DataFrame:
        cuts = {(gid, s): np.quantile(sample[gid][1] - s * sample[gid][0], np.arange(1, shares[gid]) / shares[gid]) for gid, slopes in asked.items() for s in slopes}
        return live_groups(asked).mapInPandas(_shares(asked, cuts), "gid int, block int, _x double, _y double, _w long, slope double, share int").groupBy("gid", "slope", "share")

    todo = {gid: brackets(total, *sample[gid]) for gid, total in totals.items() if total > 0}
    while open_ones := {gid: own for gid, own in todo.items() if any(b.found is None for b in own)}:
        asked = {gid: sorted(set().union(*(b.slopes() for b in own if b.found is None))) for gid, own in open_ones.items()}
        inside = live_groups(asked).groupBy("gid", "block").applyInPandas(_inside_blocks(asked), _COUNTS)
        by_share = dealt(asked).applyInPandas(_inside_shares, "gid int, slope double, share int, block int, w string, n string")
        between = by_share.groupBy("gid", "slope").applyInPandas(_between, _COUNTS)
        counts: dict[int, dict[float, int]] = {}
        for r in inside.unionByName(between).groupBy("gid", "slope").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            counts.setdefault(r.gid, {})[r.slope] = int(r.n)
        for gid, own in open_ones.items():
            for b in own:
                b.learn(counts[gid])
    ends = dealt({gid: sorted({b.found for b in own}) for gid, own in todo.items()}).applyInPandas(_neighbours, "gid int, slope double, own double")
    close = F.min_by("own", F.abs(F.col("own") - F.col("slope")))
    own_slope = {(r.gid, r.slope): r.own for r in ends.where("NOT isnan(own)").groupBy("gid", "slope").agg(close.alias("own")).collect()}
    answers = [(gid, sum(own_slope.get((gid, b.found), b.found) for b in (own[0], own[-1])) / 2) for gid, own in todo.items()]
    return names.join(spark.createDataFrame(answers, "gid int, theil_sen double"), "gid").select(*keys, "theil_sen")


def median_pair_slope(points: DataFrame, keys: tuple[str, ...], x: str, y: str, block_rows: int = BLOCK_ROWS, task_rows: int | None = None) -> DataFrame:
    """(keys, theil_sen): the median slope over all pairs of rows with different x.

    Equal points are folded and weigh as often as they occur. Rows where x or y is null or not finite take no
    part; groups with a single x are absent; a NULL key is a group of its own. Groups beyond ``task_rows`` points are
    cut into blocks; smaller blocks than usual are for groups that should be cut from there on.
    """
    if task_rows is None:
        task_rows = TASK_ROWS if block_rows >= BLOCK_ROWS else block_rows
    usable = F.col(x).isNotNull() & F.col(y).isNotNull() & (F.abs(F.col(x).cast("double")) < inf) & (F.abs(F.col(y).cast("double")) < inf)
    # adding 0.0 makes the two zeros one
    rows = points.where(usable).groupBy(*keys, (F.col(x).cast("double") + 0.0).alias("_x"), (F.col(y).cast("double") + 0.0).alias("_y")).agg(F.count("*").alias("_w"))
    rows = materialize(rows, "points")
    group = list(keys)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > task_rows), "large")
    schema = StructType([rows.schema[k] for k in group]).add("theil_sen", DoubleType())
    # few rows but much work for each: the stated number of tasks is not merged down to one
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: (df.repartition(tasks, *group) if group else df).groupBy(*group)
    if large.isEmpty():
        return dealt(rows).applyInPandas(_whole_groups(group), schema)
    named = large.select(*[F.col(k).alias(f"_of_{k}") for k in group])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in group], F.lit(True))
    small = dealt(rows.join(F.broadcast(named), same, "left_anti")).applyInPandas(_whole_groups(group), schema)
    return small.unionByName(_large_groups(rows, group, large, block_rows))
