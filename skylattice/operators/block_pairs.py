"""Counts of pairs that meet a condition, without forming all pairs of a dense cell.

Items lie in roots (cells). A pair of roots is judged by the limits of what they hold: where the condition is sure
for every pair the sizes are multiplied, where it is impossible the pair goes, and where both sides are small the
items meet. Only what is left is cut in halves along every axis and judged again, so work follows the items near
the border of the condition instead of the square of a cell. Every level is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize

DEPTH = 24  # halvings of a root's side; items that still share a block then meet whatever their number
PAIR_ITEMS = 16_384  # item pairs of two blocks that are compared rather than cut again

TASK_PAIRS = 4_000_000  # item pairs of one task, about: small inputs grow here, so their size says nothing

#: (lower, upper) bound of a value over one side's items.
Span = tuple[Column, Column]
#: From the spans of both sides: the condition holds for all pairs, and for none. At single items one is the other's negation.
Bound = Callable[[dict[str, Span], dict[str, Span]], tuple[Column, Column]]


def _code(level: int, axes: int) -> Column:
    return F.array(*[F.shiftright(F.col(f"_q{i}"), DEPTH - level) for i in range(axes)])


def _spans(side: str, values: Sequence[str], single: bool) -> dict[str, Span]:
    names = {v: (v, v) if single else (f"lo_{v}", f"hi_{v}") for v in values}
    return {v: (F.col(f"{side}.{lo}"), F.col(f"{side}.{hi}")) for v, (lo, hi) in names.items()}


def count_pairs(items: DataFrame, roots: DataFrame, places: Sequence[Column], values: Sequence[str], bound: Bound, *,
                once: bool = False, pair_items: int = PAIR_ITEMS) -> DataFrame:
    """(root_a, root_b, n): pairs of the condition per pair of roots, none left out; root pairs without any give no row.

    ``items``: root, n (how often the item counts) and the ``values`` that ``bound`` reads; ``places`` put an item into
    its root, each from 0 to below 1. ``roots``: the pairs (root_a, root_b) to judge. With ``once`` a pair of roots is
    left as soon as it has a pair, and n only tells that there is one.
    """
    axes = len(places)
    inside = {f"_q{i}": F.floor(F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 2.0**-DEPTH)) * 2**DEPTH).cast("int") for i, p in enumerate(places)}
    placed = materialize(items.select("root", "n", *values, *[c.alias(q) for q, c in inside.items()]), "items")
    limits = [f(v).alias(f"{at}_{v}") for v in values for f, at in ((F.min, "lo"), (F.max, "hi"))]
    todo, found = roots.select("root_a", "root_b"), []
    for level in range(DEPTH + 1):
        code = _code(level, axes)
        here = placed
        if level:
            above = _code(level - 1, axes)
            cut = todo.select(F.explode(F.array(F.struct(F.col("root_a").alias("root"), F.col("code_a").alias("up")), F.struct(F.col("root_b").alias("root"), F.col("code_b").alias("up")))).alias("c"))
            here = placed.withColumn("up", above).join(cut.select("c.*").distinct(), ["root", "up"], "left_semi")
        blocks = here.groupBy("root", code.alias("code")).agg(F.count("*").alias("items"), F.sum("n").alias("n"), *limits)
        blocks = materialize(blocks.withColumn("up", F.transform("code", lambda c: F.shiftright(c, 1))), "blocks")
        measures = F.struct("code", "items", "n", *[f"{at}_{v}" for v in values for at in ("lo", "hi")])

        def of(s: str, blocks: DataFrame = blocks, measures: Column = measures) -> DataFrame:
            return blocks.select(F.col("root").alias(f"root_{s}"), F.col("up").alias(f"code_{s}"), measures.alias(s))

        keys = {s: [f"root_{s}", f"code_{s}"] if level else [f"root_{s}"] for s in "ab"}
        met = todo
        for s in "ab":
            met = met.join(of(s) if level else of(s).drop(f"code_{s}"), keys[s])
        sure, never = bound(_spans("a", values, False), _spans("b", values, False))
        few = (F.col("a.items") * F.col("b.items") <= pair_items) | F.lit(level == DEPTH)
        verdict = F.when(F.coalesce(sure, F.lit(False)), "all").when(F.coalesce(never, F.lit(False)), "none").when(few, "meet").otherwise("cut")
        judged = materialize(met.select("root_a", "root_b", "a", "b", verdict.alias("verdict")).where("verdict <> 'none'"), "judged")
        whole = judged.where("verdict = 'all'").select("root_a", "root_b", (F.col("a.n") * F.col("b.n")).alias("n"))
        row = placed.select("root", code.alias("code"), F.struct("n", *values).alias("item"))
        meet = judged.where("verdict = 'meet'").select("root_a", "root_b", F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b"))
        work = judged.where("verdict = 'meet'").agg(F.coalesce(F.sum(F.col("a.items") * F.col("b.items")), F.lit(0))).first()[0]
        tasks = 1 + work // TASK_PAIRS
        for s in "ab":
            at = [f"root_{s}", f"code_{s}"]
            side = row.select(F.col("root").alias(at[0]), F.col("code").alias(at[1]), F.col("item").alias(s))
            meet = meet.repartition(tasks, *at).join(side.repartition(tasks, *at), at)
        holds, _ = bound(_spans("a", values, True), _spans("b", values, True))
        single = meet.where(holds).select("root_a", "root_b", (F.col("a.n") * F.col("b.n")).alias("n"))
        hits = materialize(whole.unionByName(single).groupBy("root_a", "root_b").agg(F.sum("n").alias("n")), "hits")
        found.append(hits)
        todo = judged.where("verdict = 'cut'").select("root_a", "root_b", F.col("a.code").alias("code_a"), F.col("b.code").alias("code_b"))
        if once:
            todo = todo.join(hits.select("root_a", "root_b"), ["root_a", "root_b"], "left_anti")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).groupBy("root_a", "root_b").agg(F.sum("n").alias("n"))
