"""Mixing sources to target weights over a tree of domain, language and source.

Every leaf can give its tokens times the allowed epochs; an inner node can give what its leaves
can. A node's budget goes to its children by weight. Children that cannot use their share give
what they can, and the rest goes to their siblings by weight, so a shortage is made good next to
where it arises and leaves the node only if all its children are exhausted: the shares of a level
are the smallest capacity or a common multiple of the weight, found by one running sum over the
children ordered by capacity per weight.

A leaf's budget is spent on whole epochs and then on a prefix of one more epoch, whose order is
a digest of seed, epoch, document id and text. The prefix is found by summing tokens over ranges of the
digest first, so a leaf with a third of all rows is no single task.

Defined results: null languages and sources are leaves of their own; null, empty and wordless
texts have no tokens and are taken with the epoch or prefix that reaches them; rows without an id or
with a repeated one are told apart by their text; of rows equal in both, whichever they are, as many are
taken as the budget has room for; weights are positive whole numbers, 1 where none is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.joins import with_single_row
from skylattice.functions.ranks import numbered
from skylattice.llm.common import materialize

LEVELS = ("domain", "lang", "source")
SEED = 2_048
RANGE_ROWS = 4_000  # rows of one running sum, about
BROADCAST_LEAVES = 50_000
#: Stands for the text in the order of an epoch; null: no text.
MARK = "substring(md5(text), 1, 16)"
WORD = r"[^\x20\x09-\x0D]+"


def domain_of() -> Column:
    """The domain of a source: its trailing number modulo 4; sources without one are 'other'."""
    number = F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("int")
    return F.when(number.isNull(), F.lit("other")).otherwise(F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, domain, lang, source, n_tokens): the leaf and size of every row; tokens are words here."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(MARK).alias("mark"), domain_of().alias("domain"), "lang", "source", tokens.alias("n_tokens"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The weight of a node's name at a level."""
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out


def _shared(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Children (parent, level, capacity, weight, given) with their ``budget``; whole tokens, exact in sum.

    ``given``, the parent's budget, is at most the sum of the capacities."""
    order = Window.partitionBy(*parent, F.lit(0)).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(level).asc_nulls_first())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    wide = lambda c: c.cast("decimal(25,0)")
    left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = wide(F.col("capacity")) * F.sum("weight").over(after) <= wide(left) * F.col("weight")
    marked = children.withColumn("full", full)
    group = Window.partitionBy(*parent, F.lit(0))
    rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.when(~F.col("full"), F.col("weight")).otherwise(0)
    upto = F.sum(open_weight).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(open_weight).over(group)
    part = lambda w: F.floor(wide(F.col("rest")) * w / F.col("whole")).cast("long")
    placed = marked.withColumns({"rest": rest, "upto": upto, "whole": whole, "own": open_weight})
    share = part(F.col("upto")) - part(F.col("upto") - F.col("own"))
    return placed.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share)).drop("full", "rest", "upto", "whole", "own", "weight", "given")


def leaf_budgets(rows: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, rows, budget) of every leaf; the whole budget is ``percent`` of all tokens."""
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    # whole tokens that all leaves can give, and how many of them are wanted
    given = leaves.agg(F.least(F.floor(F.sum("tokens") * percent / 100), F.sum("tokens") * epochs).cast("long").alias("given"))
    parent: list[str] = []
    above: DataFrame | None = None
    for level in LEVELS:
        names = [*parent, level]
        children = leaves.groupBy(*names).agg((F.sum("tokens") * epochs).alias("capacity")).withColumn("weight", _weight(level, weights))
        if above is None:
            children = with_single_row(children, given)
        else:
            up = above.select(*(F.col(c).alias(f"up_{c}") for c in parent), F.col("budget").alias("given"))
            same = [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in parent]
            children = children.join(up, same).drop(*(f"up_{c}" for c in parent))
        above = materialize(_shared(children, parent, level), "budgets")
        parent = names
    sizes = leaves.select(*(F.col(c).alias(f"of_{c}") for c in LEVELS), "tokens", "rows")
    return above.join(sizes, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in LEVELS]).select(*LEVELS, "tokens", "rows", "budget")


def order_key(epoch: Column, seed: int) -> Column:
    """Text that orders the documents of an epoch at random but repeatably; equal only for rows equal in id and text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("mark", F.lit(""))))


def _to_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with the columns of their leaf. A table of up to ``BROADCAST_LEAVES`` goes to every task."""
    of = leaves.select(*(F.col(c).alias(f"of_{c}") for c in LEVELS), *(c for c in leaves.columns if c not in LEVELS))
    if leaves.count() <= BROADCAST_LEAVES:
        of = F.broadcast(of)
    return rows.join(of, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in LEVELS]).drop(*(f"of_{c}" for c in LEVELS))


def leaf_cuts(rows: DataFrame, budgets: DataFrame, epochs: int, seed: int) -> DataFrame:
    """(domain, lang, source, whole, cut, edge, room): whole epochs of every leaf and the last key of its prefix (null: none).

    ``edge`` is the next key where it is shared by more rows than fit, of which ``room`` are taken; else null."""
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    leaves = budgets.select(*LEVELS, "rows", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("wanted"))
    leaves = materialize(leaves, "leaf_wants")
    keyed = _to_leaves(rows, leaves.where(F.col("whole") < epochs)).withColumn("key", order_key(F.col("whole") + 1, seed))
    ranges = F.ceil(F.col("rows") / RANGE_ROWS).cast("long")
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("long"))
    sums = keyed.groupBy(*LEVELS, "wanted", "range").agg(F.sum("n_tokens").alias("tokens"), F.max("key").alias("last"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))), "ranges")
    below = sums.where(F.col("before") + F.col("tokens") <= F.col("wanted")).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    # the first range that is not taken whole; ranges are numbered upwards and sums never fall
    crossing = sums.where(F.col("before") + F.col("tokens") > F.col("wanted")).groupBy(*LEVELS).agg(F.min_by("range", "range").alias("crossing"), F.min_by("before", "range").alias("before"))
    # equal rows are one row here, however many
    inside = _to_leaves(keyed, crossing).where("range = crossing").groupBy(*LEVELS, "key").agg(
        F.first("wanted").alias("wanted"), F.first("before").alias("before"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("copies")
    )
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key")) + F.col("before")
    inside = inside.withColumn("running", running)
    some = inside.where("running <= wanted").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cuts = below.unionByName(some).groupBy(*LEVELS).agg(F.max("last").alias("cut"))
    over = inside.where("running > wanted").withColumn("room", F.expr("(wanted - running + tokens) div (tokens div copies)"))
    edges = over.groupBy(*LEVELS).agg(F.min(F.struct("key", "room")).alias("e")).where("e.room > 0").select(*LEVELS, F.col("e.key").alias("edge"), F.col("e.room").alias("room"))
    for found, names in ((cuts, ["cut"]), (edges, ["edge", "room"])):
        of = found.select(*(F.col(c).alias(f"of_{c}") for c in LEVELS), *names)
        leaves = leaves.join(of, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in LEVELS], "left").drop(*(f"of_{c}" for c in LEVELS))
    return leaves.select(*LEVELS, "whole", "cut", "edge", "room")


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them."""
    sizes = materialize(measured(docs), "sizes")
    cuts = materialize(leaf_cuts(sizes, leaf_budgets(sizes, weights, percent, epochs), epochs, seed), "cuts")
    # whole rows travel as one column, so no name of theirs can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(MARK).alias("mark"), domain_of().alias("domain"), "lang", "source", F.struct("*").alias("row"))
    return taken(rows, cuts, seed).select("row.*")


def taken(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, mark, domain, lang, source and others) once per epoch that takes them; ``cuts`` is a written table."""
    names = [c for c in rows.columns if c != "mark"]
    at = _to_leaves(rows, cuts).withColumn("key", F.when(F.col("cut").isNotNull() | F.col("edge").isNotNull(), order_key(F.col("whole") + 1, seed)))

    def out(df: DataFrame, one_more: Column) -> DataFrame:
        times = F.col("whole") + F.when(one_more, 1).otherwise(0)
        return df.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*names, "epoch")

    sure = out(at.where(~F.coalesce(F.col("key") == F.col("edge"), F.lit(False))), F.col("key") <= F.col("cut"))
    if cuts.where("edge IS NOT NULL").isEmpty():
        return sure
    # rows that are equal and do not all fit: written once, so that their numbers stay
    equal = materialize(at.where(F.col("key") == F.col("edge")).withColumn("_o", F.monotonically_increasing_id()), "equal_rows")
    return sure.unionByName(out(numbered(equal, LEVELS, "_o", "_i"), F.col("_i") < F.col("room")))
