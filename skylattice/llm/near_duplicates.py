"""Near duplicates on word shingles by SetSketch registers.

A document's set holds its distinct k-word shingles (ASCII lower case, words cut at ASCII white
space; with fewer words than k the whole sequence is the one shingle). The smallest value that a
register's hash takes over the set is an exponential minimum; the register keeps its level on a
grid of base ``BASE``, truncated to a byte. Registers of two sets merge by maximum, agree with a
chance that grows with the similarity, and are the same wherever the set is computed.

Steps, each on whole tables:

1. One pass over the texts: set size, set fingerprint, registers. Equal sets fold to one node.
2. Bands of registers are grouped with map-side counts. A bucket of two nodes is a pair and is
   kept only if the likelihood of the registers, with both set sizes known, does not rule out the
   threshold; larger buckets link their members to their smallest node.
3. Components of these candidates are families; only their texts are read again. A family is cut
   into chunks of bounded size that share some members (hubs), and every chunk compares full sets
   exactly, giving a spanning forest of the true links instead of pairs.
4. In families of several chunks, members outside the family's largest component visit all its
   chunks, in blocks of bounded size, so that every pair that is not linked yet is compared.
5. Components of the confirmed links.

Defined results: null and wordless texts have size 0, are linked with nothing and are kept; rows
without an id take part in the links under a number above all ids, but are never kept, and their
component is null when no member has an id; rows that repeat an id and a text count as one document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.ranks import numbered
from skylattice.llm.common import materialize, mix, per_batch, pieces, to_bytes, word_numbers
from skylattice.operators.components import connected_components

BANDS, ROWS = 42, 6  # chance to miss a pair at similarity 0.8: (1 - 0.8^6)^42 < 3e-6
REGISTERS = BANDS * ROWS
BASE = 2.0 ** 0.125
LEVELS = 255
CHUNK = 256
HUBS = 32
BROADCAST_NODES = 500_000  # candidates of 28 bytes that every executor may hold
BLOCK_SHINGLES = 200_000
SLACK = 10.0  # log-likelihood: a pair at the threshold is ruled out with a chance below 1e-5
_SEEDS = np.random.default_rng(20_480)
MULTIPLIERS = _SEEDS.integers(1, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
OFFSETS = _SEEDS.integers(0, 2**32, REGISTERS, dtype=np.uint32)

WORD = r"[^\x20\x09-\x0D]"


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; for sets of this size a plain sort takes a third of the time of numpy's ``unique``."""
    ordered = np.sort(hashes)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text its sorted distinct 64-bit shingle hashes."""
    return [s for piece in pieces(texts) for s in _shingles(piece, k)]


def _shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    place, number, vocabulary = word_numbers(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, to_bytes(vocabulary)), np.uint64, len(vocabulary))[number]
    words = np.bincount(place, minlength=len(texts))
    width = np.minimum(words, k)[place]
    out = width.astype(np.uint64)
    for i in range(k):
        out = np.where(i < width, mix(out * np.uint64(0x9E3779B97F4A7C15) + np.roll(hashes, -i)), out)
    left = np.cumsum(words)[place] - np.arange(len(place))  # words from here to the end of the text
    ends = np.cumsum(np.where(words > 0, np.maximum(words - k + 1, 1), 0))
    return [_distinct(s) for s in np.split(out[left >= width], ends[:-1])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per non-empty set."""
    out = np.empty((len(sets), REGISTERS), np.uint8)
    lengths = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + lengths[stop] <= BLOCK_SHINGLES):
            total += lengths[stop]
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        cuts = np.concatenate(([0], np.cumsum(lengths[start : stop - 1])))
        least = np.empty((stop - start, REGISTERS), np.uint32)
        for r in range(REGISTERS):
            h = x * MULTIPLIERS[r]
            h += OFFSETS[r]
            least[:, r] = np.minimum.reduceat(h, cuts)
        # -log(1 - u) is the exponential of the smallest u; its level grows as it shrinks
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0)
        out[start:stop] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, LEVELS)
        start = stop
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, regs) of every row; key and registers are null for empty sets."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingles(batch.column(1), k)
        filled = [i for i, s in enumerate(sets) if len(s)]
        regs = registers([sets[i] for i in filled])
        keys: list[bytes | None] = [None] * len(sets)
        packed: list[bytes | None] = [None] * len(sets)
        for row, i in enumerate(filled):
            keys[i], packed[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), regs[row].tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
            ["doc_id", "n_shingles", "set_key", "regs"],
        )

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), work, "doc_id long, n_shingles long, set_key binary, regs binary")


def _level_share(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is above that of the other, given the share of its own elements."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the registers leave a similarity of ``percent`` or more possible (joint likelihood)."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - above - below
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _level_share(u - v * j), _level_share(v - u * j)
        tiny = 1e-9
        return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))

    best = np.max([log_likelihood(most * s) for s in np.linspace(0.02, 0.995, 40)], axis=0)
    least = percent / 100
    reach = np.max([log_likelihood(np.minimum(most, least + (most - least) * s)) for s in np.linspace(0, 0.98, 12)], axis=0)
    return (most >= least - 1e-12) & (reach >= best - SLACK)


def candidate_edges(nodes: DataFrame, percent: int) -> DataFrame:
    """(src, dst) whose components hold every pair that some band brings together."""
    bands = nodes.select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * ROWS + 1, F.lit(ROWS))))).alias("band")
    )
    buckets = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("n > 1 AND low < high")
    buckets = materialize(buckets, "buckets")
    pairs = buckets.where("n = 2").select("low", "high").distinct()
    side = nodes.select("node", "n_shingles", "regs")
    both = pairs.join(side.toDF("low", "n_low", "r_low"), "low").join(side.toDF("high", "n_high", "r_high"), "high")
    both = both.where(F.least("n_low", "n_high") * 100 >= F.greatest("n_low", "n_high") * percent)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("r_low", "r_high"))
        keep = plausible(a, b, batch.column("n_low").to_numpy(), batch.column("n_high").to_numpy(), percent)
        return batch.select(["low", "high"]).filter(pa.array(keep))

    filtered = per_batch(both, work, "low long, high long")
    stars = bands.join(buckets.where("n > 2").select("band", "low"), "band").where("low < node").select("low", F.col("node").alias("high"))
    return filtered.unionByName(stars).distinct().toDF("src", "dst")


def _intersections(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every row set with every column set, in column blocks of bounded width."""
    items = rows + cols
    owner = np.repeat(np.arange(len(items)), [len(s) for s in items])
    values, code, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = counts > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], renumbered[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(code, (low, low + width))
        block = np.zeros((len(items), width), np.float32)
        block[owner[lo:hi], code[lo:hi] - low] = 1
        out += block[: len(rows)] @ block[len(rows) :].T
    return out.astype(np.int64)


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those pairs that join two trees."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(int(a)), root(int(b))
        if ra != rb:
            parent[ra] = rb
            kept.append((int(a), int(b)))
    return kept


_EDGES = "src long, dst long"


def _links(node: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    ends = node[np.array(edges, np.int64).reshape(-1, 2)]
    return pa.table({"src": ends[:, 0], "dst": ends[:, 1]})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in table.column("elements").to_pylist()]


def chunk_links(percent: int):
    """Confirmed links among the members of one chunk, as a spanning forest."""

    def work(chunk: pa.Table) -> pa.Table:
        sets, node = _sets(chunk), chunk.column("node").to_numpy()
        size = np.array([len(s) for s in sets])
        common = _intersections(sets, sets)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        a, b = np.nonzero(np.triu(linked & (node[:, None] != node[None, :]), 1))
        return _links(node, _forest(len(sets), np.stack([a, b], 1)))

    return work


def visit_links(percent: int):
    """Confirmed links between a block of visitors and a chunk, only between different components."""

    def work(block: pa.Table) -> pa.Table:
        guest = block.column("guest")
        home, guests = block.filter(pc.invert(guest)), block.filter(guest)
        node, component = (np.concatenate([side.column(c).to_numpy() for side in (guests, home)]) for c in ("node", "component"))
        if not home.num_rows or not guests.num_rows:
            return _links(node, [])
        rows, cols = _sets(guests), _sets(home)
        n, m = (np.array([len(s) for s in side]) for side in (rows, cols))
        common = _intersections(rows, cols)
        apart = component[: len(rows), None] != component[None, len(rows) :]
        a, b = np.nonzero((100 * common >= percent * (n[:, None] + m[None, :] - common)) & apart)
        return _links(node, _forest(len(rows) + len(cols), np.stack([a, b + len(rows)], 1)))

    return work


def candidate_texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The texts of the nodes in ``placed``, with its columns. While these are few, the texts of all others are not shuffled."""
    how = "broadcast" if placed.count() <= BROADCAST_NODES else "merge"
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(placed.hint(how), "node").select("text", *placed.columns)


def _bare_sets(docs: DataFrame, bare: DataFrame, k: int) -> DataFrame:
    """(node, elements) of the sets that only rows without an id have."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in shingles(batch.column(0), k)]
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b) for b in packed], pa.binary()), pa.array(packed, pa.binary())], ["set_key", "elements"])

    sets = per_batch(docs.where("doc_id IS NULL").select("text"), work, "set_key binary, elements binary").where("length(elements) > 0")
    return sets.groupBy("set_key").agg(F.first("elements").alias("elements")).join(bare.select("set_key", "node"), "set_key").select("node", "elements")


def confirmed_links(docs: DataFrame, edges: DataFrame, k: int, percent: int, bare: DataFrame | None = None) -> DataFrame:
    """A spanning forest of the true links inside the components of the candidate edges.

    ``bare``: (set_key, node) of sets that only rows without an id have."""
    family = connected_components(edges)
    sizes = family.groupBy("component").agg(F.count("*").alias("members"))
    placed = family.join(sizes, "component").select(
        "node", F.col("component").alias("family"), F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("members") / HUBS).cast("int").alias("hub_step")
    )
    placed = materialize(placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "placed")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in shingles(batch.column(0), k)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(packed, pa.binary())], [*batch.schema.names[1:], "elements"])

    sets = per_batch(candidate_texts(docs, placed), work, "node long, family long, chunks int, hub_step int, chunk int, elements binary").where("length(elements) > 0")
    if bare is not None:
        sets = sets.unionByName(_bare_sets(docs, bare, k).join(placed.hint("merge"), "node"))
    sets = materialize(sets, "family_sets")
    hub = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("hub_step")) == 0)
    seats = F.when(hub, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    seated = sets.select("family", F.explode(seats).alias("chunk"), "node", "elements")
    first = materialize(seated.groupBy("family", "chunk").applyInArrow(chunk_links(percent), _EDGES), "links")

    large = sets.where("chunks > 1")
    if large.isEmpty():
        return first
    inside = connected_components(first.join(large.select(F.col("node").alias("src")).distinct(), "src", "left_semi"))
    marked = large.join(inside, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = materialize(marked, "marked")
    counted = marked.groupBy("family", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("family").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n_main"))
    main = main.select("family", "main", F.ceil((F.col("all") - F.col("n_main")) / CHUNK).cast("int").alias("blocks")).where("blocks > 0")
    ready = marked.join(main, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int"))
    at_home = ready.select("family", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "component", F.lit(False).alias("guest"), "elements")
    guests = ready.where("component <> main").select(
        "family", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "node", "component", F.lit(True).alias("guest"), "elements"
    )
    second = at_home.unionByName(guests).groupBy("family", "chunk", "block").applyInArrow(visit_links(percent), _EDGES)
    return first.unionByName(second)


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """The sketches of all rows, the (set_key, component) of all sets, and the largest component that is an id."""
    sketched = materialize(sketches(docs, k), "sketches")
    filled = sketched.where("set_key IS NOT NULL")
    keys = filled.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes, bare = materialize(keys, "nodes"), None
    top, n_bare = nodes.agg(F.coalesce(F.max("node"), F.lit(-1)), F.count_if(F.col("node").isNull())).first()
    if n_bare:
        # an id that is not the smallest of its set may be above every node
        top = max(top, filled.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0])
        if top + n_bare >= 2**63:
            raise ValueError("the ids leave no room for numbers of rows without an id")
        unnamed = nodes.where("node IS NULL").drop("node").withColumn("_o", F.xxhash64("set_key"))
        bare = materialize(numbered(unnamed, (), "_o", "_i").select("set_key", (F.lit(top + 1) + F.col("_i")).cast("long").alias("node"), "n_shingles", "regs"), "bare")
        nodes = nodes.where("node IS NOT NULL").unionByName(bare)
    links = confirmed_links(docs, candidate_edges(nodes, percent), k, percent, bare)
    components = connected_components(links)
    of_key = nodes.select("set_key", "node").join(components, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    return sketched, of_key, top


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    sketched, of_key, top = _components(docs, k, percent)
    own = sketched.drop("regs").join(of_key, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).when(F.col("component") <= top, F.col("component"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _texts_of_bare_components(docs: DataFrame, of_key: DataFrame, top: int, k: int) -> DataFrame:
    """(hash) of the texts without an id that stay: the first of every component without ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in shingles(batch.column(1), k)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), keys], ["hash", "set_key"])

    texts = docs.where(F.col("doc_id").isNull() & F.col("text").rlike(WORD)).groupBy(F.md5("text").alias("hash")).agg(F.first("text").alias("text"))
    placed = per_batch(texts, work, "hash string, set_key binary").join(of_key.hint("merge"), "set_key")
    return placed.where(F.col("component") > top).groupBy("component").agg(F.min("hash").alias("hash")).select("hash")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the document with the smallest id stays.

    Rows that repeat an id and a text become one. A component without any id keeps one row; rows without an id
    whose component has one go. Texts without words are linked with nothing: they stay, once per id, and every
    row without both id and words stays."""
    sketched, of_key, top = _components(docs, k, percent)
    of_key = materialize(of_key, "components")
    smallest = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    kept = sketched.where("doc_id IS NOT NULL").drop("regs").join(of_key, "set_key", "left").where(F.col("doc_id") == smallest).select("doc_id").distinct()
    # whole rows travel as one column, so no name of theirs can clash
    known = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    single = known.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")
    bare = docs.where("doc_id IS NULL").select(F.md5("text").alias("hash"), F.struct("*").alias("row"))
    if bare.isEmpty():
        return single
    worded = F.coalesce(F.col("row.text").rlike(WORD), F.lit(False))
    once = bare.where(worded).dropDuplicates(["hash"]).join(_texts_of_bare_components(docs, of_key, top, k), "hash", "left_semi")
    return single.unionByName(once.select("row.*")).unionByName(bare.where(~worded).select("row.*"))
