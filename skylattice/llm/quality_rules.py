"""Quality rules judged by an isolation forest on their statistics.

Words are runs of characters other than ASCII white space. A document fails outright below
``MIN_WORDS`` words or when more than half of its words lie in repeated 3-word windows. For the
others a forest of random splits gives the mean path length to isolation; short paths are
anomalies. Repetition is left to the outright rule. Every tree is grown on all labelled rows, level by
level: a pass gathers the rows of both kinds and the limits of every feature per open node. Low rows weigh
so little that they make up ``LOW_SHARE``; masses are scaled so that the root has ``TREE_ROWS``, and a node of mass 1 is
isolated, which bounds the trees for any number of rows. The score's cut is calibrated on all labelled rows: low-quality
rows beyond it count for it, good rows beyond it ``LOSS_WEIGHT`` times against it.

Defined results: null, empty and wordless texts have zero statistics and fail; without labelled
rows of both kinds only the outright rules decide; a document labelled more than once takes its
lowest label; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.ranks import running_sums
from skylattice.llm.common import materialize, per_batch, pieces, to_bytes, word_numbers

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 200
TREE_ROWS = 256  # mass of a tree's root
LOW_SHARE = 0.02
LOSS_WEIGHT = 5
SEED = 97
WALK_ROWS = 8_192  # rows that go down the trees together

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
MARKS = b"!?|*#$%&<>=_~^"
CONTINUATION = bytes(range(0x80, 0xC0))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPES = ("n_upper", "n_lower", "n_marks", "top_word", "n_distinct")


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def statistics(texts: pa.Array) -> np.ndarray:
    """``COUNTS`` and ``SHAPES`` of every text, one row each."""
    return np.concatenate([_of_piece(piece) for piece in pieces(texts)])


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` and ``SHAPES`` of one text."""
    return tuple(statistics(pa.array([text], pa.large_string()))[0].tolist())


def _of_piece(texts: pa.Array) -> np.ndarray:
    place, word, vocabulary = word_numbers(texts)
    n_words = max(len(vocabulary), 1)
    own, keys = pd.factorize(place * np.int64(n_words) + word)  # numbers the words of every text for itself
    times, text = np.bincount(own, minlength=len(keys)), keys // n_words
    n, distinct = (np.bincount(where, minlength=len(texts)) for where in (place, text))
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, text, times)
    repeated = np.bincount(place[_covered(place, own, times[own] > 1)], minlength=len(texts))
    rows = [_signs(t) if filled else (0,) * 6 for t, filled in zip(to_bytes(texts), n > 0, strict=True)]
    chars, symbols, lines, upper, lower, marks = np.array(rows, np.int64).T
    return np.stack([n, chars, symbols, lines, repeated, upper, lower, marks, top, distinct], 1)


def _covered(place: np.ndarray, own: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether a word lies in a 3-word window that its text has more than once; only windows of words that come ``again`` can be."""
    starts = np.flatnonzero((place[2:] == place[:-2]) & again[2:] & again[1:-1] & again[:-2])
    pair, _ = pd.factorize(own[starts] * len(own) + own[starts + 1])
    window, _ = pd.factorize(pair * len(own) + own[starts + 2])
    starts = starts[np.bincount(window)[window] > 1]
    covered = np.zeros(len(place), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return covered


def _signs(text: bytes) -> tuple[int, ...]:
    """What is counted by characters and lines."""
    filled = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(text) - _count(text, SPACES) - _count(text, CONTINUATION), _count(text, SYMBOLS), len(filled) - len(set(filled)),
        _count(text, UPPER), _count(text, LOWER), _count(text, MARKS),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id and the counts) of every row."""
    names = (*COUNTS, *SHAPES)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = statistics(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(names)))], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in names)])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def features(get) -> np.ndarray:
    """Rates that do not grow with a document's length, one column each; ``get`` gives a count by name."""
    n = np.maximum(get("n_words"), 1).astype(float)
    letters = np.maximum(get("n_upper") + get("n_lower"), 1)
    variety = np.log(np.maximum(get("n_distinct"), 1)) / np.log(n + 1)
    return np.stack([np.log(get("word_chars") / n + 1), get("n_symbols") / n, get("n_upper") / letters, get("n_marks") / n, get("top_word") / n, variety], 1)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: at (tree, node) the split feature or -1, its value, the first child and the path length of a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    length: np.ndarray
    usual: float

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row, tree by tree."""
        first, values = np.arange(len(x)) * x.shape[1], x.ravel()
        ends = self.feature < 0  # a leaf leads to itself
        nodes = zip(np.where(ends, 0, self.feature), np.where(ends, np.inf, self.value), np.where(ends, np.arange(ends.shape[1]), self.child), strict=True)
        for feature, value, child in nodes:
            at, before = np.zeros(len(x), np.int64), None
            while not np.array_equal(at, before):
                at, before = child.take(at) + (values.take(first + feature.take(at)) > value.take(at)), at
            yield at

    def score(self, x: np.ndarray) -> np.ndarray:
        """In (0, 1): 2 to the minus of the mean path length over the usual one."""
        total = np.zeros(len(x))
        for length, at in zip(self.length, self.leaves(x), strict=True):
            total += length[at]
        return np.exp2(-total / len(self.feature) / self.usual)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows, also between whole n."""
    big = np.maximum(n, 3)
    beyond = 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big
    return np.where(np.asarray(n) < 3, np.interp(n, [1, 2, 3], [0, 1, 2 * (np.log(2) + 0.5772156649) - 4 / 3]), beyond)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, is good) of about ``WALK_ROWS`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= WALK_ROWS:
            yield _numbers(held)
            held, n = [], 0
    if n:
        yield _numbers(held)


def _numbers(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    whole = pa.Table.from_batches(batches)
    return features(lambda c: whole.column(c).to_numpy()), whole.column("quality").to_numpy() == 1


def open_nodes(labelled: DataFrame, forest: Forest, slot: np.ndarray) -> pd.DataFrame:
    """(slot, n_good, n_low, lowest and highest value per feature) over all rows of every open node, by slot.

    ``slot`` numbers the open nodes at (tree, node); others have -1. Tasks send one row per node, not the rows in it.
    """
    n_open = int(slot.max()) + 1
    width = features(lambda c: np.zeros(1)).shape[1]
    lows, highs = ([f"{side}{i}" for i in range(width)] for side in ("low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.zeros((n_open, 2), np.int64)
        low, high = np.full((n_open, width), np.inf), np.full((n_open, width), -np.inf)
        for x, good in _pieces(batches):
            kind = np.stack([good, ~good], 1).astype(np.int64)
            for tree, at in enumerate(forest.leaves(x)):
                place = slot[tree, at]
                order = np.flatnonzero(place >= 0)
                if not len(order):
                    continue
                order = order[np.argsort(place[order], kind="stable")]
                place = place[order]
                starts = np.flatnonzero(np.diff(place, prepend=-1))
                own, values = place[starts], x[order]
                kinds[own] += np.add.reduceat(kind[order], starts)
                low[own] = np.minimum(low[own], np.minimum.reduceat(values, starts))
                high[own] = np.maximum(high[own], np.maximum.reduceat(values, starts))
        seen = np.flatnonzero(kinds.any(1))
        columns = [seen, *kinds[seen].T, *low[seen].T, *high[seen].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["slot", "n_good", "n_low", *lows, *highs])

    schema = ", ".join(["slot long, n_good long, n_low long", *(f"{c} double" for c in (*lows, *highs))])
    found = labelled.mapInArrow(run, schema).groupBy("slot")
    both = found.agg(*(F.sum(c).alias(c) for c in ("n_good", "n_low")), *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs))
    return both.toPandas().sort_values("slot", ignore_index=True)


def grow(labelled: DataFrame, n_good: int, n_low: int, seed: int = SEED) -> Forest:
    """A forest over all labelled rows; the low ones together weigh as few of the good ones."""
    rng = np.random.default_rng(seed)
    few = min(n_low, max(1, round(LOW_SHARE * n_good / (1 - LOW_SHARE))))
    size = min(TREE_ROWS, n_good + few)
    each = np.array([1.0, few / n_low]) * size / (n_good + few)
    deepest = int(np.ceil(np.log2(max(size, 2)))) + 4
    feature, value, child, length, slot = (np.full((TREES, 1), fill) for fill in (-1, 0.0, 0, 0.0, -1))
    used = np.ones(TREES, np.int64)
    trees, nodes = np.arange(TREES), np.zeros(TREES, np.int64)
    for depth in range(deepest + 1):
        slot[:] = -1
        slot[trees, nodes] = np.arange(len(trees))
        found = open_nodes(labelled, Forest(feature, value, child, length, 1.0), slot)
        trees, nodes = trees[found["slot"]], nodes[found["slot"]]
        mass = found[["n_good", "n_low"]].to_numpy() @ each
        length[trees, nodes] = depth + _expected(mass)
        low, high = (found.filter(regex=f"^{side}\\d").to_numpy() for side in ("low", "high"))
        split = (mass > 1) & (high > low).any(1) if depth < deepest else np.zeros(len(mass), bool)
        if not split.any():
            break
        trees, nodes, low, high = trees[split], nodes[split], low[split], high[split]
        # any feature that differs, all alike likely; the highest value always goes right
        f = np.where(high > low, rng.random(low.shape), -1.0).argmax(1)
        low, high = (np.take_along_axis(side, f[:, None], 1)[:, 0] for side in (low, high))
        cut = np.minimum(low + rng.random(len(f)) * (high - low), np.nextafter(high, low))
        first = used[trees] + 2 * (np.arange(len(trees)) - np.searchsorted(trees, trees))
        used += 2 * np.bincount(trees, minlength=TREES)
        more = ((0, 0), (0, int(used.max()) - feature.shape[1]))
        feature, value, child, length, slot = (np.pad(a, more, constant_values=fill) for a, fill in ((feature, -1), (value, 0), (child, 0), (length, 0), (slot, -1)))
        feature[trees, nodes], value[trees, nodes], child[trees, nodes] = f, cut, first
        trees, nodes = np.repeat(trees, 2), (first[:, None] + np.arange(2)).ravel()
    return Forest(feature, value, child, length, usual=max(float(_expected(size)), 1.0))


def score_labelled(labelled: DataFrame, forest: Forest) -> DataFrame:
    """(score, good) of all labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, good in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), pa.array(good)], ["score", "good"])

    return labelled.mapInArrow(run, "score double, good boolean")


def calibrate(scored: DataFrame, n_good: int, n_low: int) -> float:
    """The cut of the best balance of caught low rows and lost good rows, over all of them; of equal ones the middle.

    Cuts lie half way between neighbouring scores; the balance is kept in whole numbers.
    """
    counted = scored.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("low"))
    beyond = running_sums(counted, "score", ("good", "low"))
    caught, lost = (F.lit(n) - F.col(f"{kind}_upto") for kind, n in (("low", n_low), ("good", n_good)))
    balanced = materialize(beyond.select("score", (caught * n_good - lost * (LOSS_WEIGHT * n_low)).alias("balance")), "balance")
    most = balanced.agg(F.max("balance")).first()[0]
    ends = balanced.where(F.col("balance") == most).agg(F.min("score"), F.max("score")).first()
    after = balanced.agg(*(F.min(F.when(F.col("score") > end, F.col("score"))) for end in ends)).first()
    low, high = ((end + (end if following is None else following)) / 2 for end, following in zip(ends, after, strict=True))
    return (low + high) / 2


@dataclass(frozen=True)
class Judge:
    """The fitted forest and its cut; without a forest only the outright rules decide."""

    forest: Forest | None
    cut: float

    def judge(self, get) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Outright failure, score (nan without a forest) and whether a document is kept; ``get`` gives a count by name."""
        n = get("n_words")
        failed = (n < MIN_WORDS) | (100 * get("n_repeat_words") > MAX_REPEAT_PERCENT * n)
        score = self.forest.score(features(get)) if self.forest else np.full(len(n), np.nan)
        return failed, score, ~failed & ~(score > self.cut)


def fit(stats: DataFrame, labels: DataFrame) -> Judge:
    """A judge from the statistics of all labelled rows that do not fail outright."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = stats.where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    labelled = materialize(passed.join(truth, "doc_id").select("quality", *COUNTS, *SHAPES), "labelled")
    n_good, n_low = labelled.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") != 1)).first()
    if not n_good or not n_low:
        return Judge(None, 0.0)
    forest = grow(labelled, n_good, n_low)
    return Judge(forest, calibrate(score_labelled(labelled, forest), n_good, n_low))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, score, kept) of every row of ``docs`` (doc_id, text)."""
    stats = materialize(rule_statistics(docs), "rule_statistics")
    judge = fit(stats, labels)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        failed, score, kept = judge.judge(lambda c: batch.column(c).to_numpy())
        columns = [batch.column("doc_id"), *(batch.column(c) for c in COUNTS), pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return per_batch(stats, work, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"]))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the texts are not shuffled."""
    judge = fit(materialize(rule_statistics(docs), "rule_statistics"), labels)
    place = docs.columns.index("text")
    names = (*COUNTS, *SHAPES)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = statistics(batch.column(place))
        return batch.filter(pa.array(judge.judge(lambda c: values[:, names.index(c)])[2]))

    return per_batch(docs, work, docs.schema)
