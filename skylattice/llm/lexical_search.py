"""Exact ranked search of benchmark items over all documents, with buckets by vector length.

A document is a vector of impacts over the terms of the items; an item weighs its terms by their
rarity, and the score is the inner product. Both sides are scaled by the square root of the weight,
which leaves the product as it is and keeps frequent terms from stretching the vectors. Every
partition holds its vectors in the order of their length and cuts them into buckets. For an item

* a whole bucket goes where (its longest vector) x (the item's length) stays below the k-th score
  (Cauchy-Schwarz), or where the highest impact of each coordinate in the bucket does;
* inside, only the lists of as many coordinates are read as are needed to leave less than the k-th score
  for the others; documents go whose part so far, with the highest impacts of the other coordinates or with the
  length that is left of both vectors, stays below it;
* survivors are scored again from their whole vectors in 64-bit integers.

The longest vectors of all partitions are searched first; their k-th score per item is where every
other bucket starts.

What tasks are sent follows the items, not the documents: items go in parts of at most
``PART_TERMS`` (item, term) pairs, one search of the written vectors each. Terms per document, document
counts and lengths are gathered over all rows.

Defined results: rows without terms are not counted and never found; an item without terms, or whose
terms occur nowhere, finds nothing. Repeated rows of a document or an item each count. Documents
without an id come last among equal scores. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import materialize, small_batches, to_bytes
from skylattice.llm.plain_words import plain_words

PART_TERMS = 1 << 20
BUCKET_ROWS = 4_096
FIRST_SHARE = 0.02  # of the vectors, the longest ones, are searched first
UNIT = 1_000_000_000
SLACK = 1 + 1e-9  # relative rounding of lengths; scores themselves are whole numbers


def _lists(values: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def term_vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a row, and how often those that the items name occur; rows without terms go."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, lengths, sizes, places, times = [], [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                words = plain_words(raw)
                if words:
                    own = [(known[w], tf) for w, tf in Counter(words).items() if w in known]
                    ids.append(doc_id)
                    lengths.append(len(words))
                    sizes.append(len(own))
                    places += [p for p, _ in own]
                    times += [t for _, t in own]
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), _lists(np.array(places, np.int32), sizes, pa.int32()), _lists(np.array(times, np.int32), sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_counts(vectors: DataFrame, width: int) -> np.ndarray:
    """In how many rows each of the ``width`` terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=width)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["term", "df"])

    out = np.zeros(width, np.int64)
    for term, df in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[term] = df
    return out


def impacts(tf: np.ndarray, n: np.ndarray, rows: int, total: int) -> np.ndarray:
    """Impact of ``tf`` occurrences in a row of ``n`` terms, among ``rows`` rows of ``total`` terms, all rounded down."""
    m = 10 + (90 * n * rows) // total
    return (UNIT * tf) // (1_000 * tf + 8 * m)


def impact_vectors(vectors: DataFrame, rows: int, total: int, weights: np.ndarray) -> DataFrame:
    """(doc_id, row, length, terms, impacts), in the order of length within each partition."""
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(2).flatten().to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            value = impacts(tf, batch.column(1).to_numpy()[owner], rows, total)
            square = np.bincount(owner, weights=shared.value[terms] * value.astype(float) ** 2, minlength=batch.num_rows)
            columns = [batch.column(0), pa.array(np.sqrt(square)), _lists(terms, sizes, pa.int32()), _lists(value.astype(np.int32), sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "terms", "impacts"])

    sized = vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, "doc_id long, length double, terms array<int>, impacts array<int>")
    return sized.where("length > 0").withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions(F.desc("length"))


class Items:
    """The items of one part: the terms of item i are ``terms[starts[i]:starts[i + 1]]``."""

    def __init__(self, numbers: list[int], lists: list[list[int]], weights: np.ndarray) -> None:
        self.numbers = np.array(numbers, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in lists])]).astype(np.int64)
        self.terms = np.array([t for own in lists for t in own], np.int64)
        self.weights = weights
        self.floor = np.ones(len(numbers), np.int64)  # scores below do not matter

    def of(self, i: int) -> np.ndarray:
        return self.terms[self.starts[i] : self.starts[i + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per item of a value per term."""
        upto = np.concatenate([[0], np.cumsum(values[self.terms])])
        return upto[self.starts[1:]] - upto[self.starts[:-1]]


class Bucket:
    """Vectors of similar length, by row and by coordinate."""

    def __init__(self, batch: pa.Table, width: int) -> None:
        column = {name: batch.column(name).combine_chunks() for name in batch.schema.names}
        self.rows = batch.num_rows
        self.doc_id = np.asarray(column["doc_id"].fill_null(np.iinfo(np.int64).max))
        self.no_id = np.asarray(column["doc_id"].is_null())
        self.row = np.asarray(column["row"])
        self.length = np.asarray(column["length"])
        self.terms = column["terms"].flatten().to_numpy()
        self.impacts = column["impacts"].flatten().to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.diff(column["terms"].offsets.to_numpy()))])
        order = np.argsort(self.terms, kind="stable")
        self.docs = np.repeat(np.arange(self.rows), np.diff(self.starts))[order]
        self.by_term = self.impacts[order]
        self.lists = np.searchsorted(self.terms[order], np.arange(width + 1))
        self.highest = np.zeros(width, np.int64)
        used = np.flatnonzero(np.diff(self.lists))
        self.highest[used] = np.maximum.reduceat(self.by_term, self.lists[used]) if len(used) else 0

    def survivors(self, terms: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Documents that may reach ``least`` for an item."""
        most = weights * self.highest[terms]
        order = np.argsort(-most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        left = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the coordinates from here on can add
        read = int(np.argmax(left < least))
        part, square = np.zeros(self.rows, np.int64), np.zeros(self.rows)
        for term, weight in zip(terms[:read].tolist(), weights[:read].tolist(), strict=True):
            own = slice(self.lists[term], self.lists[term + 1])
            docs, values = self.docs[own], self.by_term[own]
            part[docs] += weight * values
            square[docs] += weight * values.astype(float) ** 2
        some = np.flatnonzero(part)
        some = some[part[some] + left[read] >= least]
        rest = np.sqrt(np.maximum(self.length[some] ** 2 * SLACK - square[some], 0)) * math.sqrt(weights[read:].sum())
        return some[(part[some] + rest) * SLACK + 1 >= least]

    def scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores from whole vectors; ``weight_of`` is 0 for terms that the item lacks."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        upto = np.concatenate([[0], np.cumsum(weight_of[self.terms[at]] * self.impacts[at])])
        return upto[ends] - upto[ends - sizes]


class Best:
    """The k best of every item: (score, without id, id, row), in that order."""

    def __init__(self, items: Items, k: int) -> None:
        self.k, self.found, self.least = k, {}, items.floor.copy()

    def offer(self, i: int, score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray, row: np.ndarray) -> None:
        if i in self.found:
            score, no_id, doc_id, row = (np.concatenate(pair) for pair in zip(self.found[i], (score, no_id, doc_id, row), strict=True))
        order = np.lexsort((row, doc_id, no_id, -score))[: self.k]
        self.found[i] = (score[order], no_id[order], doc_id[order], row[order])
        if len(order) == self.k:
            self.least[i] = max(self.least[i], int(score[order[-1]]))


def search_bucket(bucket: Bucket, items: Items, best: Best, weight_of: np.ndarray, lengths: np.ndarray) -> None:
    """Offers to ``best`` all documents of a bucket that may belong to it."""
    go = lengths * bucket.length.max() * SLACK + 1 >= best.least
    go &= items.sums(items.weights * bucket.highest) >= best.least
    for i in np.flatnonzero(go).tolist():
        terms = items.of(i)
        docs = bucket.survivors(terms, items.weights[terms], int(best.least[i]))
        if not len(docs):
            continue
        weight_of[terms] = items.weights[terms]
        score = bucket.scores(docs, weight_of)
        weight_of[terms] = 0
        docs, score = docs[score >= best.least[i]], score[score >= best.least[i]]
        if len(docs):
            best.offer(i, score, bucket.no_id[docs], bucket.doc_id[docs], bucket.row[docs])


FOUND = "item int, doc_id long, row long, score long"


def searcher(shared: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches one partition's buckets, longest vectors first, for all items of a part."""
    bucket_rows = BUCKET_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best, weight_of, lengths = Best(items, k), np.zeros(len(items.weights), np.int64), np.sqrt(items.sums(items.weights))
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= bucket_rows:
                search_bucket(Bucket(pa.Table.from_batches(waiting), len(weight_of)), items, best, weight_of, lengths)
                waiting = []
        waiting = [b for b in waiting if b.num_rows]
        if waiting:
            search_bucket(Bucket(pa.Table.from_batches(waiting), len(weight_of)), items, best, weight_of, lengths)
        for i, (score, no_id, doc_id, row) in best.found.items():
            number = np.full(len(score), items.numbers[i], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc_id, mask=no_id), pa.array(row), pa.array(score)], ["item", "doc_id", "row", "score"])

    return run


def item_parts(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item number, its distinct terms in order) of all items, in parts of at most ``PART_TERMS`` terms."""
    part: list[tuple[int, list[bytes]]] = []
    size = 0
    for number, text in items.select("item", "text").toLocalIterator():
        terms = sorted(set(plain_words(text.encode() if text else None)))
        if terms:
            if part and size + len(terms) > PART_TERMS:
                yield part
                part, size = [], 0
            part.append((number, terms))
            size += len(terms)
    if part:
        yield part


def search_part(docs: DataFrame, part: list[tuple[int, list[bytes]]], k: int) -> DataFrame | None:
    """(item, doc_id, row, score): at least the ``k`` best rows of ``docs`` per item, at most ``k`` per partition."""
    terms = {t: i for i, t in enumerate(sorted({t for _, own in part for t in own}))}
    vectors = materialize(term_vectors(docs, terms), "vectors")
    rows, total = vectors.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return None
    df = document_counts(vectors, len(terms))
    weights = np.array([math.floor(1_000 * math.log((2 * rows + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    ordered = materialize(impact_vectors(vectors, rows, total, weights), "impacts")
    items = Items([number for number, _ in part], [[terms[t] for t in own] for _, own in part], weights)
    sc = docs.sparkSession.sparkContext
    cut = ordered.agg(F.percentile_approx("length", 1 - FIRST_SHARE, 10_000)).first()[0]
    if cut is None:
        return None
    columns = ["doc_id", "row", "length", "terms", "impacts"]
    first = ordered.where(F.col("length") >= cut).select(columns).mapInArrow(searcher(sc.broadcast(items), k), FOUND)
    place = {number: i for i, number in enumerate(items.numbers.tolist())}
    for number, least in ranked(first, k).groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).where("least IS NOT NULL").collect():
        items.floor[place[number]] = max(1, least)
    return ordered.select(columns).mapInArrow(searcher(sc.broadcast(items), k), FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    numbered = materialize(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    found = None
    for part in item_parts(numbered):
        # numbers of items are long; inside a part they are its positions
        own = search_part(docs, [(i, terms) for i, (_, terms) in enumerate(part)], k)
        if own is not None:
            names = docs.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(part)], "item int, number long")
            best = materialize(ranked(own, k).join(names, "item").select("number", "rank", "doc_id", "score"), "best")
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "number long, rank int, doc_id long, score long")
    return found.join(numbered.select("item_id", F.col("item").alias("number")), "number").select("item_id", "rank", "doc_id", "score")
