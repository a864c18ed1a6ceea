"""Spelling variants of words, by PartEnum signatures over letter multisets.

Words that differ by one inserted, deleted or replaced letter have letter multisets that differ in at most
two places, if a multiset is read as the binary vector of (letter, how many-th of it). The letters are dealt
into ``PARTS`` parts. A replaced letter changes at most two parts, so one of the choices of
``PARTS - 2`` parts is the same in both words; an inserted or deleted letter changes one part, so one of the
choices of ``PARTS - 1`` parts is. A signature is such a choice with the letters in it. It also holds
the length (of the shorter word) and one half of the spelling, since a single change leaves the other half as it
is: that keeps signatures rare where words are short or their letters common. Equal signatures
are joined, and every pair is verified by its edit distance.

Occurrences are counted in the tasks first, so a frequent word costs one row per flush; signatures are made
once per distinct word.

Defined results: null and empty texts have no words; a document without an id has the empty string in place of it;
repeated rows count as often as they occur; words without near words keep null forms and are
their own roots.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import materialize, small_batches, to_bytes

PARTS = 4  # fewer parts give fewer signatures (28 a word), more parts rarer ones
LEAST_LETTERS = 5
LEAST_COUNT = 3
MISPRINT_EVERY = 97
HELD_WORDS = 100_000  # distinct words a task holds before it passes their counts on

#: The letters A-Z in lower case; other characters stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALPHABET = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, every: int = MISPRINT_EVERY) -> DataFrame:
    """(word, n): runs of letters of at least ``least_letters`` with their occurrences, over all rows of ``docs`` (doc_id, text).

    Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses one letter first, as a misprint would.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_letters},}}")
    most_held = HELD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), to_bytes(batch.column(1)), strict=True):
                if not raw:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(raw.translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= most_held:
                    yield flush()
        if held:
            yield flush()

    rows = small_batches(docs.select("doc_id", "text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts() -> list[Column]:
    """The sorted letters of each part of the word in column ``letters``."""
    return [F.regexp_replace("letters", f"[^{''.join(_ALPHABET[p::PARTS])}]", "") for p in range(PARTS)]


def signatures(words: DataFrame) -> DataFrame:
    """(signature, role, word, n) of ``words`` (word, n). Role 0 meets its like, role 1 (the shorter word) meets role 2."""
    letters = F.array_join(F.array_sort(F.filter(F.split("word", ""), lambda c: c != "")), "")
    parted = words.withColumn("letters", letters).select("word", "n", F.char_length("word").alias("size"), *[c.alias(f"p{i}") for i, c in enumerate(_parts())])

    def rows(role: int, dropped: int, size: Column) -> list[Column]:
        head = F.floor(size / 2).cast("int")
        tail = size - head
        halves = [F.substring("word", F.lit(1), head), F.expr("word").substr(F.char_length("word") - tail + 1, tail)]
        out = []
        for choice in combinations(range(PARTS), PARTS - dropped):
            for side, half in enumerate(halves):
                key = F.xxhash64(F.lit(dropped), size, F.lit(side), half, F.lit(",".join(map(str, choice))), *[F.col(f"p{i}") for i in choice])
                out.append(F.struct(key.alias("signature"), F.lit(role).cast("byte").alias("role")))
        return out

    made = [*rows(0, 2, F.col("size")), *rows(1, 1, F.col("size")), *rows(2, 1, F.col("size") - 1)]
    return parted.select("word", "n", F.explode(F.array(*made)).alias("s")).select("s.signature", "s.role", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n) that are one inserted, deleted or replaced letter apart."""
    signed = materialize(signatures(words), "signatures")
    left = signed.select("signature", F.col("role").alias("a_role"), F.col("word").alias("a"), F.col("n").alias("a_n")).where("a_role <> 2")
    right = signed.select("signature", F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n")).where("b_role <> 1")
    # the join on equal signatures must not fall back to a hash table of all words of a frequent one
    met = left.hint("merge").join(right, "signature").where(F.when(F.col("a_role") == 0, (F.col("b_role") == 0) & (F.col("a") < F.col("b"))).otherwise(F.col("b_role") == 2))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def followed(links: DataFrame) -> DataFrame:
    """(word, root): where the chain of (word, form) ends. Each round doubles the steps, so it runs as often as the
    longest chain has binary digits."""
    reached = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = materialize(reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, every: int = MISPRINT_EVERY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with at least ``least_count`` occurrences.

    The form is the most frequent near word, where that is at least twice as frequent; the root is where the forms lead.
    """
    words = materialize(word_counts(docs, least_letters, every).where(F.col("n") >= least_count), "words")
    pairs = materialize(near_pairs(words), "near_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    # the smallest of (-n, word): most frequent first, then in the order of code points
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left")
    leads = -F.col("best.minus") >= 2 * F.col("n")
    formed = materialize(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.form")).alias("form"), F.when(leads, -F.col("best.minus")).alias("form_n")), "forms"
    )
    roots = followed(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
