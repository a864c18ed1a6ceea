from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from skylattice.llm import common
from skylattice.llm import near_duplicates as nd


def brute(rows, k):
    """Component of every row by comparing all pairs of distinct sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and sets[j] and 100 * inter >= 80 * (len(a) + len(sets[j]) - inter):
                group[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        if not sets[i]:
            out.append((doc, 0, doc, doc is not None))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc is not None and doc == least))
    return out


def order(rows):
    return sorted(rows, key=str)


def perturbed(rng, words, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("kind, most", [(pa.string(), 2_000_000), (pa.large_string(), 50)])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles_of_a_column_equal_those_of_each_text(odd_rows, monkeypatch, k, kind, most):
    """A column is cut into words at once; no shingle may cross from one text to the next."""
    monkeypatch.setattr(common, "PIECE_BYTES", most)
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows] + ["".join(rng.choice("ab \n\t\x0bé\x85") for _ in range(rng.randrange(40))) for _ in range(300)]

    def one_by_one(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
        width = min(k, len(h))
        out = np.full(max(1, len(h) - k + 1) if h else 0, width, np.uint64)
        for i in range(width):
            out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + np.array(h[i : i + len(out)], np.uint64))
        return np.unique(out)

    got = nd.shingles(pa.array(["cut off", *texts], kind)[1:], k)
    assert len(got) == len(texts) and all(np.array_equal(a, one_by_one(t)) for a, t in zip(got, texts))


@pytest.mark.parametrize("k", [2, 5])
def test_odd_rows(spark, make_docs, odd_rows, k):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = [tuple(r) for r in nd.near_duplicates(make_docs(odd_rows), k, 80).collect()]
    assert order(got) == order(brute(rows, k))


def test_empty_table(spark, make_docs):
    assert nd.near_duplicates(make_docs([]), 2, 80).collect() == []


@pytest.mark.parametrize("chunk", [4, 256])
def test_families_of_many_chunks(spark, make_docs, monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    monkeypatch.setattr(nd, "HUBS", 3)
    rng = random.Random(5)
    rows = []
    for family in range(5):
        words = [f"f{family}w{i}" for i in range(60)]
        rows += [(len(rows) + j, perturbed(rng, words, rng.choice([0.0, 0.03, 0.06, 0.12, 0.2]))) for j in range(30)]
    got = [tuple(r) for r in nd.near_duplicates(make_docs(rows), 2, 80).collect()]
    assert order(got) == order(brute(rows, 2))


@pytest.mark.parametrize("chunk", [4, 256])
def test_rows_without_id_take_part_in_the_links(spark, make_docs, monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    monkeypatch.setattr(nd, "HUBS", 3)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(100)]
    # the row without an id is the only link of 1 and 2; 3 and its row without an id are near; two without an id stand alone
    rows = [(1, " ".join(words[:90])), (None, " ".join(words[:100])), (2, " ".join(words[10:100]))]
    other = [f"o{i}" for i in range(80)]
    rows += [(3, " ".join(other)), (None, " ".join(other[:76])), (None, " ".join(other[:76]))]
    alone = [f"a{i}" for i in range(80)]
    rows += [(None, " ".join(alone)), (None, " ".join(alone[:76])), (2**62 + 5, "far off"), (-9, "below all")]
    rows += [(2**62 + 6 + i, " ".join(words[:90])) for i in range(6)]  # copies of 1, above every set's smallest id
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        rows += [(None if rng.random() < 0.5 else 100 + len(rows) + j, perturbed(rng, base, rng.choice([0.0, 0.03, 0.06, 0.12]))) for j in range(20)]
    got = [tuple(r) for r in nd.near_duplicates(make_docs(rows), 2, 80).collect()]
    assert order(got) == order(brute(rows, 2))
    assert (None, 99, 1, False) in got and (2, 89, 1, False) in got


def test_one_of_each_keeps_one_row_of_a_group_without_ids(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"o{i}" for i in range(100))
    rows = [(None, text)] * 4 + [(None, text + " end"), (None, other), (3, other + " end"), (None, "  "), (None, None), (None, "single words")]
    got = sorted((str(r.doc_id), str(r.text)) for r in nd.one_of_each(make_docs(rows), 5, 80).collect())
    group = [g for g in got if g[1] in (text, text + " end")]
    assert len(group) == 1 and sorted(g for g in got if g not in group) == sorted([("3", other + " end"), ("None", "  "), ("None", "None"), ("None", "single words")])
    assert nd.one_of_each(make_docs([]), 5, 80).collect() == []


def test_one_of_each_keeps_columns_and_rows_without_id(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = nd.one_of_each(docs, 5, 80)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 1 and ids.count(1) == 1 and not {2, 3, 7, 8, 15} & set(ids) and {-3, 4, 5, 6, 9, 10, 11, 12, 13, 14} <= set(ids)


@pytest.mark.parametrize("most, join", [(10, "BroadcastHashJoin"), (1, "SortMergeJoin")])
def test_texts_of_few_candidates_are_read_without_a_shuffle(spark, make_docs, monkeypatch, most, join):
    monkeypatch.setattr(nd, "BROADCAST_NODES", most)
    placed = spark.createDataFrame([(2, 1), (1, 1)], "node long, family long")
    texts = nd.candidate_texts(make_docs([(i, f"t{i}") for i in range(9)]), placed)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert join in plan and ("hashpartitioning" in plan) == (join == "SortMergeJoin")
    assert sorted(tuple(r) for r in texts.collect()) == [("t1", 1, 1), ("t2", 2, 1)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    left, right = np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))
    regs = nd.registers([left, right, np.unique(np.concatenate([left, right]))])
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    n = np.array([float(len(left))])
    assert nd.plausible(regs[:1], regs[1:2], n, n, 80).all()
    other = nd.registers([rng.integers(0, 2**63, 900, dtype=np.uint64)])
    assert not nd.plausible(regs[:1], other, n, n, 80).any()


def test_no_pair_at_the_threshold_is_ruled_out():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(300):
        shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (80, 10, 10))
        sets += [np.unique(np.concatenate([shared, a])), np.unique(np.concatenate([shared, b]))]
    regs = nd.registers(sets)
    n = np.full(300, 90.0)
    assert nd.plausible(regs[::2], regs[1::2], n, n, 80).all()
    bands = (regs[::2].reshape(300, nd.BANDS, nd.ROWS) == regs[1::2].reshape(300, nd.BANDS, nd.ROWS)).all(2).any(1)
    assert bands.all()
