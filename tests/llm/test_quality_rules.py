from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.llm import common
from skylattice.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_match_brute_force(odd_rows):
    rng = random.Random(3)
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 5_000]
    texts += ["".join(rng.choice("ab \n#é\t\x85") for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in texts:
        assert q.statistics_of(text.encode() if text is not None else None)[:5] == brute(text), text


@pytest.mark.parametrize("kind, most", [(pa.string(), 1_000_000), (pa.large_string(), 60)])
def test_a_column_is_counted_text_by_text(odd_rows, monkeypatch, kind, most):
    """Texts share their words and are counted at once; no window may cross from one to the next."""
    monkeypatch.setattr(common, "PIECE_BYTES", most)
    rng = random.Random(4)
    texts = [r[1] for r in odd_rows if len(r[1] or "") < 5_000] + ["a b c", "a b c", "a b c a b", "c a b c"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = q.statistics(pa.array(["a b c", *texts], kind)[1:])
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [tuple(r[:5]) for r in rows] == [brute(t) for t in texts]
    assert [tuple(r[-2:]) for r in rows] == [(max(map(w.count, w), default=0), len(set(w))) for w in split]


def test_every_row_goes_down_to_its_leaf():
    rng = np.random.default_rng(5)
    feature, child = np.array([[0, 1, -1, -1, 1, -1, -1], [-1] * 7]), np.array([[1, 3, 0, 0, 5, 0, 0], [0] * 7])
    feature[0, 2] = 1
    child[0, 2] = 5
    forest = q.Forest(feature, rng.random((2, 7)), child, np.zeros((2, 7)), 1.0)
    x = np.concatenate([rng.random((200, 2)), [[np.inf, np.inf], [-np.inf, np.nan]]])

    def leaf(row):
        at = 0
        while feature[0, at] >= 0:
            at = child[0, at] + int(row[feature[0, at]] > forest.value[0, at])
        return at

    first, second = forest.leaves(x)
    assert first.tolist() == [leaf(row) for row in x] and len(set(first)) == 3 and not second.any()


@pytest.fixture(scope="module")
def corpus(make_docs, spark):
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice(["the", "river", "stone", "walks", "under", "light", "of", "a", f"name{rng.randrange(900)}"]) for _ in range(150))
    loud = lambda: " ".join(f"{w.upper()}!!" for w in plain().split())
    rows = [(i, plain()) for i in range(300)] + [(1000 + i, loud()) for i in range(60)]
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (3, None, 1)]
    return make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(corpus):
    docs, labels = corpus
    kept = {r.doc_id: r.kept for r in q.quality_verdicts(docs, labels).collect()}
    assert np.mean([kept[i] for i in range(1, 300, 2)]) > 0.95
    assert np.mean([kept[1000 + i] for i in range(1, 60, 2)]) < 0.05


def test_filter_agrees_with_verdicts(corpus):
    docs, labels = corpus
    kept = {r.doc_id for r in q.quality_verdicts(docs, labels).where("kept").collect()}
    got = q.good_documents(docs, labels)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept


def test_odd_rows_and_no_labels(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = q.quality_verdicts(make_docs(odd_rows), none).collect()
    assert len(rows) == len(odd_rows) and all(r.kept == (not r.base_failed) and r.score is None for r in rows)
    assert all(r.base_failed for r in rows if r.doc_id in (4, 5, 6, 7, 11))
    assert q.quality_verdicts(make_docs([]), none).collect() == []


def narrow(spark, n, low_if):
    """Statistics of ``n`` invented documents and their labels; those of low quality are all capitals."""
    low, docs = F.expr(low_if), spark.range(n).withColumn("doc_id", F.col("id"))
    stats = docs.select(
        "doc_id", F.lit(200).alias("n_words"), (F.lit(900) + F.col("doc_id") % 97).alias("word_chars"), (F.col("doc_id") % 3).alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"),
        F.when(low, 880).otherwise(F.col("doc_id") % 41).alias("n_upper"), F.when(low, 0).otherwise(850).alias("n_lower"), (F.col("doc_id") % 7).alias("n_marks"), (F.col("doc_id") % 13 + 4).alias("top_word"), (F.col("doc_id") % 29 + 90).alias("n_distinct"),
    )
    names = [c for c in stats.columns if c != "doc_id"]
    return stats.select("doc_id", *[F.col(c).cast("long") for c in names]), docs.select("doc_id", F.when(low, 0).otherwise(1).alias("quality"))


def judged(judge, stats):
    rows = stats.orderBy("doc_id").toPandas()
    return judge.judge(lambda c: rows[c].to_numpy())


def test_every_labelled_row_counts(spark):
    """One low row among 12,000, the one with the highest hash: no part of the rows may stand for all."""
    last = spark.range(12_000).orderBy(F.desc(F.pmod(F.xxhash64("id"), F.lit(1 << 30)))).first().id
    stats, labels = narrow(spark, 12_000, f"id = {last}")
    judge = q.fit(stats, labels)
    _, score, kept = judged(judge, stats)
    assert judge.forest is not None and score.argmax() == last and not kept[last] and kept.mean() > 0.999
    again = q.fit(stats.repartition(5), labels.repartition(3))
    assert again.cut == judge.cut and np.array_equal(again.forest.length, judge.forest.length) and np.array_equal(again.forest.value, judge.forest.value)


def test_leaves_hold_all_rows(spark):
    stats, labels = narrow(spark, 3_000, "id % 10 = 0")
    judge = q.fit(stats, labels)
    rows = stats.orderBy("doc_id").toPandas()
    x, good = q.features(lambda c: rows[c].to_numpy()), np.arange(3_000) % 10 != 0
    weight = np.where(good, 1.0, round(0.02 * 2_700 / 0.98) / 300)
    weight *= q.TREE_ROWS / weight.sum()
    for tree, at in enumerate(judge.forest.leaves(x)):
        depth = np.zeros(judge.forest.feature.shape[1])
        for node in np.flatnonzero(judge.forest.feature[tree] >= 0):
            child = judge.forest.child[tree, node]
            depth[child : child + 2] = depth[node] + 1
        mass = np.bincount(at, weight, len(depth))
        assert np.allclose(judge.forest.length[tree][mass > 0], (depth + q._expected(mass))[mass > 0])
    score = judge.forest.score(x)
    assert judge.cut == pytest.approx(best_cut(score, good))


def best_cut(scores, good):
    values = sorted(set(scores))
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])] + [values[-1]]
    balance = [int((scores[~good] > c).sum()) * int(good.sum()) - 5 * int((scores[good] > c).sum()) * int((~good).sum()) for c in cuts]
    best = [c for c, b in zip(cuts, balance) if b == max(balance)]
    return (best[0] + best[-1]) / 2


@pytest.mark.parametrize("seed", range(3))
def test_cut_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    scores, good = rng.integers(0, 30, 400) / 32, rng.random(400) < 0.6
    scores[~good] = np.minimum(scores[~good] + rng.integers(0, 2) / 4, 1)
    scored = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "score double, good boolean")
    assert q.calibrate(scored, int(good.sum()), int((~good).sum())) == pytest.approx(best_cut(scores, good))
