"""Mixing, shards, search and revisits, and the whole pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from fractions import Fraction

import check_queries
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skylattice.llm import ball_tree, kd_shards, mixing, revisits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mixing", "op3_ball_tree", "op7_revisits"])
def test_matches_sql(spark, name):
    ok, message, _ = check_queries.compare(spark, check_queries.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def fill(given, children):
    """Budgets by exact water-filling: exhausted children one after the other, the rest by weight."""
    out, open_ones, given = {}, dict(children), Fraction(given)
    while open_ones:
        weight = sum(w for _, w in open_ones.values())
        full = [n for n, (c, w) in open_ones.items() if c <= given * w / weight]
        if not full:
            return out | {n: given * w / weight for n, (_, w) in open_ones.items()}
        for n in full:
            out[n] = Fraction(open_ones[n][0])
        given -= sum(open_ones.pop(n)[0] for n in full)
    return out


def test_budgets_go_to_siblings_before_ancestors(spark, make_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src5", "odd", None])) for i in range(500)]
    weights = {"domain": {"d0": 3, "other": 2}, "lang": {"en": 4}}
    sizes = mixing.measured(make_docs(rows))
    got = {(r.domain, r.lang, r.source): (r.tokens, r.budget) for r in mixing.leaf_budgets(sizes, weights, 70, 1).collect()}
    total = sum(t for t, _ in got.values())
    capacity = lambda keep: sum(t for leaf, (t, _) in got.items() if keep(leaf))
    domains = fill(total * 70 // 100, {d: (capacity(lambda x, d=d: x[0] == d), weights["domain"].get(d, 1)) for d in {x[0] for x in got}})
    for d, budget in domains.items():
        langs = fill(budget, {g: (capacity(lambda x, d=d, g=g: x[:2] == (d, g)), weights["lang"].get(g, 1)) for g in {x[1] for x in got if x[0] == d}})
        for g, part in langs.items():
            for leaf, share in fill(part, {x: (got[x][0], 1) for x in got if x[:2] == (d, g)}).items():
                assert abs(got[leaf][1] - share) <= 3 and got[leaf][1] <= got[leaf][0]
    assert sum(b for _, b in got.values()) == total * 70 // 100


def test_mixture_spends_budgets_in_epochs(spark, make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), "en", "src0" if i < 20 else "src4") for i in range(200)]
    docs = make_docs(rows)
    sizes = mixing.measured(docs)
    budgets = {r.source: r for r in mixing.leaf_budgets(sizes, {}, 90, 3).collect()}
    taken = mixing.mixed(docs, {}, 90, 3)
    assert taken.columns == docs.columns
    times = Counter(r.doc_id for r in taken.collect())
    for source, budget in budgets.items():
        own = [(i, len(t.split())) for i, t, _, s in rows if s == source]
        spent = sum(n * times[i] for i, n in own)
        assert budget.budget - 30 < spent <= budget.budget
        assert {times[i] for i, _ in own} <= {budget.budget // budget.tokens, budget.budget // budget.tokens + 1}
    odd = make_docs(odd_rows)
    assert mixing.mixed(odd, {}, 100, 1).count() == len(odd_rows)
    assert mixing.mixed(make_docs([]), {}, 100, 1).collect() == []


def test_shards_have_equal_bytes_and_gapless_slots(make_docs, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 10)
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(200), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(2_000)]
    got = kd_shards.kd_shards(make_docs(rows), shards=24).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(24)) and max(size.values()) - min(size.values()) <= 600
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t) + 8, zlib.crc32(t.encode())) for i, t, *_ in rows}


def test_equal_rows_are_spread_over_the_shards(make_docs):
    for same in ([(None, "x" * 92)] * 240, [(7, "x" * 92)] * 240, [(None, "x" * 92)] * 120 + [(7, "y" * 92)] * 120):
        got = kd_shards.kd_shards(make_docs(same), shards=24).collect()
        assert Counter(r.shard for r in got) == {s: 10 for s in range(24)}
        assert len({(r.shard, r.slot) for r in got}) == 240 and {r.slot for r in got} == set(range(10))


def test_shards_of_odd_rows(make_docs, odd_rows):
    got = kd_shards.kd_shards(make_docs(odd_rows), shards=24).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.shard < 24 for r in got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 4} == {(8, 0)}
    assert kd_shards.kd_shards(make_docs([]), shards=24).collect() == []
    by_bytes = kd_shards.kd_shards(make_docs([(i, "x" * 92) for i in range(100)]), target_bytes=1_000)
    assert Counter(r.shard for r in by_bytes.collect()) == {s: 10 for s in range(10)}


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 60)
    monkeypatch.setattr(ball_tree, "QUERY_ROWS", 6)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=6).round(1) if i % 3 else np.full(6, 0.5)).tolist()) for i in range(300)]
    odd = [(300, None), (320, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (380, []), (None, [1.0] * 6), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (20, [0.5] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id long, embedding array<float>, label int, rank int")
    got = ball_tree.top_inner_products(ball_tree.whole_numbers(table, 64), every=20, k=20).collect()
    usable = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v in [*vectors, (400, [1.0, 2.0]), (401, [3.0, 1.0]), (20, [0.5] * 6)]]
    for q, vector in usable:
        if q % 20 == 0 and q != 20:
            scored = sorted((-int(vector @ w), i) for i, w in usable if i != q and len(w) == len(vector))[:20]
            assert [(r.rank, -r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(n + 1, s, i) for n, (s, i) in enumerate(scored)]
    assert ball_tree.top_inner_products(ball_tree.whole_numbers(table.limit(0), 64), 20, 20).collect() == []


RECORD = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>, payload_bytes long, match int"


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(revisits, "SLICE_ROWS", 3)
    rows = [
        (1, "http://www.a.example:80/x/?b=2&utm_source=q&a=1#top", 10, "response", '"v1"', None, {"content-type": "text/html", "age": "0"}, 5, 0),
        (2, "https://A.example/x?a=1&b=2", 20, "revisit", 'W/"v1"', None, {"content-type": "no", "age": "9", "etag": "n"}, None, 0),
        (3, "https://a.example/x?a=1&b=2", 500, "revisit", '"v2"', None, None, None, 0),
        (4, "https://a.example/x?a=1&b=2", 10, "revisit", '"v1"', None, {}, None, 0),
        (5, "https://a.example/y", 30, "response", None, "d1", None, None, 0), (6, "https://a.example/y/", 900, "revisit", '"t"', "d1", {"x": "1"}, None, 0),
        (7, "https://a.example/y/", 901, "revisit", None, None, {}, None, 0), (8, None, 5, "revisit", None, None, None, None, 0), (9, None, 1, "response", None, None, None, None, 0),
        (10, "https://a.example/z", None, "revisit", None, None, None, None, 0), (11, "https://a.example/y", 30, "response", None, "d2", None, 1, 0), (12, "http://a.example/y", 950, "other", None, None, None, None, 0),
    ]
    got = {r.record_id: (r.response_id, r.outcome, r.headers) for r in revisits.resolved(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {
        2: (1, "resolved", {"content-type": "text/html", "age": "9", "etag": "n"}), 3: (1, "changed", None), 4: (None, "no_response", None), 6: (11, "changed", None),
        7: (11, "no_validator", None), 8: (None, "no_response", None), 10: (None, "no_response", None),
    }
    assert revisits.resolved(spark.createDataFrame([], RECORD)).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, ids = docs.columns, [set(texts)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        if name != "byte_pairs":
            assert docs.columns == columns
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and len(ids[4]) < len(ids[3]) == len(ids[2])
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_mixing_takes_rows_without_id_one_by_one(spark, make_docs):
    equal = [(i if i < 200 else None, "a b c d", "en", "s0") for i in range(300)]
    for percent, want in ((30, 90), (50, 150), (80, 240), (100, 300)):
        assert mixing.mixed(make_docs(equal), {}, percent, 1).count() == want
    other = [(None, f"a b {i}", "en", "s0") for i in range(100)] + [(7, "x y z", "en", "s0")] * 50 + [(None, None, None, None)] * 20
    assert mixing.mixed(make_docs(other), {}, 50, 1).where("text IS NOT NULL").count() == 75
    got = Counter(r.text for r in mixing.mixed(make_docs(equal[:10]), {}, 150, 2).collect())
    assert got == {"a b c d": 15}


def test_repeated_ids_have_one_order(spark, make_docs):
    import public_tokenizers

    from skylattice.llm.token_files import token_files

    rows = [(5, t, "en", "s0") for t in ("one two", "three", "four five six", "three")] + [(None, t, "en", "s0") for t in ("seven", "eight nine")]
    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = (sorted(map(tuple, token_files(make_docs(r).repartition(n), path).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert a == b
