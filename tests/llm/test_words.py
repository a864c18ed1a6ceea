"""Benchmark passages, ranked search and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import check_queries
import pytest

import __spark_entry__ as entry
from skylattice.llm import decontamination, lexical_search, spelling_variants

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_aho_corasick", "op12_lemp", "op13_part_enum"])
def test_matches_sql(spark, name):
    ok, message, _ = check_queries.compare(spark, check_queries.connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_hits(text, items, size):
    windows = {}
    for item, item_text in items:
        w = words(item_text)
        n = min(size, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(w[at : at + n]), set()).add(str(item))
    own, marked, names = words(text), set(), set()
    for n, of_n in windows.items():
        for p in range(len(own) - n + 1):
            if tuple(own[p : p + n]) in of_n:
                marked |= set(range(p, p + n))
                names |= of_n[tuple(own[p : p + n])] - {"None"}
    return len(own), marked, sorted(names)


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "Größe", "ñandú", "x1", "42", "İx", "日本", "the", "of"]
    made = [(100 + i, "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "--", "\x00", " 😀 "]) for _ in range(rng.randrange(60)))) for i in range(60)]
    return odd_rows + made + made[:3]


@pytest.fixture(scope="module")
def bench(spark, rows):
    cut = [r[1][5:90] for r in rows[-40:-20]]
    items = [(i, t) for i, t in enumerate(cut)] + [(50, None), (51, ""), (52, "the"), (53, "THE of"), (None, "beta, beta"), (54, "ONE!"), (0, "x1 42"), (55, "!?"), (56, "nowhere to be found"), (54, "ONE!")]
    return items, spark.createDataFrame([(i, t, "d", 1) for i, t in items], "item_id long, text string, doc_id string, n_words int")


@pytest.mark.parametrize("part_bytes", [2 << 20, 4_000])
def test_passages_equal_brute_force(make_docs, rows, bench, monkeypatch, part_bytes):
    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    items, table = bench
    docs = make_docs(rows)
    got = decontamination.benchmark_passages(docs, table, ("doc_id", "text"), size=4).collect()
    assert len(got) == len(rows)
    for r in got:
        n, marked, names = plain_hits(r.text, items, 4)
        assert (r.found.n_words, list(r.found["items"])) == (n, names)
        assert sorted(i for s in r.found.spans for i in range(s.first_word, s.last_word + 1)) == sorted(marked)
        own = words(r.text)
        for s in r.found.spans:  # in the text as it was, and no two runs touch
            assert words(r.text[s.start : s.end]) == own[s.first_word : s.last_word + 1]
            assert s.first_word - 1 not in marked and s.last_word + 1 not in marked
    digest = decontamination.contamination(docs, table, size=4).collect()
    expected, clean_rows = Counter(), Counter()
    for r in rows:
        n, marked, names = plain_hits(r[1], items, 4)
        clean_rows[(r[0], r[1])] += not marked
        expected[(r[0], n, len(marked), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(marked))] += 1
    assert Counter(map(tuple, digest)) == expected
    clean = decontamination.decontaminated(docs, table, size=4)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == +clean_rows


def test_passages_of_empty_tables(make_docs, rows, bench):
    assert decontamination.contamination(make_docs([]), bench[1]).collect() == []
    assert not any(r.contaminated for r in decontamination.contamination(make_docs(rows), bench[1].limit(0)).collect())


def best_by_hand(rows, items, k):
    counted = [(i, r[0], Counter(words(r[1]))) for i, r in enumerate(rows) if words(r[1])]
    n_rows, total = len(counted), sum(sum(c.values()) for _, _, c in counted)
    df = Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for _, doc_id, c in counted:
            m = 10 + 90 * sum(c.values()) * n_rows // total
            score = sum(math.floor(1000 * math.log((2 * n_rows + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("bucket_rows", "part_terms"), [(4_096, 1 << 20), (5, 150)])
def test_search_equals_brute_force(make_docs, rows, bench, monkeypatch, bucket_rows, part_terms):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(lexical_search, "PART_TERMS", part_terms)
    items, table = bench
    copies = [(1000 + i, rows[-1][1] + " the of") for i in range(40)]
    got = lexical_search.best_documents(make_docs(rows + copies).repartition(3), table, k=7).collect()
    assert Counter(map(tuple, got)) == best_by_hand(rows + copies, items, 7)


def test_search_of_empty_tables(make_docs, rows, bench):
    assert lexical_search.best_documents(make_docs([]), bench[1]).collect() == []
    assert lexical_search.best_documents(make_docs([(1, None), (2, " ")]), bench[1]).collect() == []
    assert lexical_search.best_documents(make_docs(rows), bench[1].limit(0)).collect() == []


def test_buckets_are_skipped_and_lists_left_unread(monkeypatch):
    """Bounds that are reached keep a bucket or a document, bounds below the k-th score drop them."""
    import numpy as np
    import pyarrow as pa

    def bucket(vectors):
        lengths = [math.sqrt(sum(v * v for _, v in own)) for own in vectors]
        terms, values = [[t for t, _ in own] for own in vectors], [[v for _, v in own] for own in vectors]
        ids = pa.array(range(len(vectors)), pa.int64())
        return lexical_search.Bucket(pa.table([ids, ids, pa.array(lengths), pa.array(terms, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "row", "length", "terms", "impacts"]), 3)

    b = bucket([[(0, 30), (1, 40)], [(1, 50)], [(2, 10)], []])
    ones = np.ones(3, np.int64)
    assert b.survivors(np.arange(3), ones, 1).tolist() == [0, 1, 2]
    assert b.survivors(np.arange(3), ones, 50).tolist() == [0, 1]
    assert b.survivors(np.arange(3), ones, 70).tolist() == [0]
    assert b.survivors(np.arange(3), ones, 91).tolist() == []
    assert b.scores(np.array([0, 2, 3]), np.array([1, 2, 3])).tolist() == [110, 30, 0]
    read = []
    monkeypatch.setattr(lexical_search.Bucket, "survivors", lambda self, *a: read.append(a) or np.array([], np.int64))
    items = lexical_search.Items([7], [[0, 1, 2]], ones)
    for floor, searched in ((91, 0), (88, 0), (87, 1)):  # 50 x sqrt(3) is 86.6, and 1 is allowed for rounding
        items.floor[:] = floor
        read.clear()
        lexical_search.search_bucket(b, items, lexical_search.Best(items, 2), np.zeros(3, np.int64), np.sqrt(items.sums(ones)))
        assert len(read) == searched


def variants_by_hand(rows, every, least):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms = {}
    for w, n in kept.items():
        around = sorted((-kept[o], o) for o in kept if close(w, o))
        forms[w] = (len(around), around[0][1] if around and -around[0][0] >= 2 * n else None)
    out = set()
    for w, n in kept.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        form = forms[w][1]
        out.add((w, n, forms[w][0], form, kept[form] if form else None, root))
    return out


@pytest.mark.parametrize(("every", "held"), [(97, 100_000), (3, 7)])
def test_variants_equal_brute_force(make_docs, odd_rows, monkeypatch, every, held):
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", held)
    rng = random.Random(5)
    stems = ["planet", "plantes", "Größere", "aaaaa", "naïveté", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"]

    def changed(word):
        at = rng.randrange(len(word))
        letter = rng.choice("aeEzÿÀ×")
        return rng.choice([word, word, word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[::-1]])

    rows = odd_rows + [(200 + i % 150, " ".join(changed(changed(rng.choice(stems))) for _ in range(60)) + "1two2") for i in range(200)]
    got = spelling_variants.spelling_variants(make_docs(rows), every=every).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == variants_by_hand(rows, every, 3)
    assert any(r.form and r.root != r.form for r in got)
    assert spelling_variants.spelling_variants(make_docs([(1, None), (2, "")])).collect() == []
