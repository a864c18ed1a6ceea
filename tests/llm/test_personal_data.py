from __future__ import annotations

import hashlib
import random
import re

import pytest

from skylattice.llm import personal_data as p

PATTERNS = (  # as the contract states them
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns(odd_rows):
    rng = random.Random(3)
    texts = [r[1] or "" for r in odd_rows if len(r[1] or "") < 5_000] + ["".join(rng.choice("0123456789.. @+-(a )%") for _ in range(50)) for _ in range(5_000)]
    for text in texts:
        assert p.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 50_000, "a@" * 50_000):
        p.base_spans(text)


@pytest.fixture(scope="module")
def corpus(make_docs):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        words = [rng.choice(["river", "stone", "light", "walk", "the", "of"]) for _ in range(40)]
        digits = "".join(str(rng.randrange(10)) for _ in range(15))
        card = next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
        words[5] = f"name.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        words[12] = ".".join(str(rng.randrange(256)) for _ in range(4))
        words[20] = card
        words[28] = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        words[35] = f"Version {rng.randrange(9)}.{rng.randrange(9)}"
        rows.append((1_000 + i, " ".join(words)))
    return make_docs(rows)


def test_the_field_adds_spans_and_leaves_plain_numbers_alone(corpus):
    weights = p.fit(corpus)
    found = lambda t: [(t[a:b], p.KINDS[k]) for a, k, b in p.all_spans(t, weights)[1]]
    assert found("please call (017) 555-7713 about the stone") == [("(017) 555-7713", "phone")]
    assert found("the card 4111.1111.1111.1111 of the river") == [("4111.1111.1111.1111", "card")]
    assert found("walk to bob.smith (at) example.com by the light") == [("bob.smith (at) example.com", "email")]
    for clean in ("Version 2.0.1 of 2021 with 3 parts", "the Apache License, Version 2.0.", "room 555-77 at 12:30", "in 2021-05-06 the stone", "4111111111111112 is no card"):
        assert found(clean) == [], clean


def test_query_columns(corpus, make_docs, odd_rows):
    rows = p.personal_data(corpus.unionByName(make_docs(odd_rows))).collect()
    assert len(rows) == 200 + len(odd_rows)
    by_id = {r.doc_id: r for r in rows}
    text = next(t for d, t, *_ in odd_rows if d == 13)
    listed = ",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in brute(text))
    row = by_id[13]
    assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert by_id[4].spans == "" and by_id[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert p.personal_data(make_docs([])).collect() == []


def test_redaction(corpus, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (50, "write a@b.example now")]).unionByName(corpus)
    got = {r.doc_id: r for r in p.redact(docs).collect()}
    assert got[50].text == "write <EMAIL> now" and got[4].text is None and got[5].text == "" and p.redact(docs).columns == docs.columns
    assert p.redacted("xx12345yy", [(2, 0, 5), (3, 1, 7)]) == "xx<EMAIL>yy"
