from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, size string, domain string, epoch int, key string, text_hash long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or ""), 7, "s", "mine", 9, "k", 3) for r in rows]
        return spark.createDataFrame(full, DOC)

    return build


BASE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeats, text of several scripts."""
    return [
        (1, BASE), (2, BASE), (3, BASE + " more"), (3, BASE + " more"), (4, None), (5, ""), (6, " \n\t "), (None, BASE), (None, None), (7, "one"), (8, "one"), (9, "one two"),
        (10, "x" * 300_000), (11, "a b " * 60_000), (12, "Größe 日本語 😀 naïve\x85next\xa0word İstanbul"), (13, "mail bob.1@mail.example.com ip 10.2.3.4 call +1 (017) 555-7713, card 4111111111111111"),
        (14, "a  b   c \n\n d\t<|endoftext|> e "), (15, BASE.upper(), None, None), (-3, "ONE"),
    ]
