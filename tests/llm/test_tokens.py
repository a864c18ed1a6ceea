from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skylattice.llm import byte_pairs, token_counts, token_files

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


def texts():
    rng = random.Random(1)
    pick = lambda alphabet, most: "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))
    out = [pick("ab e\n \t.,'sdX1é<|日İΣ́\xa0▁", 60) for _ in range(3_000)]
    out += [pick(["th", "er", "in", " ", "the", "an", "\n", ".", "ing"], 40) for _ in range(2_000)]
    out += ["".join(chr(c) for c in range(a, a + 50) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 50)]
    return [*out, "", " ", "aa" * 500, "x<|endoftext|>y  <|endoftext|> ", "a\r\nb", "it's I'LL don't", "foo\n \nbar ", "   lead", "tail   "]


def test_byte_pairs_equal_the_library():
    model, own = library(BYTE), byte_pairs.load(BYTE)
    for text in texts():
        ids = model.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert (own.listed(got), got.tolist()) == (",".join(map(str, ids)), ids), text
        assert own.decode(got) == model.decode(ids, skip_special_tokens=False) == text


def test_compatible_pairs_are_those_that_merging_keeps():
    model, own = library(BYTE), byte_pairs.load(BYTE)
    rng = random.Random(2)
    words = [i for i in range(256, 50_000) if own.raw[i].isalpha()]
    for _ in range(3_000):
        a, b = rng.choice(words), rng.choice(words)
        if own.raw[a] in own.of_bytes and own.raw[b] in own.of_bytes:
            ids = model.encode((own.raw[a] + own.raw[b]).decode(), add_special_tokens=False).ids
            assert own.keeps_apart(a, b) == (ids == [a, b])


def test_round_trips_of_odd_rows(make_docs, odd_rows):
    model = library(BYTE)
    got = sorted(map(tuple, byte_pairs.round_trips(make_docs(odd_rows), BYTE).collect()), key=str)
    want = []
    for doc, text, *_ in odd_rows:
        ids = model.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), text or ""))))
    assert got == sorted(want, key=str)
    assert byte_pairs.round_trips(make_docs([]), BYTE).collect() == []


def test_encoded_column(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = byte_pairs.encoded(docs, BYTE)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["token_ids", "n_tokens", "exact"]
    assert all(r.exact and len(r.token_ids) == r.n_tokens for r in got.collect())


def test_token_counts(make_docs, odd_rows, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    monkeypatch.setattr(token_counts, "PART_CHARS", 5)
    monkeypatch.setattr(token_counts, "CALL_BYTES", 300)
    some = texts()
    assert token_counts.counts(some, PIECE).tolist() == [len(model.encode(t)) for t in some]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(make_docs(odd_rows), PIECE).collect()}
    assert got == {(d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t, *_ in odd_rows}
    assert token_counts.token_counts(make_docs([]), PIECE).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 9, 70, 5_000, 60_000, 2**31, 2**60, 2**63):
        ids = rng.integers(0, top, n, dtype=np.uint64)
        ids[rng.random(n) < 0.02] = 2**64 - 1 if top > 2**60 else top
        file = token_files.TokenFile(token_files.file_bytes([None, 3], [n // 2, n - n // 2], ids))
        assert file.doc_ids == [None, 3] and (file.ids(0, n) == ids).all() and (file.ids(n // 3, n) == ids[n // 3 :]).all()


def test_words_equal_the_library():
    model, some = library(WORD), texts()
    got = token_files.encode_words([t.encode() for t in some], WORD)
    assert [g.tolist() for g in got] == [e.ids for e in model.encode_batch(some, add_special_tokens=False)]


def test_token_files(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 5_000)
    rows = [r for r in odd_rows if r[0] is not None and r[0] != 3]
    model = library(WORD)
    got = sorted(map(tuple, token_files.token_files(make_docs(rows), WORD).collect()))
    want, start = [], 0
    for doc, text, *_ in sorted(rows):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert len(token_files.token_files(make_docs(odd_rows), WORD).collect()) == len(odd_rows)
    assert token_files.token_files(make_docs([]), WORD).collect() == []
