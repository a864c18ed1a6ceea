"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's bytes finds the tokens that begin at every place
of a word. The encoder takes the longest one that is compatible with the token before it, goes to
shorter ones where it is not, and steps back where none is left; places from which no encoding
continues are marked, so each is left at most once and the time is linear. Two neighbours are
compatible if no merge across their border comes before those inside them; the result is exactly
what applying the merges in rank order gives.

Words are cut as the vocabulary's own pattern cuts them. Encoded words are remembered per worker
in a cache of bounded size. Decoding gathers byte ranges of one blob by token offsets.

Defined results: null and empty texts have no tokens; special tokens inside a text are single
ids, as the vocabulary file declares; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType
from tokenizers.pre_tokenizers import ByteLevel

from skylattice.llm.common import BoundedCache, per_batch

CACHE_WORDS = 120_000
CACHE_PAIRS = 200_000
CACHED_CHARS = 48
_NEVER = 1 << 60
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,]?)")
_INNER_SPACE = re.compile(r"\s \s|\s \Z")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for every byte in such vocabularies: printable bytes for
    themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and tables of one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet = byte_alphabet()
        ids: dict[str, int] = content["model"]["vocab"]
        raw = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        raw |= {i: t.encode() for t, i in self.special.items()}
        self.raw = raw
        size = max(raw) + 1
        self.length = np.array([len(raw.get(i, b"")) for i in range(size)], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        self.shown = [str(i) for i in range(size)]
        self.made: dict[int, int] = {i: -1 for i in raw}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(content["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            if whole in self.parts:
                raise ValueError("a token is made by two merges")
            self.rank[pair], self.made[whole], self.parts[whole] = rank, rank, pair
        self.compatible = BoundedCache(lambda pair: self.keeps_apart(pair >> 24, pair & 0xFFFFFF), CACHE_PAIRS)
        self.automaton = ahocorasick.Automaton()
        usable: dict[int, bool] = {}
        self.of_bytes: dict[bytes, int] = {}
        for i in sorted(raw, key=lambda t: self.made[t]):
            if i in self.parts:
                left, right = self.parts[i]
                usable[i] = usable[left] and usable[right] and self.keeps_apart(left, right, self.made[i])
            else:
                usable[i] = len(raw[i]) == 1
            if usable[i]:
                self.of_bytes[raw[i]] = i
                self.automaton.add_word(raw[i].decode("latin-1"), (i, len(raw[i])))
        self.automaton.make_automaton()
        self.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
        self.alphabet = alphabet
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = BoundedCache(lambda chunk: self.chunk_ids(chunk, ""), CACHE_WORDS)
        self.spaced = BoundedCache(lambda chunk: self.chunk_ids(chunk, " "), CACHE_WORDS)

    def keeps_apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge joins pieces across the border of ``a`` and ``b`` before rank ``until``.

        Walks back through the pieces next to the border, undoing the later merge first; a piece
        on the left is gone once its own merge has come, one on the right may still be taken by
        the merge of the same rank."""
        until_a = until_b = until
        made, parts, rank = self.made, self.parts, self.rank
        while True:
            r = rank.get((a, b))
            if r is not None and r < until_a and r <= until_b and r < until:
                return False
            if made[a] > made[b]:
                until_a, a = made[a], parts[a][1]
            elif made[b] >= 0:
                until_b, b = made[b], parts[b][0]
            else:
                return True

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word without special tokens."""
        if word in self.of_bytes:
            return [self.of_bytes[word]]
        n = len(word)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        # matches come by their ends, so the longest of a place is its last
        for end, match in self.automaton.iter(word.decode("latin-1")):
            begins[end - match[1] + 1].append(match)
        dead = bytearray(n + 1)
        compatible = self.compatible
        out: list[int] = []
        taken: list[tuple[int, int]] = []  # per id: its place and how many shorter options are left there
        at, left = 0, len(begins[0])
        while at < n:
            options = begins[at]
            while left:
                left -= 1
                token, length = options[left]
                if not dead[at + length] and (not out or compatible[out[-1] << 24 | token]):
                    out.append(token)
                    taken.append((at, left))
                    at += length
                    left = len(begins[at]) if at < n else 0
                    break
            else:
                dead[at] = 1
                out.pop()
                at, left = taken.pop()
        return out

    def piece_ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens, cut by the vocabulary's pattern."""
        out: list[int] = []
        for piece, _ in self.pre_tokenizer.pre_tokenize_str(text):
            out += self.word_ids(bytes(self.alphabet[c] for c in piece))
        return out

    def chunk_ids(self, chunk: str, lead: str) -> bytes:
        """Ids of a stretch between spaces, as bytes."""
        m = _PLAIN.fullmatch(chunk)
        if m and m[2]:
            known = (self.spaced if lead else self.plain)[m[1]]
            return known + self.plain[m[2]]
        if m:
            return _packed(self.word_ids((lead + chunk).encode()))
        lines = chunk.split("\n")
        if len(lines) > 1 and not any(s and (s[0].isspace() or s[-1].isspace()) or not s for s in lines):
            # one line end between two other characters is a token of its own
            end = _packed(self.word_ids(b"\n"))
            found = [(self.spaced if lead else self.plain)[lines[0]]]
            for line in lines[1:]:
                found += [end, self.plain[line]]
            return b"".join(found)
        return _packed(self.piece_ids(lead + chunk))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.splitter and self.splitter.search(text):
            ids: list[int] = []
            for i, part in enumerate(self.splitter.split(text)):
                ids += [self.special[part]] if i % 2 else self.piece_ids(part)
            packed = _packed(ids)
        elif _INNER_SPACE.search(text):
            packed = _packed(self.piece_ids(text))
        else:
            first, *rest = text.split(" ")
            spaced = self.spaced
            found = [self.plain[first]] if first else []
            found += [spaced[c] if len(c) < CACHED_CHARS else self.chunk_ids(c, " ") for c in rest]
            packed = b"".join(found)
        return np.frombuffer(packed, np.uint32)

    def listed(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by commas."""
        shown = self.shown
        return ",".join([shown[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; broken UTF-8 becomes replacement characters."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(self.offset[ids] - (ends - lengths), lengths)
        return self.blob[places].tobytes().decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """The vocabulary, once per worker."""
    return Vocabulary(path)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = load(path)
        n, coded, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            ids = vocabulary.encode(text or "")
            n.append(len(ids))
            coded.append(hashlib.sha256(vocabulary.listed(ids).encode()).hexdigest())
            decoded.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>), ``n_tokens`` and ``exact`` in place of ``text``.

    ``exact``: decoding the ids gives the text again."""
    place = docs.columns.index("text")
    kept = [c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "exact")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = load(path)
        ids, exact = [], []
        for text in batch.column(place).to_pylist():
            ids.append(vocabulary.encode(text or ""))
            exact.append(vocabulary.decode(ids[-1]) == (text or ""))
        lengths = [len(i) for i in ids]
        ends = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists, pa.array(lengths, pa.int64()), pa.array(exact)], [*kept, "token_ids", "n_tokens", "exact"])

    new = [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("exact", BooleanType())]
    return per_batch(docs, work, StructType([docs.schema[c] for c in kept] + new))
