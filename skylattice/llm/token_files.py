"""Token-id files in Simple-8b words.

Ids are cut into blocks of ``BLOCK``; a block is a run of 64-bit words, each with a 4-bit selector
and as many ids as fit in its 60 bits at the selector's width. A value of more than 60 bits is an
escape: its word points into a table of raw values. Every file holds its documents' ids and
lengths and the first word of every block, so any range is decoded by itself, with one vector
step per selector.

Writing sorts documents by id over the cluster, each task writes its own files to the shared
folder under names of its own and reports them in a manifest, so repeated or lost tasks leave
nothing behind that is read. Reading takes the files of a manifest with Spark's reader of binary
files.

Defined results: null and empty texts have only the end id; rows without an id come first, in no
order among themselves; rows that repeat an id stand side by side.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import BoundedCache, materialize, small_batches, to_bytes
from skylattice.session import scratch_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

BLOCK = 1_024
SEGMENT = 512 * BLOCK  # ids that one vector step packs
FILE_IDS = 4_000_000
END_ID = 1
CACHE_WORDS = 200_000
ROUND_BYTES = 1 << 20
MAGIC = b"SLS8B\x00\x00\x01"
# ids per word and bits per id, by selector; selector 0 is the escape
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least 1."""
    out = np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    large = np.flatnonzero(values >= np.uint64(1 << 52))  # beyond doubles' whole numbers
    out[large] = [int(v).bit_length() for v in values[large]]
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of every block (and the end), and the escape table of ``ids``."""
    words, first, escapes = [], [np.zeros(1, np.int64)], []
    for start in range(0, len(ids), SEGMENT):
        w, f, e = _pack_segment(ids[start : start + SEGMENT].astype(np.uint64), sum(map(len, escapes)))
        first.append(f[1:] + sum(map(len, words)))
        words.append(w)
        escapes.append(e)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *words]), np.concatenate(first), np.concatenate([none, *escapes])


def _pack_segment(ids: np.ndarray, escaped_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``pack`` for whole blocks; escapes are numbered from ``escaped_before``."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    widest = int(COUNTS.max())
    values = np.zeros(blocks * BLOCK, np.uint64)
    values[:n] = ids
    # beyond a block's end nothing fits
    need = np.full((blocks, BLOCK + widest), 255, np.uint8)
    need[:, :BLOCK] = _bits(values).reshape(blocks, BLOCK)
    if n < blocks * BLOCK:
        need[-1, n - (blocks - 1) * BLOCK :] = 255
    most = {1: need}  # largest need in a stretch, by its length
    length = 1
    while length * 2 <= widest:
        most[2 * length] = np.maximum(most[length][:, : -length or None], most[length][:, length:])
        length *= 2
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(1, len(COUNTS)):
        count = int(COUNTS[selector])
        half = 1 << (count.bit_length() - 1)
        stretch = np.maximum(most[half][:, :BLOCK], most[half][:, count - half : count - half + BLOCK])
        choice[stretch <= WIDTHS[selector]] = selector
    ends = np.full(blocks, BLOCK)
    if blocks:
        ends[-1] = n - (blocks - 1) * BLOCK
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    places, selectors = [], []
    while len(row):
        s = choice[row, at]
        places.append(row * BLOCK + at)
        selectors.append(s)
        at = at + COUNTS[s]
        more = at < ends[row]
        row, at = row[more], at[more]
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    selector = np.concatenate(selectors) if selectors else np.zeros(0, np.uint8)
    order = np.argsort(place, kind="stable")
    place, selector = place[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if len(own):
            step = np.arange(COUNTS[s])
            words[own] |= np.bitwise_or.reduce(values[place[own][:, None] + step] << (step * WIDTHS[s]).astype(np.uint64), axis=1)
    escaped = np.flatnonzero(selector == 0)
    words[escaped] |= np.arange(escaped_before, escaped_before + len(escaped), dtype=np.uint64)
    first = np.searchsorted(place, np.arange(blocks + 1) * BLOCK)
    return words, first.astype(np.int64), values[place[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a run of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if len(own):
            step = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[start[own][:, None] + step] = (words[own][:, None] >> (step * WIDTHS[s]).astype(np.uint64)) & mask
    own = np.flatnonzero(selector == 0)
    out[start[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One file: sizes, documents (a null id is marked), lengths, block offsets, words, escapes."""
    words, first, escapes = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    sizes = np.array([len(doc_ids), len(ids), len(first), len(words), len(escapes)], "<i8")
    parts = [sizes, np.array([d or 0 for d in doc_ids], "<i8"), known, np.array(lengths, "<i8"), first.astype("<i8"), words.astype("<u8"), escapes.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """A file's parts; ids are decoded block-wise on demand."""

    def __init__(self, content: bytes) -> None:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("no token file")
        docs, self.n_ids, blocks, words, escapes = np.frombuffer(content, "<i8", 5, len(MAGIC)).tolist()
        at = len(MAGIC) + 40
        parts = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", blocks), ("<u8", words), ("<u8", escapes)):
            parts.append(np.frombuffer(content, kind, n, at))
            at += parts[-1].nbytes
        ids, known, self.lengths, self.first, self.words, self.escapes = parts
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from place ``start`` to ``stop`` of the file."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        low, high = start // BLOCK, -(-stop // BLOCK)
        got = unpack(self.words[self.first[low] : self.first[high]], self.escapes)
        return got[start - low * BLOCK : stop - low * BLOCK]


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Tokenizer, BoundedCache]:
    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def one(word: bytes) -> bytes:
        return np.array(model.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()

    return model, BoundedCache(one, CACHE_WORDS)


def encode_words(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of texts under a vocabulary that drops white space, lower-cases and cuts at it: words are
    encoded once and remembered. Where a text may hold a special token its case is kept."""
    model, known = _encoder(path)
    split = [(t if b"<|" in t else t.lower()).split() for t in texts]
    new = [w for w in set().union(*split) if w not in known and w not in known.older]
    for word, coded in zip(new, model.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
        known[word] = np.array(coded.ids, np.uint32).tobytes()
    return [np.frombuffer(b"".join([known[w] for w in words]), np.uint32) for words in split]


def write_files(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Writes the files of ``docs`` (doc_id, text) in the order of doc_id; gives the manifest
    (part, place, file, n_docs, n_ids), in whose order the files follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        place = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal place, total
            name = f"ids-{part:06d}-{place:05d}-{uuid.uuid4().hex}.bin"
            content = file_bytes(doc_ids, [len(i) for i in ids], np.concatenate(ids))
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            row = {"part": [part], "place": [place], "file": [name], "n_docs": [len(doc_ids)], "n_ids": [total]}
            doc_ids.clear()
            ids.clear()
            place, total = place + 1, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            texts = [t or b"" for t in to_bytes(batch.column(1))]
            keys = batch.column(0).to_pylist()
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= ROUND_BYTES):
                    size += len(texts[high])
                    high += 1
                for key, coded in zip(keys[low:high], encode_words(texts[low:high], path), strict=True):
                    doc_ids.append(key)
                    ids.append(np.append(coded, np.uint32(END_ID)))
                    total += len(ids[-1])
                    if total >= FILE_IDS:
                        yield flush()
                low = high
        if doc_ids:
            yield flush()

    # the text orders rows that share an id, and spreads those without one
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    ordered = told.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    jvm = docs.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(target)
    return materialize(small_batches(ordered).mapInArrow(run, "part long, place long, file string, n_docs long, n_ids long"), "manifest")


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts all ids before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(content.as_py())
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                crc = []
                low = 0
                while low < len(ends):
                    high = max(low + 1, int(np.searchsorted(ends, starts[low] + 50 * BLOCK)))
                    got = file.ids(int(starts[low]), int(ends[high - 1])).astype("<u4")
                    crc += [zlib.crc32(got[a - starts[low] : b - starts[low]].tobytes()) for a, b in zip(starts[low:high], ends[low:high], strict=True)]
                    low = high
                columns = [pa.array([name] * len(crc)), pa.array(file.doc_ids, pa.int64()), pa.array(starts), pa.array(file.lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "token_files")
    return read_files(write_files(docs, path, folder), folder)
