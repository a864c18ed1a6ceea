"""Personal data in whole texts: fixed patterns and a semi-Markov conditional random field.

The patterns (``base_spans``) are exact and linear in the text. The field scores whole candidate
spans of up to ``MAX_WORDS`` words around triggers (digits, @, spelled-out at and dot): a
segmentation of a window is a sequence of plain words and typed spans, its weight the sum of span
scores, and dynamic programming over span ends picks boundaries and kinds together. It finds what
the patterns miss: spelled-out addresses, telephone numbers without a country code, cards and
addresses with other separators. It is trained here, by the gradient of the conditional
likelihood, on a bounded sample of windows whose labels are the pattern spans and variants
derived from them.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; a
field span that overlaps a pattern span is dropped; where the sample has no pattern span the field
adds nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.common import materialize, per_batch, small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_WORDS = 8
MAX_SPAN_CHARS = 320
CONTEXT = 4
SAMPLE_WINDOWS = 600  # windows that the field is fitted on, at most; each of at most MAX_WINDOW_CHARS
MAX_WINDOW_CHARS = 2_000
EPOCHS = 12
MARGIN = 1.0  # log odds that a field span needs against plain words

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (1 + place % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) < 3 or (len(rest) == 3 and int(rest) <= 255)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern spans, ordered by start, then kind."""
    out: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _ANY_DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            if len(parts) < 4:
                continue
            place = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = place + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append((place, 1, end))
                place = end + 1
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _only_digits(m[0])
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
    return sorted(out)


# The field

_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]|(?<= )dot(?= )")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+(?: ?(?:@|[\[(]at[\])]) ?| at )[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)(?:\.|\[\.\]|\(\.\))([0-9]+)(?:\.|\[\.\]|\(\.\))([0-9]+)(?:\.|\[\.\]|\(\.\))([0-9]+)")
_GROUPED = re.compile(r"[0-9]+(?:[ .-][0-9]+)*")
_CALL = re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,5}")
_CUES = (  # fixed values: words that announce a kind
    ("email", "e-mail", "mail"), ("ip", "host", "address"), ("card", "visa", "karte", "tarjeta", "carte"), ("tel", "phone", "call", "fax", "mobile", "telefon", "teléfono", "tél"),
)
_LEFT = re.compile(r"[^A-Za-z0-9+(]+")
_RIGHT = re.compile(r"[^A-Za-z0-9]+\Z")
N_FEATURES = 28


def features(core: str, n_words: int, before: str, after: str) -> list[int]:
    """Numbers of the features that hold for a whole span between its neighbour words."""
    digits = _only_digits(core)
    letters = any(c.isalpha() for c in core)
    quad = _QUAD.fullmatch(core)
    grouped = _GROUPED.fullmatch(core)
    out = [0, 14 + min(n_words, 5)]
    if _EMAIL.fullmatch(core):
        out.append(1)
    elif _SPELLED.fullmatch(core):
        out.append(2)
    if quad:
        out.append(3 if all(map(_octet, quad.groups())) else 4)
    if grouped and 14 <= len(digits) <= 19:
        out.append(5 if _luhn(digits) else 6)
    if _CALL.fullmatch(core):
        out.append(7 if 9 <= len(digits) <= 15 else 8)
    shaped = len(out) > 2
    if not shaped:
        out.append(9 if len(digits) < 7 else 10 if len(digits) < 16 else 11)
    if letters and digits:
        out.append(12)
    if letters and not digits:
        out.append(13)
    if core[0] == "+":
        out.append(14)
    cue = before.lower().strip(".,:;()")
    out += [20 + k for k, words in enumerate(_CUES) if cue in words]
    if "=" in before or '"' in before or '"' in after:
        out.append(24)
    if {cue, after.lower()} & {"at", "dot", "(at)", "[at]", "(dot)", "[dot]"}:
        out.append(27)
    if not shaped and not _ANY_DIGIT.search(core.split(" ", 1)[0]):
        out.append(25)
    if not shaped and not _ANY_DIGIT.search(core.rsplit(" ", 1)[-1]):
        out.append(26)
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of words around triggers, each with ``CONTEXT`` words on both sides."""
    hits = [m.start() for m in _TRIGGER.finditer(text)]
    if not hits:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    out: list[tuple[int, int]] = []
    for word in dict.fromkeys(bisect_right(starts, h) - 1 for h in hits):
        low, high = max(0, word - CONTEXT), min(len(words), word + CONTEXT + 1)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return [(words[a][0], words[b - 1][1]) for a, b in out]


Segment = tuple[int, int, int, int, list[int]]  # first word, word after, start, end, features


def segments(window: str) -> tuple[int, list[Segment]]:
    """Number of words of a window and its candidate spans."""
    words = [m.span() for m in _WORD.finditer(window)]
    hot = [bool(_TRIGGER.search(window, max(0, a - 1), min(len(window), b + 1))) for a, b in words]
    before = [0]
    for h in hot:
        before.append(before[-1] + h)
    out: list[Segment] = []
    for i, (a, _) in enumerate(words):
        for j in range(i + 1, min(len(words), i + MAX_WORDS) + 1):
            b = words[j - 1][1]
            if b - a > MAX_SPAN_CHARS:
                break
            if before[j] == before[i]:
                continue
            low = m.end() if (m := _LEFT.match(window, a, b)) else a
            high = m.start() if (m := _RIGHT.search(window[:b], low)) else b
            if window[low : low + 1] == "(" and ")" not in window[low:high]:
                low += 1
            # a span must begin in its first word and end in its last
            if low >= high or low >= words[i][1] or high <= words[j - 1][0]:
                continue
            core = re.sub(r"[\x09-\x0D\x20]+", " ", window[low:high])
            out.append((i, j, low, high, features(core, j - i, window[slice(*words[i - 1])] if i else "", window[slice(*words[j])] if j < len(words) else "")))
    return len(words), out


def decode(window: str, weights: np.ndarray) -> list[Span]:
    """The best segmentation's spans whose log odds against plain words exceed ``MARGIN``."""
    n, segs = segments(window)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: dict[int, list] = {}
    for s in segs:
        scores = weights[s[4]].sum(0)
        kind = int(scores.argmax())
        ending.setdefault(s[1], []).append((float(scores[kind]), kind, s))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, kind, s in ending.get(j, ()):
            if score > MARGIN and best[s[0]] + score > best[j]:
                best[j], back[j] = best[s[0]] + score, (s, kind)
    out, j = [], n
    while j:
        if back[j]:
            s, kind = back[j]
            out.append((s[2], kind, s[3]))
            j = s[0]
        else:
            j -= 1
    return out[::-1]


def _variants(window: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Windows in which one of the spans is written otherwise, and some in which it is no personal data any more."""
    chosen = spans[len(window) % len(spans)]
    start, kind, end = chosen
    others = [s for s in spans if s[2] <= start or s[0] >= end]
    s = window[start:end]
    if kind == 0:
        local, host = s.split("@", 1)
        spelled = [f"{local} at {host.replace('.', ' dot ')}", f"{local} (at) {host}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local}[at]{host}"]
        broken = [f"{local} at {host.split('.')[0]}", f"{host.split('.')[0]} dot {local}"]
    elif kind == 1:
        a = s.split(".")
        spelled, broken = ["[.]".join(a)], [".".join(a[:3]), ".".join([str(int(a[0]) + 700), *a[1:]]), f"v{s}"]
    elif kind == 2:
        d = _only_digits(s)
        spelled = [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for sep in ".- "]
        broken = [sep.join(w[i : i + 4] for i in range(0, len(w), 4)) for sep in ("", ".") for w in (d[:-1] + str((int(d[-1]) + 1) % 10),)]
    else:
        d = _only_digits(s)[-10:]
        spelled = [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"]
        broken = [f"{d[3:6]}-{d[6:8]}", d[:5], f"{d[:2]}.{d[2]}"]
    for new, keep in (*((x, True) for x in spelled), *((x, False) for x in broken)):
        moved = len(new) - (end - start)
        rest = [s if s[2] <= start else (s[0] + moved, s[1], s[2] + moved) for s in others]
        yield window[:start] + new + window[end:], sorted([*rest, *[(start, kind, start + len(new))] * keep])


def _examples(sample: list[str]) -> list[tuple[int, list[Segment], list[tuple[int, int]]]]:
    """Per training window: its words, candidates and the gold (candidate number, kind) pairs."""
    out = []
    for window in sample:
        spans = base_spans(window)
        made = [(window, spans)]
        if spans:
            made += _variants(window, spans)
        for text, gold in made:
            n, segs = segments(text)
            at = {(s[2], s[3]): i for i, s in enumerate(segs)}
            found = [(at[a, b], k) for a, k, b in gold if (a, b) in at]
            if len(found) == len(gold):
                out.append((n, segs, found))
    return out


def train(sample: list[str]) -> np.ndarray:
    """Weights (feature, kind) by adaptive gradient steps on the conditional likelihood."""
    examples = _examples(sample)
    weights = np.zeros((N_FEATURES, len(KINDS)))
    if not any(gold for _, _, gold in examples):
        weights[0] = -100.0
        return weights
    weights[0] = -2.0
    squares = np.full_like(weights, 1e-2)
    order = np.random.default_rng(11)
    tables = []
    for n, segs, gold in examples:
        if segs:
            x = np.zeros((len(segs), N_FEATURES))
            for row, s in enumerate(segs):
                x[row, s[4]] = 1
            tables.append((n, [(s[0], s[1]) for s in segs], x, gold))
    for _ in range(EPOCHS):
        for t in order.permutation(len(tables)):
            n, spans, x, gold = tables[t]
            scores = x @ weights
            top = scores.max(1)
            lse = (top + np.log(np.exp(scores - top[:, None]).sum(1))).tolist()
            ending: list[list[int]] = [[] for _ in range(n + 1)]
            for i, (_, j) in enumerate(spans):
                ending[j].append(i)
            ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                terms = [ahead[j - 1], *(ahead[spans[i][0]] + lse[i] for i in ending[j])]
                most = max(terms)
                ahead[j] = most + math.log(sum(math.exp(v - most) for v in terms))
            starting: list[list[int]] = [[] for _ in range(n + 1)]
            for i, (a, _) in enumerate(spans):
                starting[a].append(i)
            for a in range(n - 1, -1, -1):
                terms = [behind[a + 1], *(behind[spans[i][1]] + lse[i] for i in starting[a])]
                most = max(terms)
                behind[a] = most + math.log(sum(math.exp(v - most) for v in terms))
            chance = np.exp(np.array([ahead[a] + behind[b] for a, b in spans])[:, None] + scores - ahead[n])
            target = np.zeros_like(chance)
            for i, k in gold:
                target[i, k] = 1
            gradient = x.T @ (target - chance) - 1e-3 * weights
            squares += gradient**2
            weights += 0.5 * gradient / np.sqrt(squares)
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Pattern spans, and all spans with those the field adds."""
    base = base_spans(text)
    added: list[Span] = []
    for low, high in windows(text):
        added += [(low + a, k, low + b) for a, k, b in decode(text[low:high], weights)]
    if not added:
        return base, base
    covered = sorted((a, b) for a, _, b in base)
    firsts = [a for a, _ in covered]
    reach = np.maximum.accumulate([b for _, b in covered]).tolist() if covered else []

    def free(a: int, b: int) -> bool:
        i = bisect_right(firsts, b - 1) - 1
        return i < 0 or reach[i] <= a

    return base, sorted([*base, *(s for s in added if free(s[0], s[2]))])


def sample_windows(docs: DataFrame) -> list[str]:
    """Windows of the corpus with the smallest hashes; every task passes on a bounded number."""
    half = SAMPLE_WINDOWS // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for low, high in windows(text or ""):
                    if high - low <= MAX_WINDOW_CHARS:
                        window = text[low:high]
                        heap = heaps[bool(base_spans(window))]
                        item = (-xxhash.xxh3_64_intdigest(window), window)
                        if len(heap) < half:
                            heapq.heappush(heap, item)
                        elif item > heap[0] and item not in heap:
                            heapq.heapreplace(heap, item)
        for positive, heap in heaps.items():
            if heap:
                yield pa.RecordBatch.from_arrays([pa.array([positive] * len(heap)), pa.array([w for _, w in heap])], ["positive", "phrase"])

    found = materialize(small_batches(docs.select("text")).mapInArrow(run, "positive boolean, phrase string").distinct(), "windows")
    counts = {r["positive"]: r["count"] for r in found.groupBy("positive").count().collect()}
    out: list[str] = []
    for positive, n in sorted(counts.items(), reverse=True):
        # a threshold on the hash first, so that what the tasks send for the limit is about twice the sample in all
        place = F.pmod(F.xxhash64("phrase"), F.lit(1 << 30))
        own = found.where((F.col("positive") == positive) & (place < int(min(1.0, 2 * half / n) * (1 << 30))))
        out += [r["phrase"] for r in own.orderBy(place, "phrase").limit(half).collect()]
    return out


def fit(docs: DataFrame) -> np.ndarray:
    """The field's weights for a corpus."""
    return train(sample_windows(docs))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    weights = fit(docs)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
        digests, listed = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            base, spans = all_spans(text or "", weights)
            for _, k, _ in base:
                counts[row, k] += 1
            digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            listed.append(_listed(spans))
        columns = [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests), pa.array(listed)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first start counts, to the last end."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other columns as they are."""
    weights = fit(docs)
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redacted(t, all_spans(t, weights)[1]) for t in batch.column(place).to_pylist()]
        return batch.set_column(place, batch.schema.names[place], pa.array(texts, batch.schema.field(place).type))

    return per_batch(docs, work, docs.schema)
