"""Personal data and secrets, by fixed patterns and by weak supervision.

Base patterns give emails, ip addresses, payment cards and international phone numbers;
their spans always stay. Looser candidates (national phone numbers, tokens that mix letters
and digits) are voted on by four labelers: a strict pattern, a gazetteer of prefixes and
codes, the words before, and the token's shape. The vote patterns of the whole corpus are
counted (a bounded table), expectation-maximisation estimates each labeler's reliability
and the probability of each pattern, and a logistic span classifier is trained on these
probabilities with features of its own. It decides which candidates become spans.

Candidates are tokens of at least eight characters with a digit and a letter, tokens without a
digit where a cue word and `:` or `=` stand before them, and groups of 3, 3 and 4 digits; the
labelers see the 24 characters before. All scans are linear in the text, which is held whole.
Offsets are code points, ends exclusive. A null text is empty and stays null when masked. Rows
that repeat are scanned each. doc_id may be null. Spans that begin at one place are ordered by
kind. An empty table gives no rows, and a table without candidates only base spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import by_batch, numbered

KINDS = ["email", "ip", "card", "phone", "secret"]

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9][0-9 .\-]{6,}")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TOKEN = re.compile(r"[A-Za-z0-9_-]+")
_INSIDE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = (ord(d) - 48) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping by kind."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((low, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    for region in _NUMBERS.finditer(text):
        low, high = region.span()
        for run in _DOTTED.finditer(text, low, high):
            parts = [m.span() for m in _DIGITS.finditer(text, *run.span())]
            for i in range(0, len(parts) - 3, 4):
                if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in parts[i : i + 4]):
                    out.append((parts[i][0], 1, parts[i + 3][1]))
        for m in _CARD.finditer(text, low, high):
            if 12 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# The labelers: 1 for, 2 against, 0 no opinion.
_STRICT = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,}|[0-9a-f]{18,}|[0-9A-F]{18,}")
_LOOSE_WORD = re.compile(r"[A-Za-z]+[0-9]{0,2}|[0-9_-]+[A-Za-z]{0,3}")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "xox", "AIza", "eyJ")
_CUES = re.compile(r"(?:password|passwd|pwd|token|secret|api[ _-]?key|access[ _-]?key|credential)\W{0,4}$", re.I)
_CALLS = re.compile(r"(?:phone|tel|telephone|call|fax|mobile|cell)\W{0,4}$", re.I)
#: Tokens without a digit, after a sign of assignment, and the cue that must stand before that.
_GIVEN = re.compile(r"[:=][ \"']{0,2}([A-Za-z_-]{8,})(?![A-Za-z0-9_-])")
_NAMES = re.compile(r"(?:password|passwd|pwd|token|secret|key|credentials?)[ \"']{0,2}$", re.I)
_NEUTRAL = re.compile(r"(?:version|page|chapter|section|figure|isbn|no|number|id)\W{0,3}$", re.I)


def votes(kind: int, found: str, before: str) -> tuple[int, int, int, int]:
    if kind == 3:
        digits = [c for c in found if c.isdigit()]
        return (
            1 if re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", found) else 0,
            1 if digits[0] in "23456789" and digits[3] in "23456789" else 2,
            1 if _CALLS.search(before) else 2 if _NEUTRAL.search(before) else 0,
            1 if len({c for c in found if not c.isdigit()}) > 1 else 2 if len(set(digits)) < 3 else 0,
        )
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(found, found[1:], strict=False))
    return (
        1 if _STRICT.fullmatch(found) else 2 if _LOOSE_WORD.fullmatch(found) else 0,
        1 if found.startswith(_PREFIXES) else 0,
        1 if _CUES.search(before) else 2 if _NEUTRAL.search(before) else 0,
        1 if len(found) >= 16 and changes >= 4 else 2 if len(found) < 12 or changes < 2 else 0,
    )


def shape(found: str, before: str) -> int:
    """Bits that the span classifier sees besides the votes."""
    return sum(
        int(x) << i
        for i, x in enumerate([len(found) >= 14, len(found) >= 20, found == found.lower(), found == found.upper(), before[-1:] in ('"', "'", "=", ":"), set(found.lower()) <= set("0123456789abcdef")])
    )


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, kind, end, pattern) outside the base spans. A pattern is a number of votes and shape."""
    spans = [(a, b) for a, _, b in taken]
    at = free = 0
    for run in _DIGITS.finditer(text):
        low, high = run.span()
        if low < free:
            continue
        while at < len(spans) and spans[at][1] <= low:
            at += 1
        if at < len(spans) and spans[at][0] <= high:
            continue
        if high - low == 3 and (m := _NATIONAL.match(text, low - (low > 0 and text[low - 1] == "("))):
            kind, (low, high) = 3, m.span()
        else:
            kind = 4
            while low > free and text[low - 1] in _INSIDE:
                low -= 1
            high = _TOKEN.match(text, low).end()
            token = text[low:high]
            if high - low < 8 or token.isdigit() or not any(c.isalpha() for c in token):
                free = high
                continue
        free = high
        if any(a < high and low < b for a, b in spans[max(0, at - 1) : at + 3]):
            continue
        found, before = text[low:high], text[max(0, low - 24) : low]
        yield low, kind, high, pattern(kind, found, before)
    for m in _GIVEN.finditer(text):
        low, high = m.span(1)
        if _NAMES.search(text[max(0, m.start() - 16) : m.start()]) and not any(a < high and low < b for a, b in spans[max(0, bisect_left(spans, (low, low)) - 4) : bisect_left(spans, (high, high))]):
            yield low, 4, high, pattern(4, m[1], text[max(0, low - 24) : low])


def pattern(kind: int, found: str, before: str) -> int:
    v = votes(kind, found, before)
    return (((v[0] * 3 + v[1]) * 3 + v[2]) * 3 + v[3]) * 64 + shape(found, before)


def unpack(pattern: int) -> tuple[tuple[int, int, int, int], int]:
    v, bits = divmod(pattern, 64)
    return (v // 27, v // 9 % 3, v // 3 % 3, v % 3), bits


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Dawid and Skene's estimate from counts of vote patterns: P(true | votes), and P(vote | truth) of each labeler.

    Labelers are believed better than chance to begin with, at a fifth of the weight of all
    votes; so the two classes can't change places, nor split kinds of true spans.
    """
    keys = sorted(counts)
    v, n = np.array(keys), np.array([counts[k] for k in keys], float)
    p = 1 / (1 + np.exp(-2.0 * ((v == 1).sum(1) - (v == 2).sum(1))))
    table = np.zeros((2, v.shape[1], 3))
    belief = np.array([[0.35, 0.05, 0.6], [0.35, 0.6, 0.05]]) * (0.2 * n.sum() + 5)
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.1, 0.9)
        for truth, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(v.shape[1]):
                table[truth, j] = np.bincount(v[:, j], weights=w, minlength=3) + belief[truth]
            table[truth] /= table[truth].sum(axis=1, keepdims=True)
        log = [math.log(q) + sum(np.log(table[truth, j, v[:, j]]) for j in range(v.shape[1])) for truth, q in ((0, 1 - prior), (1, prior))]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
    return dict(zip(keys, p.tolist(), strict=True)), table


def classifier(histogram: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The probability of every seen (kind, pattern), from the counts over the corpus."""
    out = {}
    for kind in {k for k, _ in histogram}:
        seen = {p: n for (k, p), n in histogram.items() if k == kind}
        by_votes: Counter = Counter()
        for p, n in seen.items():
            by_votes[unpack(p)[0]] += n
        truth, _ = reliabilities(by_votes)
        keys = sorted(seen)
        x = np.array([[1.0, *(float(v == c) for v in unpack(p)[0] for c in (1, 2)), *(float(unpack(p)[1] >> i & 1) for i in range(6))] for p in keys])
        y, n = np.array([truth[unpack(p)[0]] for p in keys]), np.array([seen[p] for p in keys], float)
        n /= n.sum()
        w = np.zeros(x.shape[1])
        for _ in range(40):  # Newton steps, weakly bound to 0
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (n * (q - y)) + 1e-3 * w)
        out |= {(kind, p): float(z) for p, z in zip(keys, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                total.update((k, p) for _, k, _, p in candidates(text, base(text)))
    rows = [(k, p, n) for (k, p), n in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["kind", "pattern", "n"])


def learn(docs: DataFrame) -> frozenset[tuple[int, int]]:
    """The (kind, pattern) that are spans, from all candidates of docs. At most 2 * 81 * 64 patterns reach the driver."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = by_batch(text, _counted, "kind long, pattern long, n long").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect()
    return frozenset(k for k, p in classifier({(r.kind, r.pattern): r.n for r in counts}).items() if p >= 0.5)


def find(text: str, model: frozenset[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind, end) in order."""
    first = base(text)
    more = [(a, k, b) for a, k, b, p in candidates(text, first) if (k, p) in model]
    return first, sorted(first + more) if more else first


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans(docs: DataFrame, model: frozenset[tuple[int, int]] | None = None) -> DataFrame:
    """doc_id, `found` (kind, start, end, base of all spans) of each row; the model is learned from docs if not given."""
    model = learn(docs) if model is None else model
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                first, every = find(text or "", model)
                known = set(first)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in known} for a, k, b in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(source, run, "doc_id long, found array<struct<kind: string, start: long, end: long, base: boolean>>")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind; columns, whatever their names, and rows stay."""
    at = docs.columns.index("text")
    rows, place = numbered(docs)
    model = learn(rows.select(F.col(place[at]).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [t and redact(t, find(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return by_batch(rows, run, rows.schema).toDF(*docs.columns)
