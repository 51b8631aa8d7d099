"""URL filtering by fixed rules and by association rules mined with FP-growth.

A url becomes a set of tokens (host labels and their parts, path segments, file type,
query keys, fragment). Spark's FP-growth mines the combinations of tokens, together with a
label token, of a bounded sample of labelled pages. Rules `tokens => bad` or `tokens =>
good` that have enough support and confidence, and that no shorter rule implies, are kept;
an inverted index from each rule's rarest token finds the rules of a url.

A null url, or one without `://`, has an empty host and path and no tokens: its verdict is
allow. In a tie of confidence it is allow, too. Rows that repeat are judged each; page_id may
be null; an empty table gives no rows, and no labels no rules. Other columns aren't read. A
url is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .deal import dealt
from .store import keep
from .workers import by_batch

#: (host, path, verdict): the longest that fits decides.
FIXED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
BAD, GOOD = "=bad", "=good"

Rules = list[tuple[frozenset[str], str, float]]


def split(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path and the rest."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    m = _PARTS.match(rest)
    return m[1].translate(_LOWER), m[2], rest[m.end() :]


def tokens(url: str | None) -> list[str]:
    host, path, rest = split(url)
    if not host and not path:
        return []
    labels = host.split(".")
    found = {f"h:{x}" for x in labels if x} | {f"w:{w}" for x in labels if "-" in x for w in x.split("-") if w}
    found |= {f"d:{'.'.join(labels[-2:])}"}
    segments = [s for s in path.split("/") if s]
    found |= {f"p:{s.lower()}" for s in segments if not s.isdigit()}
    found |= {f"n:{min(len(segments), 5)}"}
    if segments and "." in segments[-1]:
        found.add(f"t:{segments[-1].rpartition('.')[2].lower()}")
    query, _, fragment = rest.partition("#")
    found |= {f"q:{k.partition('=')[0]}" for k in query.lstrip("?").split("&") if k}
    if fragment:
        found.add("f")
    return sorted(found)


def fixed(host: str, path: str) -> tuple[str | None, str | None]:
    """The longest fixed rule that fits, and its verdict."""
    fits = [(len(h + p), h + p, verdict) for h, p, verdict in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and quality of the pages whose url ends in the number of a labelled document.

    labels: doc_id and quality, 0 or 1; of labels that share a doc_id the least counts.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").alias("quality"))
    number = F.regexp_extract(F.col("url").cast("string"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#]|$)", 1)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(number != "", number.cast("long")).alias("doc")).where("page_id is not null and doc is not null")
    counts = keep(one.join(named.groupBy("doc").agg(F.count("*").alias("n")).hint("merge"), "doc"), "labelled")
    return dealt(named, counts, ["doc"], "n", pages.count()).select("page_id", "quality")


def mine(pages: DataFrame, labels: DataFrame, most: int = 50_000, support: float = 0.002, confidence: float = 0.6, lift: float = 1.05) -> Rules:
    """Rules from at most `most` labelled pages (those of least hash).

    labels: page_id and quality; 0 is bad. support: the least share of the sample that has
    the tokens and the label; confidence: the least share of the label among pages with the
    tokens; lift: how many times its share of the sample that must at least be, so a label
    that most pages have isn't a rule by itself. A url has some ten tokens, so there are at
    most about 2**10 / support rules.
    """
    from pyspark.ml.fpm import FPGrowth

    one = labels.where("page_id is not null and quality in (0, 1)").groupBy(F.col("page_id").cast("long").alias("labelled")).agg(F.min("quality").alias("quality"))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    sample = source.join(one.hint("merge"), F.col("page_id") == F.col("labelled")).orderBy(F.xxhash64("page_id"), "url").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*tokens(u), GOOD if q else BAD] for u, q in zip(batch.column("url").to_pylist(), batch.column("quality").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["items"])

    items = keep(by_batch(sample.select("url", "quality"), run, T.StructType([T.StructField("items", T.ArrayType(T.StringType()))])), "items")
    if items.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    made = model.associationRules.where(F.col("consequent")[0].isin(BAD, GOOD) & (F.col("lift") >= lift))
    return pruned([(frozenset(r.antecedent), r.label, r.confidence) for r in made.select("antecedent", F.col("consequent")[0].alias("label"), "confidence").collect()])


def pruned(rules: Rules) -> Rules:
    """The rules than which none with fewer of their tokens is as sure of the same label."""
    sure = {(name, label): confidence for name, label, confidence in rules}
    best: dict[tuple[frozenset[str], str], float] = {}

    def within(name: frozenset[str], label: str) -> float:
        """The surest rule whose tokens are all among `name`."""
        if (name, label) not in best:
            best[name, label] = max([sure.get((name, label), 0.0), *(within(name - {t}, label) for t in name)])
        return best[name, label]

    kept = [r for r in rules if all(within(r[0] - {t}, r[1]) < r[2] for t in r[0])]
    return sorted(kept, key=lambda r: (len(r[0]), sorted(r[0]), r[1]))


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: Rules):
        often: dict[str, int] = {}
        for name, _, _ in rules:
            for t in name:
                often[t] = often.get(t, 0) + 1
        self.by: dict[str, Rules] = {}
        for rule in rules:
            self.by.setdefault(min(rule[0], key=lambda t: (often[t], t)), []).append(rule)

    def verdict(self, url: str | None) -> str:
        """block if the surest rule that fits says bad; allow if it says good, in a tie, or without a rule."""
        own = frozenset(tokens(url))
        sure = {BAD: 0.0, GOOD: 0.0}
        for t in own:
            for name, label, confidence in self.by.get(t, ()):
                if name <= own:
                    sure[label] = max(sure[label], confidence)
        return "block" if sure[BAD] > sure[GOOD] else "allow"


def judge(pages: DataFrame, rules: Rules) -> DataFrame:
    """page_id, host, path, rule (the fixed rule that fits) and verdict of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(Index(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path, _ = split(url)
                rule, verdict = fixed(host, path)
                rows.append((page, host, path, rule, verdict or shared.value.verdict(url)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4), strict=True)], ["page_id", "host", "path", "rule", "verdict"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return by_batch(source, run, "page_id long, host string, path string, rule string, verdict string")
