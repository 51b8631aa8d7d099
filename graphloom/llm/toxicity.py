"""Toxicity from subword bags, in the manner of fastText, trained in numpy.

A word is the bag of its character n-grams (bytes of the lower-cased word between two
boundary marks) and itself, hashed to rows of an embedding table. The mean of a bag goes
through a linear softmax of two classes, so a misspelling never seen shares most of its
vectors with words that were. Labels stand for documents, so the words' probabilities are
joined by noisy-or: a document is toxic if one of its words is. Embeddings and softmax are
trained jointly on that likelihood with Adam, on three quarters of the sample; a logistic
curve over the joined evidence is fitted on the last quarter, as a word table alone is too
sure of texts that it was trained on.

Trained on a bounded sample of labelled documents (`most` toxic ones and twice as many
others); every text is scored whole. Null, empty and wordless texts score the model's prior for no word. Rows that
repeat are scored each. doc_id may be null (never a training row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbatch as tb
from .workers import by_batch, numbered

SIZES = (4, 6)
BUCKETS = 1 << 18
#: Bytes of text that are worked on at once; a byte takes about 200 bytes of arrays.
PIECE = 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CODE = np.where(_LETTER, tb.LOWER, 32).astype(np.uint8)


def bags(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features by word: (bucket, word) pairs ordered by size, then the text and the hash of each word."""
    # every text stands between spaces, as every word does
    n = len(texts.data)
    shift = np.repeat(np.arange(texts.n), np.diff(texts.at)) + 1
    code = np.full(n + texts.n + 1, 32, np.uint8)
    code[np.arange(n) + shift] = _CODE[texts.data]
    letter = code != 32
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    whole = tb.Texts(code, np.array([0, len(code)]))
    word = whole.hashes(start, end)
    of = np.searchsorted(texts.at + np.arange(texts.n + 1), start - 1, "right") - 1
    mark = np.zeros(len(code), np.int64)
    mark[start] = 1
    number = np.cumsum(mark) - 1  # of the word at or before a byte
    gap = np.concatenate([[0], np.cumsum(~letter)])
    bucket, owner = [(word % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(start))]
    packed = code.astype(np.uint64)
    value = packed.copy()
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] | (packed[size - 1 :] << np.uint64(8 * (size - 1)))
        if size in SIZES:
            # no space inside, though one may stand at either end
            at = np.flatnonzero(gap[size - 1 : -1][: len(value)] == gap[1 : len(value) + 1])
            at = at[at + size <= len(code)]
            bucket.append((tb.mix(value[at] * tb.GAMMA + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(number[at + 1])
    return np.concatenate(bucket), np.concatenate(owner), of, word


def logits(table: np.ndarray, bias: float, bucket: np.ndarray, owner: np.ndarray, words: int) -> np.ndarray:
    """Of each word: the bias and the mean of its bag's values."""
    total = np.bincount(owner, weights=table[bucket], minlength=words)
    return bias + total / np.maximum(np.bincount(owner, minlength=words), 1)


#: Values of the buckets, the bias, and the slope and level of the curve.
Model = tuple[np.ndarray, float, float, float]


def train(texts: list[str], labels: list[int], dim: int = 4, epochs: int = 40, rate: float = 0.25, prior: float = 1.0, seed: int = 7) -> Model:
    """A model of labelled texts; `prior` is the weight of one that isn't toxic."""
    fold = np.arange(len(texts)) % 4 == 3
    y = np.array(labels)
    if not 0 < y[~fold].sum() < (~fold).sum():
        fold[:] = False
    fit = np.flatnonzero(~fold)
    table, bias = embed([texts[i] for i in fit], [labels[i] for i in fit], dim, epochs, rate, prior, seed)
    held = np.flatnonzero(fold) if fold.any() else fit
    x = np.concatenate([evidence(t, table, bias) for _, _, t in tb.pieces(pa.array([texts[i] for i in held], pa.large_string()), PIECE)])
    weight = np.where(y[held] > 0, 1.0, prior)
    a, b = 1.0, 0.0
    for _ in range(200):  # damped Newton steps of a weakly bound logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d, h = weight * (p - y[held]), weight * p * (1 - p)
        g = np.array([(d * x).sum() + 0.1 * (a - 1), d.sum() + 0.1 * b])
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(m, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
    return table, bias, float(max(a, 0.05)), float(b)


def embed(texts: list[str], labels: list[int], dim: int, epochs: int, rate: float, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Values of the buckets (embedding times the softmax's difference) and the bias."""
    y = np.array(labels, np.float64)
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # words seen, sorted, and their numbers
    bag_of, owner_of, docs, place = [], [], [], []
    for a, _, piece in tb.pieces(pa.array(texts, pa.large_string()), PIECE):
        bucket, owner, of, word = bags(piece)
        kind, first, back = np.unique(word, return_index=True, return_inverse=True)
        at = np.searchsorted(known, kind)
        old = np.zeros(len(kind), bool)
        old[at < len(known)] = known[at[at < len(known)]] == kind[at < len(known)]
        own = np.zeros(len(kind), np.int32)
        own[old] = number[at[old]]
        own[~old] = len(known) + np.arange((~old).sum(), dtype=np.int32)
        take = np.full(len(word), -1, np.int32)
        take[first[~old]] = own[~old]
        known, number = np.insert(known, at[~old], kind[~old]), np.insert(number, at[~old], own[~old])
        chosen = np.flatnonzero(take[owner] >= 0)
        chosen = chosen[np.argsort(take[owner[chosen]], kind="stable")]  # words in order, as their numbers are
        bag_of.append(bucket[chosen])
        owner_of.append(take[owner[chosen]])
        pair = np.unique((of + a) * np.int64(1 << 32) + own[back])
        docs.append((pair >> 32).astype(np.int32))
        place.append((pair & 0xFFFFFFFF).astype(np.int32))
    bag, owner, doc, place = (np.concatenate(x) for x in (bag_of, owner_of, docs, place))
    del bag_of, owner_of, docs
    words = len(known)
    rows = np.flatnonzero(np.bincount(bag, minlength=BUCKETS))
    at = np.zeros(BUCKETS, np.int32)
    at[rows] = np.arange(len(rows), dtype=np.int32)
    bag = at[bag]
    count = np.bincount(owner, minlength=words).astype(np.float32)
    by_word = np.concatenate([[0], np.cumsum(count[:-1], dtype=np.int64)])
    order = np.argsort(bag, kind="stable").astype(np.int32)
    by_bag = owner[order]
    edge = np.concatenate([[0], np.cumsum(np.bincount(bag, minlength=len(rows))[:-1])])
    del order, owner
    random = np.random.default_rng(seed)
    e = random.normal(0, 0.3, (len(rows), dim)).astype(np.float32)
    w = (np.stack([-np.ones(dim), np.ones(dim)]) / np.sqrt(dim) + random.normal(0, 0.01, (2, dim))).astype(np.float32)
    bias = np.array([-8.0], np.float32)
    sure = np.where(y > 0, 1.0, prior)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, bias)]
    some = np.bincount(doc, minlength=len(y)) > 0
    for step in range(1, epochs + 1):
        value = e @ (w[1] - w[0])
        z = np.clip(bias[0] + np.add.reduceat(value[bag], by_word) / count, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc, weights=np.logaddexp(0, z)[place], minlength=len(y))
        # d loss / d sum of softplus: 1 for clean documents, -P(none) / P(any) for toxic ones
        pull = sure * np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(none, 700)), 1e-6), 1.0) * some / len(y)
        slope = (np.bincount(place, weights=pull[doc], minlength=words) * p).astype(np.float32)
        by_value = np.add.reduceat((slope / count)[by_bag], edge)
        g = by_value @ e
        grads = [by_value[:, None] * (w[1] - w[0]) + 1e-7 * e, np.stack([-g, g]) + 1e-6 * w, np.array([slope.sum()])]
        for x, g, m in zip((e, w, bias), grads, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    table = np.zeros(BUCKETS, np.float32)
    table[rows] = e @ (w[1] - w[0])
    return table, float(bias[0])


def evidence(texts: tb.Texts, table: np.ndarray, bias: float) -> np.ndarray:
    """The log of -ln P(no word is toxic)."""
    bucket, owner, of, word = bags(texts)
    z = np.clip(logits(table, bias, bucket, owner, len(word)), -30, 30)
    # a repeated word counts once, as in training
    _, first = np.unique(word ^ tb.mix(of.astype(np.uint64) * tb.GAMMA), return_index=True)
    return np.log(np.bincount(of[first], weights=np.logaddexp(0, z[first]), minlength=texts.n) + 1e-6)


def score(texts: tb.Texts, model: Model) -> np.ndarray:
    table, bias, a, b = model
    return 1 / (1 + np.exp(-np.clip(a * evidence(texts, table, bias) + b, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, most: int = 1500) -> Model:
    """A model from at most `most` toxic and 2 * `most` other labelled documents, none with crc32(doc_id) mod 5 = 0.

    labels: doc_id, toxic (0 or 1). The sample is those of least hash; labels without a text are passed over,
    and of rows that share a doc_id the least text is taken.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as bigint) as string)) % 5 <> 0")
    one = usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = one.where("toxic = 1").orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    chosen = chosen.union(one.where("toxic = 0").orderBy(F.xxhash64("labelled"), "labelled").limit(2 * most))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    share = counts.get(0, 1) / max(1, counts.get(1, 1))
    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")  # 3 * most rows at most
    made = by_batch(ordered, _trained(share), "values binary, bias double, slope double, level double").collect()  # one row of a fixed size
    if not made:
        return np.zeros(BUCKETS, np.float32), -8.0, 1.0, 0.0
    return np.frombuffer(made[0]["values"], np.float32), made[0]["bias"], made[0]["slope"], made[0]["level"]


def _trained(share: float):
    """Trains in a task, so that the driver holds neither the sample nor the training's arrays.

    share: of clean to toxic labels. No row comes of a sample without both classes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column("text").to_pylist()]
            labels += batch.column("toxic").to_pylist()
        toxic = sum(labels)
        if 0 < toxic < len(labels):
            table, *rest = train(texts, labels, prior=max(1.0, share * toxic / (len(labels) - toxic)))
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in rest)], ["values", "bias", "slope", "level"])

    return run


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with one more column, the score: one pass, no shuffle. The model has a fixed size.

    Columns of docs may have any name, that of the score as well; more than one `text` is an error.
    """
    names = docs.columns
    text = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, place = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column(text), PIECE):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score(texts, shared.value))], [*place, "score"])

    return by_batch(rows, run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).toDF(*names, name)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns of docs."""
    rows, place = numbered(docs)
    # `learn` and `scored` ask for two columns alone
    names = [c if c in ("doc_id", "text") else p for c, p in zip(docs.columns, place, strict=True)]
    made = scored(rows.toDF(*names), learn(rows.toDF(*names), labels))
    return made.where(F.col("score") < threshold).select(*names).toDF(*docs.columns)
