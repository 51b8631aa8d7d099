"""Exact top-k search by BM25: an inverted index in shards with block-max WAND pruning.

The index is cut into segments of bounded size, one or more for each partition of the
documents, and written to the shared folder. A segment has the postings of its words (lower-
cased A-Z): documents and term frequencies, and its documents' lengths. Documents with the
same words as often are one document of a segment, with all their ids. The number of
documents, the mean length and document frequencies are counted over all documents, so
scores are the same in every segment and the segments' own top k merge exactly.

A search follows WAND, for all documents of some segments at once instead of one cursor after
another, so that the work is array operations. The words of a query that are in few documents
here come first; those in many, which add little each, stand behind the pivot. A query is passed
over where the bounds of all its words together stay below the threshold, the least score that
can still be among the top k. The postings up to the pivot are summed. A document is passed over
where its sum so far and the bound of the words behind the pivot stay below the threshold: the
largest scores that they have in its block of documents, or all that they have in the document,
whichever is less. Documents are put into blocks in the order of the latter, so blocks are alike.
What remains is completed: where it is many documents of many queries, by a product of matrices,
block by block; elsewhere one by one. These sums are of 32-bit floats, and what their rounding
can hide is kept; only documents that are then among the top k get their exact scores.

An eighth of the segments is searched first; the k-th best score found there is the
threshold with which the others begin, and a task carries what it finds from one segment to
the next. Queries are worked off in blocks of bounded size, each broadcast to the segments.

score = sum over the query's distinct words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), in 64-bit floats, summed without rounding in between. Ties
go to the smaller doc_id. Documents without a word of the query are no hits, and a query without
words has none. Null texts have no words; rows without doc_id are no queries and no hits, and
aren't counted. Rows that share a doc_id are documents of their own as hits, and one query of all
their words as queries. Empty tables give no rows. Other columns aren't read. A text is
held whole, with some 60 bytes for each of its words. Words are known by 64-bit hashes under a
secret of the job, drawn anew for each, so no text can be made to clash; by chance two of a
billion words clash with a probability of 3 %, and then count as one.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbatch as tb
from .store import forget, keep
from .workers import by_batch

K1, B = 1.2, 0.75
#: A segment is closed at this many documents or postings; documents of a block.
SEGMENT, POSTINGS, BLOCK = 8192, 3 << 20, 64
#: Queries of a block, and distinct words of all of them, on average.
QUERIES, TERMS = 8192, 3 << 20
#: Share of a segment's documents from which a word has a row of all documents.
FREQUENT = 0.05
#: One of so many segments is searched first.
LOTS = 8
#: Segments are searched together up to so many documents or postings.
GROUP, GROUPED = 16384, 6 << 20
#: Queries searched together; documents that they are completed for at once.
TOGETHER, WIDE = 128, 2048
#: Share of documents that stay up to which each is completed by itself.
ALONE = 0.03
#: Where the first half of an int64 lies.
LOW = int(sys.byteorder == "big")
#: Rounding that sums in any order stay within.
SLACK = 1 - 1e-9

INDEX = "lot int, n long, total long, ids binary, copies binary, words binary, first binary, docs binary, tf binary, lengths binary"


def counted(texts: tb.Texts, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, tf) of distinct words by text, and the texts' lengths in words."""
    start, end, of = texts.words()
    word = texts.hashes(start, end, True, key)
    at, tf = tb.distinct(word, of)
    return of[at], word[at], tf, np.bincount(of, minlength=texts.n)


def twins(doc: np.ndarray, word: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each document the first one with the same words as often. doc, word: in order."""
    n = len(length)
    cut = np.searchsorted(doc, np.arange(n + 1))
    sums = np.concatenate([[0], np.cumsum(tb.mix(word + tb.mix(tf.astype(np.uint64) * tb.GAMMA)), dtype=np.uint64)])
    mark = sums[cut[1:]] - sums[cut[:-1]]
    _, first, back = np.unique(mark, return_index=True, return_inverse=True)
    same = first[back]
    for i in np.flatnonzero(same != np.arange(n)).tolist():
        a, b = slice(cut[i], cut[i + 1]), slice(cut[same[i]], cut[same[i] + 1])
        if length[i] != length[same[i]] or not (np.array_equal(word[a], word[b]) and np.array_equal(tf[a], tf[b])):
            same[i] = i
    return same


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _wide(x: bytes, count: int) -> np.ndarray:
    return np.frombuffer(x, "<u2" if len(x) == 2 * count else "<u4")


def segment(parts: list[tuple]) -> pa.RecordBatch:
    """One row of the index. parts: doc_ids, (text, word, tf) and lengths of consecutive pieces."""
    low, doc = 0, []
    for ids, of, *_ in parts:
        doc.append(of + low)
        low += len(ids)
    ids, word, tf, length = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
    doc = np.concatenate(doc)
    order = np.lexsort((word, doc))
    doc, word, tf = doc[order], word[order], tf[order]
    same = twins(doc, word, tf, length)
    kept = np.flatnonzero(same == np.arange(low))
    number = np.cumsum(same == np.arange(low)) - 1
    some = (same == np.arange(low))[doc]
    doc, word, tf = number[doc[some]], word[some], tf[some]
    by_bag = np.lexsort((ids, number[same]))  # all ids, by document and in order
    copies = np.bincount(number[same], minlength=len(kept))
    order = np.lexsort((doc, word))
    kinds, first = np.unique(word[order], return_index=True)
    lot = hashlib.blake2b(ids.tobytes(), digest_size=1).digest()[0] % LOTS
    columns = [ids[by_bag].astype("<i8").tobytes(), copies.astype("<u4").tobytes(), kinds.tobytes(), np.append(first, len(order)).astype("<i4").tobytes(), _narrow(doc[order]), _narrow(tf[order]), length[kept].astype("<u4").tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([min(lot, 1)], pa.int32()), pa.array([low]), pa.array([int(length.sum())]), *(pa.array([c], pa.binary()) for c in columns)], [c.split()[0] for c in INDEX.split(", ")])


def _segments(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, postings = [], 0, 0
        for batch in batches:
            name = batch.column("doc_id").to_numpy()
            for a, b, texts in tb.pieces(batch.column("text")):
                of, word, tf, length = counted(texts, key)
                held.append((name[a:b], of, word, tf, length))
                size, postings = size + b - a, postings + len(of)
                if size >= SEGMENT or postings >= POSTINGS:
                    yield segment(held)
                    held, size, postings = [], 0, 0
        if held:
            yield segment(held)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """df of each word of each segment."""
    for batch in batches:
        for words, first, docs, copies in zip(*(batch.column(c).to_pylist() for c in ("words", "first", "docs", "copies")), strict=True):
            first = np.frombuffer(first, "<i4")
            if len(first) > 1:
                df = np.add.reduceat(np.frombuffer(copies, "<u4").astype(np.int64)[_wide(docs, first[-1])], first[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, "<i8")), pa.array(df)], ["word", "df"])


class Asked:
    """A block of queries: names, their distinct words in order with the idf of each, and each query's words as places there."""

    def __init__(self, rows: list, words: np.ndarray, idf: np.ndarray):
        order = np.argsort(words)
        self.words, self.idf = words[order], idf[order]
        self.names = np.unique(np.array([r.query_id for r in rows], np.int64))
        own: list[list[bytes]] = [[] for _ in self.names]
        for r in rows:
            own[int(np.searchsorted(self.names, r.query_id))].append(bytes(r.words))
        sets = [np.unique(np.frombuffer(b"".join(x), np.uint64)) for x in own]
        self.cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.places = np.concatenate([np.searchsorted(self.words, s).astype(np.int32) for s in sets] or [np.zeros(0, np.int32)])
        self.least = np.zeros(len(self.names))


class Group:
    """Some segments as one: the postings of a block's words, and what they add to its queries.

    Rows of the index with consecutive documents; words are places in `asked.words`. Documents
    are numbered anew, in the order of what the frequent words add to them: `to` is that order.
    """

    def __init__(self, rows: list[tuple[bytes, ...]], asked: Asked, mean: float):
        self.asked, size, found = asked, np.zeros(len(asked.words), np.int64), []
        for _, copies, words, first, *_ in rows:
            own, first = np.frombuffer(words, np.uint64), np.frombuffer(first, "<i4").astype(np.int64)
            at = np.minimum(np.searchsorted(own, asked.words), max(0, len(own) - 1))
            here = np.flatnonzero(own[at] == asked.words) if len(own) else np.zeros(0, np.int64)
            at = at[here]
            asked_for = np.zeros(len(own), bool)
            asked_for[at] = True
            found.append((here, first[at + 1] - first[at], np.repeat(asked_for, np.diff(first))))
            size[here] += found[-1][1]
        self.size, self.first = size, np.concatenate([[0], np.cumsum(size)])
        copies = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
        self.ids = np.concatenate([np.frombuffer(r[0], "<i8") for r in rows])
        self.of = np.concatenate([[0], np.cumsum(copies, dtype=np.int64)])
        self.n, count = len(copies), int(self.first[-1])
        self.norm = K1 * (1 - B + B * np.concatenate([np.frombuffer(r[6], "<u4") for r in rows]) / mean)
        self.tf = np.zeros(count, np.uint32)
        self.postings = np.zeros(count, np.int64)  # a document and what the posting adds, 32 bits each: one look at memory finds both
        self.docs, self.value = self.postings.view(np.int32)[LOW::2], self.postings.view(np.float32)[1 - LOW :: 2]
        norm, idf = self.norm.astype(np.float32), asked.idf.astype(np.float32)
        low, used = 0, self.first[:-1].copy()
        for (_, copies, _, _, docs, tf, _), (here, own, some) in zip(rows, found, strict=True):
            doc, often = _wide(docs, len(some))[some].astype(np.int32), _wide(tf, len(some))[some]
            doc += np.int32(low)
            to = tb.spread(used[here], own) if len(rows) > 1 else slice(None)
            posting, value = np.empty(len(doc), np.int64), often.astype(np.float32)
            value *= np.float32(K1 + 1) / (value + norm[doc])
            value *= np.repeat(idf[here], own)
            posting.view(np.int32)[LOW::2], posting.view(np.float32)[1 - LOW :: 2] = doc, value
            self.postings[to], self.tf[to] = posting, often
            used[here] += own
            low += len(copies) // 4
        some = np.flatnonzero(size)
        self.most = np.zeros(len(size))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.value, self.first[some])
        often = np.flatnonzero(size > FREQUENT * self.n)
        self.column = np.full(len(size), -1, np.int32)
        self.column[often] = np.arange(len(often))
        runs = [slice(a, b) for a, b in zip(self.first[often].tolist(), self.first[often + 1].tolist(), strict=True)]
        frequent = np.concatenate([self.docs[r] for r in runs] or [self.docs[:0]]), np.concatenate([self.value[r] for r in runs] or [self.value[:0]])
        own = np.bincount(*frequent, self.n)
        self.to = np.argsort(-own, kind="stable")
        rank = np.empty(self.n, np.int32)
        rank[self.to] = np.arange(self.n)
        self.docs[:] = rank[self.docs]
        self.norm = self.norm[self.to]
        self.blocks = -(-self.n // BLOCK)
        self.own = np.zeros((self.blocks, BLOCK), np.float32)
        self.own.ravel()[: self.n] = own[self.to]
        self.dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        self.dense[rank[frequent[0]], np.repeat(np.arange(len(often)), size[often])] = frequent[1]
        self.peak = self.dense.reshape(self.blocks, BLOCK, len(often)).max(axis=1)
        # sums of the frequent words and of three parts, and factors of values, each rounded to 24 bits
        self.slack = SLACK - (len(often) + 24) * 2.0**-23

    def seldom(self, words: np.ndarray) -> np.ndarray:
        """What the words' postings add to each document."""
        found = self.postings.take(tb.spread(self.first[words], self.size[words]))
        return np.bincount(found.view(np.int32)[LOW::2], found.view(np.float32)[1 - LOW :: 2], self.n)

    def search(self, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, doc_ids, exact scores) of the group's top k of each query, without those below its `least`."""
        places, cut, column = self.asked.places, self.asked.cut, self.column
        bound = self.most[places]
        whole = np.add.reduceat(bound, cut[:-1])
        behind = np.add.reduceat(np.where(column[places] >= 0, bound, 0), cut[:-1])
        todo = np.flatnonzero((whole > 0) & (whole >= least * self.slack))
        todo = todo[np.argsort(behind[todo] / np.maximum(least[todo], 1e-9), kind="stable")]  # alike ones together
        found = [x for a in range(0, len(todo), TOGETHER) for x in self._some(todo[a : a + TOGETHER], least[todo[a : a + TOGETHER]], k)]
        if not found:
            return
        # of the documents found, the postings in the order of documents
        row = np.zeros(self.n + 1, np.int64)
        row[np.concatenate([doc for _, doc in found])] = 1
        at = np.flatnonzero(row.astype(bool)[self.docs])
        at = at[np.argsort(self.docs[at], kind="stable")]
        row = np.concatenate([[0], np.cumsum(np.bincount(self.docs[at], minlength=self.n))])
        word, tf = (np.searchsorted(self.first, at, "right") - 1).astype(np.int32), self.tf[at]
        mark = np.zeros(len(self.size), bool)
        for q, docs in found:
            own = places[cut[q] : cut[q + 1]]
            mark[own] = True
            size = row[docs + 1] - row[docs]
            at = tb.spread(row[docs], size)
            here = np.flatnonzero(mark[word[at]])
            mark[own] = False
            at = at[here]
            value = tf[at].astype(np.float64)
            value *= (K1 + 1) / (value + self.norm[np.repeat(docs, size)[here]])
            value *= self.asked.idf[word[at]]
            value, ends, best = value.tolist(), np.searchsorted(here, np.concatenate([[0], np.cumsum(size)])).tolist(), []
            for d, i, j in zip(self.to[docs].tolist(), ends[:-1], ends[1:], strict=True):
                score = math.fsum(value[i:j])  # the words' scores, rounded once
                if score > 0 and score >= least[q] * SLACK:
                    best += [(-score, x) for x in self.ids[self.of[d] : min(self.of[d] + k, self.of[d + 1])].tolist()]
            if best:
                best = sorted(best)[:k]
                yield q, np.array([x for _, x in best], np.int64), np.array([-x for x, _ in best])

    def _some(self, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, documents) that can be among the top k of each of some queries, by sums within `slack`."""
        first, count = self.asked.cut[queries], self.asked.cut[queries + 1] - self.asked.cut[queries]
        edge = (least * self.slack).astype(np.float32)
        own, of = self.asked.places[tb.spread(first, count)], np.repeat(np.arange(len(queries)), count)
        column = self.column[own]
        wanted = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        wanted[of[column >= 0], column[column >= 0]] = 1
        rare = (column < 0) & (self.size[own] > 0)
        words = np.split(own[rare], np.searchsorted(of[rare], np.arange(1, len(queries))))
        peak = wanted @ self.peak.T
        score = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        stay = np.zeros(score.shape, bool)
        bound = np.empty_like(self.own)
        for i, own in enumerate(words):
            score[i, : self.n] = self.seldom(own)
            np.minimum(self.own, peak[i][:, None], out=bound)
            bound += score[i].reshape(bound.shape)
            if edge[i] > 0:
                np.greater_equal(bound.ravel(), edge[i], out=stay[i])
            else:
                np.greater(bound.ravel(), 0, out=stay[i])
        # where many queries have documents that stay, blocks are completed for all of them at once
        many = np.flatnonzero([np.count_nonzero(x) > ALONE * self.n for x in stay])
        hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        if len(many):
            common = stay[many].reshape(len(many), self.blocks, BLOCK).any(axis=2).mean(axis=0) > ALONE
            ends = np.flatnonzero(np.diff(np.concatenate([[False], common, [False]])))
            for a, b in (ends.reshape(-1, 2) * BLOCK).tolist():
                for c in range(a, b, WIDE):
                    d = min(b, c + WIDE)
                    total = wanted[many] @ self.dense[c:d].T
                    total += score[many, c:d]
                    for j, i in enumerate(many.tolist()):
                        if edge[i] > 0:
                            at = np.flatnonzero(total[j] >= edge[i])
                        else:
                            at = np.flatnonzero(total[j])
                        if len(at):
                            hits[i].append((at + c, total[j, at]))
            stay[np.ix_(many, np.flatnonzero(np.repeat(common, BLOCK)))] = False
        for i, q in enumerate(queries.tolist()):
            at = np.flatnonzero(stay[i])
            if len(at):
                hits[i].append((at, score[i, at] + self.dense[at] @ wanted[i]))
            if not hits[i]:
                continue
            doc, total = (np.concatenate(x) for x in zip(*hits[i], strict=True))
            keep = total >= edge[i]
            if len(doc) > k:
                keep &= total >= np.partition(total, -k)[-k] * self.slack
            if keep.any():
                yield q, doc[keep]


def _search(shared, mean: float, k: int):
    names = ["ids", "copies", "words", "first", "docs", "tf", "lengths"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, ...]]]:
        rows, n, postings = [], 0, 0
        for batch in batches:
            for at in range(len(batch)):
                rows.append(tuple(batch.column(c)[at].as_py() for c in names))
                n, postings = n + len(rows[-1][1]) // 4, postings + int(np.frombuffer(rows[-1][3], "<i4")[-1])
                if n >= GROUP or postings >= GROUPED:
                    yield rows
                    rows, n, postings = [], 0, 0
        if rows:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        least = asked.least.copy()
        best = np.repeat(least[:, None], k, axis=1)  # the scores of this task's best, by query
        for rows in groups(batches):
            part, out = Group(rows, asked, mean), []
            for q, ids, score in part.search(least, k):
                out.append((np.full(len(ids), asked.names[q]), ids, score))
                best[q] = np.sort(np.concatenate([best[q], score]))[-k:]
                least[q] = best[q, 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "doc_id", "score"])

    return run


def _asked(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column("text")):
                of, word, _, _ = counted(texts, key)
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(texts.n + 1))
                words = pa.array([word[order[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), words, pa.array(np.diff(cut))], ["query_id", "words", "n"])

    return run


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each batch, by block."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        words = batch.column("words").to_pylist()
        for b in np.unique(block).tolist():
            own = np.unique(np.frombuffer(b"".join(words[i] for i in np.flatnonzero(block == b).tolist()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array(own)], ["block", "word"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their idf as bytes: 16 a word on the driver, not objects."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("word", "idf")], ["words", "idf"])


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the top k documents of each query.

    docs: doc_id, text. queries: doc_id (the query's id), text.
    """
    spark, key = docs.sparkSession, tb.new_key()
    plain = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    index = keep(by_batch(plain(docs), _segments(key), INDEX), "segments", "lot")
    whole = index.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    asked = keep(by_batch(plain(queries), _asked(key), "query_id long, words binary, n long").where("n > 0"), "queries")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not whole.n or not whole.total or not size.n:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    number, mean = whole.n, whole.total / whole.n
    blocks = max(-(-size.n // QUERIES), -(-size.terms // TERMS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    # the frequencies of the queries' words: at most one row for a word on one side, and for a word and block on the other
    df = by_batch(index.select("words", "first", "docs", "copies"), _frequencies, "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
    words = by_batch(dealt.select("block", "words"), _spelled, "block long, word long").distinct()
    idf = F.log1p((F.lit(number) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = keep(words.join(df.hint("merge"), "word").select("block", "word", idf.alias("idf")), "idf")
    hits = []
    for block in range(blocks):  # of about QUERIES queries, one after another: bounded on the driver and in each executor
        packed = by_batch(known.where(F.col("block") == block).select("word", "idf"), _packed, "words binary, idf binary").collect()
        value = Asked(dealt.where(F.col("block") == block).select("query_id", "words").collect(), *(np.frombuffer(b"".join(bytes(r[i]) for r in packed), t) for i, t in enumerate((np.uint64, np.float64))))
        del packed
        for lot in (0, 1):
            shared = spark.sparkContext.broadcast(value)
            part = keep(by_batch(index.where(F.col("lot") == lot).drop("lot", "n", "total"), _search(shared, mean, k), "query_id long, doc_id long, score double"), "hits")
            shared.unpersist()
            hits.append(part)
            if not lot:
                own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
                for r in part.withColumn("rank", F.row_number().over(own)).where(F.col("rank") == k).collect():  # a row for a query at most
                    value.least[np.searchsorted(value.names, r.query_id)] = r.score
    forget(index, asked, known)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.union, hits).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
