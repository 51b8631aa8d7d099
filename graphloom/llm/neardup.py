"""Near-duplicates of texts by word-shingle similarity, exact after the candidate search.

1. One pass over the text gives each document its set's size, a 128-bit digest of the set
   and the bands of a SuperMinHash signature. Documents with one digest are one class.
2. Classes that share a band are candidates. In each band's bucket every class is tested
   against the bucket's least class, on full sets.
3. Where classes of a bucket still lie in several components, all of its pairs between
   components are tested, in tiles of bounded size; only true links leave a tile. So no
   pair of candidates goes untested, and no list of all pairs is ever made.
4. Components by union-find and star rounds.

With 32 bands of 4 rows a link at similarity 0.8 stays unseen with probability
(1 - 0.8**4)**32 = 5e-8.

Words are hashed to 64 bits under a secret of the job, so no text can be made to share a word
that it doesn't have; by chance two texts of 20,000 words share one with a probability of
2e-11, and two sets one digest with 2e-38 (they are then one class).

Rows that share a doc_id are one document. A null or wordless text has an empty set and is
linked with nothing. A row without doc_id takes part in no link; its component_id is null
and it is kept. Of ties the least doc_id leads. An empty table gives no rows; other columns
aren't read. A text, and its set, is held whole; no more than a tile of sets is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components, forest
from .deal import dealt
from .store import forget, keep
from .workers import by_batch, numbered
from .superminhash import bands, signatures

SLOTS, ROWS = 128, 4
#: Classes, and bytes of their sets, on each side of a tile.
TILE, TILE_BYTES = 1024, 16 << 20
#: Bits of the filter that keeps texts without candidates out of the shuffle: 16 for each candidate
#: within these bounds. It is broadcast, 64 bits a row, so it takes 4 MB at most.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


def _features(k: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column("text")):
                start, end, of = texts.words()
                value, of = tb.shingles(texts.hashes(start, end, True, key), of, texts.n, k)
                size = np.bincount(of, minlength=texts.n)
                cut = np.concatenate([[0], np.cumsum(size)])
                digest = []
                for salt in (1, 2):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(tb.mix(value * np.uint64(2 * salt + 1) + np.uint64(key >> salt)), dtype=np.uint64, out=total[1:])
                    digest.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                keys = bands(signatures(value, of, texts.n, SLOTS), ROWS).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(texts.n + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(size, pa.int64()), *map(pa.array, digest), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return run


def _sets(k: int, key: int):
    """Rows of one doc_id follow each other; of its equal sets one is returned."""
    digest = lambda made: hashlib.blake2b(made, digest_size=32).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        had: set[bytes] = set()  # digests of the sets of `last`, from its second row on

        def new(id: int, made: bytes) -> bool:
            nonlocal last, first
            if id != last:
                last, first = id, made
                had.clear()
                return True
            if not had:
                had.add(digest(first))
            before = len(had)
            had.add(digest(made))
            return len(had) > before

        for batch in batches:
            for a, b, texts in tb.pieces(batch.column("text")):
                start, end, of = texts.words()
                value, of = tb.shingles(texts.hashes(start, end, True, key), of, texts.n, k)
                cut = np.searchsorted(of, np.arange(texts.n + 1))
                ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                rows = [(id, made) for id, i, j in zip(ids, cut[:-1], cut[1:], strict=True) if new(id, made := np.sort(value[i:j]).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["rep", "set"])

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of distinct values."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    values = np.intersect1d(*(np.unique(v) for v, _ in sides), assume_unique=True)
    placed = []
    for v, row in sides:
        at = np.minimum(np.searchsorted(values, v), max(0, len(values) - 1))
        there = values[at] == v if len(values) else np.zeros(len(v), bool)
        placed.append((at[there], row[there]))
    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(values), 4096):  # columns at a time: bounded memory
        block = []
        for (at, row), s in zip(placed, (left, right), strict=True):
            here = (at >= low) & (at < low + 4096)
            m = np.zeros((len(s), min(4096, len(values) - low)), np.float32)
            m[row[here], at[here] - low] = 1
            block.append(m)
        total += block[0] @ block[1].T
    return total


def _tiles(share: Fraction):
    """Rows of a tile follow each other. side 0 is tested against side 1; side 2 stands on both sides."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
        if not left or not right:
            return []
        one, two = [[np.frombuffer(r[3], np.uint64) for r in s] for s in (left, right)]
        both = _shared(one, two).astype(np.int64)
        union = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two]) - both
        near = (share.denominator * both >= share.numerator * union) & (np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right]))
        return [(max(u, v), min(u, v)) for i, j in zip(*np.nonzero(near), strict=True) if (u := left[i][1]) != (v := right[j][1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def out() -> pa.RecordBatch:
            found = sorted(set(links(rows)))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(names)) if names[i].startswith("t_")), strict=True))
            rest = zip(*(batch.column(c).to_pylist() for c in ("side", "rep", "comp", "set")), strict=True)
            for key, row in zip(keys, rest, strict=True):
                if key != tile:
                    if rows:
                        yield out()
                    tile, rows = key, []
                rows.append(row)
        if rows:
            yield out()

    return run


def _test(rows: DataFrame, share: Fraction) -> DataFrame:
    """Of the links of all tiles a forest for each task. rows: t_1, t_2, t_3, side, rep, comp, set."""
    keys, tiles = [c for c in rows.columns if c.startswith("t_")], _tiles(share)
    return by_batch(rows.repartition(*keys).sortWithinPartitions(*keys), lambda batches: forest(tiles(batches)), "u long, v long")


def _blocks(n: str, size: str) -> Column:
    """Parts into which the classes of a bucket are dealt, from their number and their sets' bytes."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / TILE), F.ceil(F.col(size) / TILE_BYTES)).cast("long")


def _marked(source: DataFrame, id: str, ids: DataFrame) -> DataFrame:
    """source with a column `may`: whether the row's id may be among ids (`rep`), by a one-hash Bloom filter.

    So the other rows' texts need no shuffle.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * ids.count()).bit_length()))
    place = lambda id: f"pmod(xxhash64({id}), {bits})"
    bit = lambda id: f"shiftleft(1L, cast({place(id)} & 63 as int))"
    held = ids.select(F.expr(f"{place('rep')} div 64").alias("word"), F.expr(bit("rep")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = source.join(F.broadcast(held), F.expr(f"{place(id)} div 64 = word"), "left")
    return found.withColumn("may", F.coalesce(F.expr(f"{id} is not null and bits & {bit(id)} <> 0"), F.lit(False))).drop("word", "bits")


def groups(docs: DataFrame, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text).

    words: of a shingle (lower-cased A-Z); shorter texts are one shingle. similarity: the
    least Jaccard similarity of a link, as an exact decimal.
    """
    share, key = Fraction(similarity), tb.new_key()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = keep(by_batch(source, _features(words, key), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "features")
    real = seen.where("doc_id is not null and n_shingles > 0")
    lead = F.min(F.struct("doc_id", "n_shingles", "bands"))  # bands follow from the set
    classes = keep(real.groupBy("d1", "d2").agg(lead.alias("lead"), F.count("*").alias("copies")).select("d1", "d2", "copies", F.col("lead.doc_id").alias("rep"), (8 * F.col("lead.n_shingles")).alias("size"), "lead.bands"), "classes")

    # buckets of classes that share a band
    spread = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    pivot = keep(spread.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "pivots")
    total = classes.count() * (SLOTS // ROWS)
    member = keep(dealt(spread, pivot, ["bucket"], "n", total, once=True).where("rep <> pivot").select("bucket", "pivot", "rep", "size"), "buckets")

    # full sets of all candidates
    ids = keep(member.select("rep").union(member.select("pivot")).distinct(), "candidates")
    wanted = _marked(source, "doc_id", ids).where("may").select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == ids.rep, "left_semi")
    sets = keep(by_batch(wanted.sortWithinPartitions("doc_id"), _sets(words, key), "rep long, set binary"), "sets")

    # every candidate against the least class of its bucket, a tile at a time
    star = keep(member.select("pivot", "rep", "size").distinct(), "star")
    sized = keep(star.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("pivot", "n", _blocks("n", "bytes").alias("b")), "heads")
    part = F.pmod(F.xxhash64("rep"), F.col("b"))
    tiled = dealt(star, sized, ["pivot"], "n", star.count()).select(F.col("pivot").alias("t_1"), part.alias("t_2"), F.lit(1).alias("side"), "rep", F.lit(1).alias("comp"))
    heads = sized.select(F.col("pivot").alias("t_1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("t_2"), F.lit(0).alias("side"), F.col("pivot").alias("rep"), F.lit(0).alias("comp"))
    near = keep(_test(tiled.union(heads).join(sets.hint("merge"), "rep"), share), "links")
    # rows of one doc_id in several classes tie these
    twice = real.groupBy("doc_id").agg(F.min("d1").alias("a1"), F.max("d1").alias("b1"), F.min("d2").alias("a2"), F.max("d2").alias("b2")).where("a1 <> b1 or a2 <> b2").select("doc_id")
    split = keep(real.select("doc_id", "d1", "d2").join(twice.hint("merge"), "doc_id", "left_semi"), "torn")
    first = near
    if n := split.count():
        first = near.union(dealt(split, classes.select("d1", "d2", "copies", "rep"), ["d1", "d2"], "copies", n).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    comp = components(first)

    # buckets that still hold several components: all their pairs, in tiles
    known = keep(member.select("bucket", "rep", "size").join(comp.hint("merge"), member.rep == comp.u, "left").select("bucket", "rep", "size", F.coalesce("root", "rep").alias("comp")), "known")
    mixed = known.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("low <> high")
    mixed = keep(mixed.select("bucket", "n", _blocks("n", "bytes").alias("b")), "mixed")
    left = dealt(known, mixed, ["bucket"], "n", known.count()).select("bucket", "rep", "comp", "b").join(sets.hint("merge"), "rep").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("b")))
    tile = left.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("other"))
    rows = tile.select(
        F.col("bucket").alias("t_1"), F.least("mine", "other").alias("t_2"), F.greatest("mine", "other").alias("t_3"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "rep", "comp", "set",
    )
    more = keep(_test(rows, share), "links")
    whole = components(comp.toDF("u", "v").union(more))

    # back to the rows, by class
    told = classes.join(whole.hint("merge"), classes.rep == whole.u, "left").where("copies > 1 or root is not null")
    told = keep(told.select("d1", "d2", "copies", F.coalesce("root", "rep").alias("root")), "told")
    forget(classes, pivot, member, ids, sets, star, sized, split, near, comp, known, mixed, more, whole)
    rows = seen.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), F.when(F.col("doc_id").isNotNull(), F.col("d2")).alias("d2"))
    component = F.coalesce("root", "doc_id")
    return dealt(rows, told, ["d1", "d2"], "copies", seen.count(), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_each(docs: DataFrame, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """The rows of docs, with its columns, without all but one document of each group.

    Of rows that repeat a doc_id any one stays; rows without doc_id all stay. Columns of docs
    may have any name; more than one `text` or `doc_id` is an error.
    """
    rows, place = numbered(docs)
    id, text = (place[docs.columns.index(c)] for c in ("doc_id", "text"))
    named = keep(groups(rows.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, similarity).select("doc_id", "kept"), "named")
    marks = named.where("doc_id is not null").groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("n"), F.min("kept").alias("kept"))
    marks = keep(marks.where("n > 1 or not kept"), "marks")
    told = _marked(rows.withColumn("rep", F.col(id).cast("long")), "rep", marks)
    stay = dealt(told.where("may").drop("may"), marks, ["rep"], "n", named.count(), "left").where("coalesce(kept, true)")
    made = told.where("not may").select(*place)
    if marks.where("kept").isEmpty():  # no doc_id that stays is repeated
        return made.union(stay.select(*place)).toDF(*docs.columns)
    return made.union(stay.where("n is null").select(*place)).union(stay.where("n is not null").dropDuplicates(["rep"]).select(*place)).toDF(*docs.columns)
