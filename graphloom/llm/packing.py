"""Packing of tokenised documents into sequences of fixed length.

Only documents longer than a sequence are cut. What has to be packed is then a histogram:
at most `capacity` lengths with their counts, of the same size for any corpus. Bin
completion works on it: the longest remaining piece opens a sequence, the undominated
fillings of the rest of it are searched depth first, longer pieces first, and a branch
ends where its waste can't fall below the best filling so far, which best fit gives to
begin with. The filling found is used for as many sequences as the counts allow, so the
plan, too, is bounded by the number of lengths. Pieces find their place in the plan by
their rank among the pieces of their length.

A null text is empty: its document is the end mark alone. Rows that repeat are packed each
on their own; ties of length go by doc_id, piece and checksum. doc_id may be null; an empty
table gives no rows; other columns aren't read. A text is held whole, with some 40 bytes for
each of its words.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbatch as tb
from .memory import Memory
from .store import keep
from .workers import by_batch, hold

#: Words, and parts of words, that a worker remembers.
HELD = 1_000_000
PARTS_HELD = 250_000
#: Bytes of text that are encoded at once.
PIECE = 1 << 20
#: Pieces in each of the parts by which those of one length are ranked, on average over all lengths, and the fewest parts.
PART, PARTS = 1 << 20, 64


#: Bytes that keep a word whole, and kinds of the others: letters 1, digits 2, signs 0.
_ODD = np.zeros(256, np.int8)
_ODD[[*b"'<", *range(128, 256)]] = 1
_KIND = np.zeros(256, np.int8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2


class WordCoder:
    """ids of whole texts by a tokenizers file, remembered word by word.

    Sound where the tokenizer drops white space, splits at it and has no state across
    words. Words of plain characters are split by the file's own rule here; every other
    word goes through the library as it is.
    """

    #: Printable ASCII and composed Latin letters whose lower case is one such letter.
    PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ňŊ-ž]+")
    #: The file's split rule, for lower-cased words of those.
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # one tokenizer in two states: as in the file, and with bare splitting for words split here
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(last)
        self.parts: dict[str, bytes] = {}
        self.words = Memory(["<u4"], self.learn, HELD)

    def state(self, state: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = state

    def learn(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids of all words, and the number of ids of each."""
        if len(self.parts) > PARTS_HELD:
            self.parts.clear()
        single, plain, odd = [], {}, []
        for i, w in enumerate(words):
            if w.islower() and w.isalpha():  # bytes: ASCII letters alone
                single.append(i)
                continue
            # '<|' may begin a special token, which the library finds before anything else
            text = w.decode()
            if self.PLAIN.fullmatch(text) and "<|" not in text:
                plain[i] = self.SPLIT.findall(text.lower())
            else:
                odd.append(i)
        made = [b""] * len(words)
        self.state(self.bare)
        for i, ids in zip(single, self.ids([words[i].decode() for i in single]), strict=True):
            made[i] = ids
        new = list({p for parts in plain.values() for p in parts} - self.parts.keys())
        self.parts.update(zip(new, self.ids(new), strict=True))
        get = self.parts.__getitem__
        for i, parts in plain.items():
            made[i] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))
        self.state(self.whole)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i].decode() for i in odd], add_special_tokens=False), strict=True):
            made[i] = np.array(e.ids, "<u4").tobytes()
        return [(np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4)]

    def ids(self, parts: list[str]) -> Iterator[bytes]:
        """ids of each part, in the state of bare splitting."""
        for a in range(0, len(parts), 20_000):
            some = parts[a : a + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            assert len(cut) == len(some)
            raw, low = ids.tobytes(), 0
            for high in (4 * cut).tolist():
                yield raw[low:high]
                low = high

    @staticmethod
    def units(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, tb.Texts]:
        """Starts, ends and texts of what is encoded on its own, and the texts in which it stands.

        A word of ASCII letters, digits and signs is lower-cased and split by the file's rule
        here, where runs of letters or signs, and single digits, are the parts. A word with
        an apostrophe (contractions), with `<` (special tokens) or with other letters is one unit.
        """
        start, end, of = texts.words()
        if not len(start):
            return start, end, of, texts
        data, n = texts.data, len(texts.data)
        odd = np.zeros(n + 1, np.int32)
        np.cumsum(_ODD[data], out=odd[1:])
        edge = np.zeros(n + 1, np.int8)
        plain = odd[end] == odd[start]
        edge[start[plain]] += 1
        edge[end[plain]] -= 1
        inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        kind = _KIND[data]
        first = inside.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first[start] = True
        begin = np.flatnonzero(first)
        word = np.searchsorted(start, begin, "right") - 1
        stop = end[word]
        stop[:-1] = np.minimum(stop[:-1], begin[1:])
        return begin, stop, of[word], tb.Texts(np.where(inside, tb.LOWER[data], data), texts.at)

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, end to end, and the n + 1 places where one ends and the next begins."""
        start, end, of, texts = self.units(texts)
        ((ids, size),) = self.words.look(texts, start, end)
        stop = np.concatenate([[0], np.cumsum(size)])
        return ids, stop[np.searchsorted(of, np.arange(texts.n + 1))]


def _cut(path: str, end: int, capacity: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = hold(f"words of {path}", lambda: WordCoder(path))
        mark, step = np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for low, high, texts in tb.pieces(batch.column("text"), PIECE):
                names = batch.column("doc_id").slice(low, high - low).to_pylist()
                rows = []
                found, ends = coder.encode(texts)
                for name, a, b in zip(names, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    made = found[a:b].tobytes() + mark
                    for piece, at in enumerate(range(0, len(made), step)):
                        part = made[at : at + step]
                        rows.append((name, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if ids else [])))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    return run


def cut(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, on request, ids.

    tokenizer: path of a tokenizers file, present on every executor. end: the id after each document.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return by_batch(source, _cut(tokenizer, end, capacity, ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids, caches=True)


#: Nodes that the search for one filling visits at most; without bound it may take exponential time.
EFFORT = 400


def fill(room: int, sizes: list[int], left: dict[int, int], effort: int | None = EFFORT) -> tuple[int, ...]:
    """The filling of `room` with the least waste, longest pieces first among equals.

    sizes: the available lengths, descending. effort: nodes to visit at most (None: all); the
    incumbent, best fit decreasing to begin with, is then used, and made undominated.
    """
    start = room
    negative = [-s for s in sizes]

    def best_fit(room: int) -> list[int]:
        chosen, used = [], {}
        at = bisect.bisect_left(negative, -room)
        while at < len(sizes) and room:
            s = sizes[at]
            take = min(room // s, left[s] - used.get(s, 0))
            chosen += [s] * take
            used[s] = used.get(s, 0) + take
            room -= take * s
            at = max(at + 1, bisect.bisect_left(negative, -room))
        return chosen

    best = best_fit(room)
    waste = room - sum(best)
    nodes = 0
    stack: list[int] = []

    def search(at: int, room: int) -> None:
        nonlocal best, waste, nodes
        if room < waste:
            best, waste = list(stack), room
        at = max(at, bisect.bisect_left(negative, -room))
        low = sizes[-1] if sizes else 0
        while at < len(sizes) and waste and (effort is None or nodes < effort):
            s = sizes[at]
            at += 1
            if stack.count(s) < left[s]:
                nodes += 1
                stack.append(s)
                search(at - 1, room - s)
                stack.pop()
                if room - s < low:
                    # nothing fits beside s: it dominates the shorter pieces of which that is true, too
                    at = bisect.bisect_left(negative, low - room)

    if waste:
        search(0, room)
    return undominated(best, start, sizes, left) if waste else tuple(best)


def undominated(chosen: list[int], room: int, sizes: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """A filling that no exchange of a piece for a longer one, or piece put in besides, improves.

    Such an exchange leaves the shorter piece for later, so the filling it leads to dominates
    the one before. The best of a search that wasn't cut off has none.
    """
    chosen, waste = sorted(chosen, reverse=True), room - sum(chosen)
    used: dict[int, int] = {}
    for s in chosen:
        used[s] = used.get(s, 0) + 1
    negative = [-s for s in sizes]
    again = True
    while again and waste:
        again = False
        for out in (0, *dict.fromkeys(reversed(chosen))):
            # the longest piece that has room in the place of `out`, and is longer
            at = bisect.bisect_left(negative, -(out + waste))
            while at < len(sizes) and sizes[at] > out and used.get(sizes[at], 0) >= left[sizes[at]]:
                at += 1
            if at < len(sizes) and sizes[at] > out:
                if out:
                    chosen.remove(out)
                    used[out] -= 1
                bisect.insort(chosen, sizes[at], key=lambda s: -s)
                used[sizes[at]] = used.get(sizes[at], 0) + 1
                waste -= sizes[at] - out
                again = True
                break
    return tuple(chosen)


def best_fit(counts: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """The same as `plan`, by best fit decreasing."""
    rooms: list[int] = []
    held: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room, fillings and how many sequences have them

    def put(room: int, chosen: tuple[int, ...], times: int) -> None:
        if room not in held:
            bisect.insort(rooms, room)
        held.setdefault(room, []).append((chosen, times))

    for s in sorted((s for s in counts if counts[s]), reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                put(capacity, (), -(-n // (capacity // s)))
                continue
            room = rooms[at]
            # the fullest sequence that has room for one takes all it can
            chosen, times = held[room].pop()
            if not held[room]:
                del held[room], rooms[at]
            each = min(room // s, n)
            some = min(times, n // each)
            put(room - each * s, (*chosen, *[s] * each), some)
            if times > some:
                put(room, chosen, times - some)
            n -= some * each
    return [x for room in rooms for x in held[room]]


def plan(counts: dict[int, int], capacity: int = 4096, effort: int | None = EFFORT) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many sequences use each, for pieces of the given lengths.

    A best-fit packing of the whole is the incumbent: it is kept where it needs fewer sequences.
    """
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left, reverse=True)
    made = []
    while sizes:
        longest = sizes[0]
        left[longest] -= 1
        rest = [s for s in sizes if left[s]]
        chosen = (longest, *fill(capacity - longest, rest, left, effort))
        left[longest] += 1
        need: dict[int, int] = {}
        for s in chosen:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        made.append((chosen, times))
        sizes = [s for s in sizes if left[s]]
    return min(made, best_fit(counts, capacity), key=lambda m: sum(times for _, times in m))


def _assign(made: list[tuple[tuple[int, ...], int]]):
    """Places by (length, rank), from a plan."""
    keys, bases, offsets, given, base = [], [], [], {}, 0
    for chosen, times in made:
        offset = 0
        for s in chosen:
            keys.append((s << 44) + given.get(s, 0))
            bases.append(base - given.get(s, 0))
            offsets.append(offset)
            given[s] = given.get(s, 0) + times
            offset += s
        base += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    table = [np.array(x, np.int64)[order] for x in (keys, bases, offsets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(table[0], (length << 44) + rank, "right") - 1
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rank + table[1][at]), pa.array(table[2][at])], [*names, "sequence_id", "offset"])

    return run


def place(pieces: DataFrame, capacity: int = 4096, effort: int | None = EFFORT) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with doc_id, piece, length and ids_crc32."""
    parts = max(PARTS, pieces.count() // PART)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    dealt = pieces.withColumn("part", part)
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most capacity * parts rows
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("own") + F.col("before")).cast("long").alias("rank"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return by_batch(ranked, _assign(plan(counts, capacity, effort)), schema)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(keep(cut(docs, tokenizer, end, capacity, ids), "pieces"), capacity)
