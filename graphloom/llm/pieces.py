"""SentencePiece encoding that keeps the place of every piece in the original text.

The model file's normaliser is followed step by step: at each place the longest prefix in
the compiled character map is replaced (a double-array trie and its table of strings),
white space is removed, collapsed and escaped as the file says, and for each byte that is
written the byte of the source that it comes from is recorded. So each piece, whose length
in normalised bytes is known, projects to a span of original bytes.

No piece of a usual vocabulary continues past a word's end, so the merges of one word can't
depend on its neighbours. Where besides the normaliser only escapes spaces, words are encoded
by the library once and remembered, with the source bytes of each of their pieces, and texts
are put together with numpy; a byte of such a text keeps its place, so the alignment is the
running sum of those bytes. Texts of other models, and texts that hold the mark itself, are
encoded as a whole and aligned character by character.

A null or empty text has no pieces. doc_id may be null; rows that repeat are encoded each;
other columns are not read. A text is one row in memory, with some 30 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .memory import Memory
from .workers import by_batch, hold

#: Words, with the spaces before them, that a worker remembers.
HELD = 750_000
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class CharMap:
    """The compiled character map: longest-prefix replacement by a double-array trie."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of data[at:], and that prefix's length."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        blob = open(path, "rb").read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        spec: dict[int, int | bytes] = {}
        for tag, value in fields(blob):
            if tag == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.kinds.append(piece.get(3, NORMAL))
            elif tag == 3:
                spec = dict(fields(value))
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.user = sorted((p.encode() for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        plain = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)]
        #: Whether words are independent, line ends stand alone, and the normaliser only escapes spaces.
        self.by_word = self.escape and not self.trim and self.prefix and not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain)
        self.by_line = self.by_word and not any("\n" in p for p in plain)
        self.simple = not self.map.units and not self.user and not self.trim and self.escape
        #: Bytes of normalised text that a piece stands for.
        self.width = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)])
        self.fast = self.by_word and self.simple and MARK in self.pieces
        self.marks = np.array([p.count(MARK) for p in self.pieces])
        self.strange = np.array([k == UNKNOWN for k in self.kinds])
        self.words = Memory(["u1", "<i4", "u1", "u1"], self.learn, HELD)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each byte of it, and its end, the offset of the source byte it comes from."""
        data, out, source = text.encode(), bytearray(), []
        mark = MARK.encode() if self.escape else b" "

        def write(chars: bytes, at: int) -> None:
            out.extend(chars)
            source.extend([at] * len(chars))

        at, space = 0, self.trim
        steps = []
        while at < len(data):
            known = next((u for u in self.user if data.startswith(u, at)), None)
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            chars, used = (known, len(known)) if known else self.map.longest(data, at) or (data[at : at + size], size)
            steps.append((chars, at, used))
            at += used
        if self.trim:
            while steps and steps[0][0].strip(b" ") == b"":
                steps.pop(0)
        if steps and self.prefix:
            write(mark, steps[0][1])
        for chars, at, used in steps:
            if self.trim and space:
                chars = chars.lstrip(b" ")
            if not chars:
                continue
            if used == len(chars) and chars == data[at : at + used]:  # unchanged: byte by byte
                for i, b in enumerate(chars):
                    write(mark if b == 32 else bytes([b]), at + i)
            else:
                write(chars.replace(b" ", mark), at)
            space = chars.endswith(b" ")
        end = len(data)
        if self.trim:
            while out.endswith(mark) and len(out) > 0:
                end = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return out.decode(errors="replace"), np.array([*source, end], np.int64)

    def learn(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of words with the spaces before them: ids as text with a comma after each, source bytes of
        each id, whether they decode to the word itself, and what they decode to otherwise."""
        own = [w.decode() for w in words]
        parts = [w.replace(" ", MARK) for w in own]
        # the library puts a mark before what it is given; a part without one is asked for after a line end
        bare = [p[0] != MARK for p in parts]
        asked = ["\n" + p if b else p[1:] for p, b in zip(parts, bare, strict=True)]
        made = [ids[2 * b :] for ids, b in zip(self.library.encode(asked, num_threads=1), bare, strict=True)]
        # and its decoding drops the space of a leading mark, which stays inside a text
        decoded = [t if b else " " + t for t, b in zip(self.library.decode(made), bare, strict=True)]
        spelled = [(str(ids)[1:-1].replace(" ", "") + ",").encode() if ids else b"" for ids in made]
        other = [b"" if t == w else t.encode() for t, w in zip(decoded, own, strict=True)]
        count = lambda lists: np.fromiter(map(len, lists), np.int64, len(lists))
        same = np.array([t == w for t, w in zip(decoded, own, strict=True)], np.uint8)
        return [
            (np.frombuffer(b"".join(spelled), np.uint8), count(spelled)),
            (np.frombuffer(self.widths(parts, made, bare), "<i4"), count(made)),
            (same, np.ones(len(words), np.int64)),
            (np.frombuffer(b"".join(other), np.uint8), count(other)),
        ]

    def widths(self, parts: list[str], made: list[list[int]], bare: list[bool]) -> bytes:
        """Bytes of source, where a mark is a space, that each id of each part stands for, as 32-bit integers."""
        flat = np.array([i for ids in made for i in ids], np.int64)
        width, at = self.width[flat] - (len(MARK.encode()) - 1) * self.marks[flat], 0
        if self.strange[flat].any():  # an unknown piece stands for the characters up to the next piece
            for part, ids, b in zip(parts, made, bare, strict=True):
                if self.strange[ids].any():
                    known = self.library.encode("\n" + part if b else part[1:], out_type=str)[2 * b :]
                    width[at : at + len(ids)] = [1 if self.kinds[i] == BYTE else len(p.replace(MARK, " ").encode()) for i, p in zip(ids, known, strict=True)]
                at += len(ids)
        return width.astype("<i4").tobytes()

    def units(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, tb.Texts]:
        """Starts, ends and texts of words with the spaces before them, in the texts with a space put before each.

        Spaces at the end of a text go with its last word. Line ends stand alone where the model has no piece that holds one.
        """
        n = len(texts.data)
        some = np.diff(texts.at) > 0
        at = texts.at + np.concatenate([[0], np.cumsum(some)])
        data = np.full(int(at[-1]), 32, np.uint8)
        data[np.arange(n) + np.repeat(np.cumsum(some), np.diff(texts.at))] = texts.data
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.by_line:
            line = data == 10
            first[1:] |= (line[1:] & ~space[:-1]) | (line[:-1] & ~space[1:])
        head = at[:-1][some]
        first[head] = True
        begin = np.flatnonzero(first)
        of = np.searchsorted(at, begin, "right") - 1
        stop = np.append(begin[1:], len(data))
        # a run of spaces up to the text's end, unless it is all of the text
        filled = np.concatenate([[0], np.cumsum(~space)])
        keep = (filled[stop] > filled[begin]) | (begin == at[of])
        begin, of = begin[keep], of[keep]
        return begin, np.append(begin[1:], len(data)), of, tb.Texts(data, at)

    def summed(self, texts: tb.Texts) -> list[tuple[int, str, str, str]]:
        """Of each text: the number of ids, and the sha256 of the ids joined by commas, of the decoded text, and
        of the places in the text's bytes where pieces begin and the last one ends.

        Each other piece ends where the next one begins. The places are little-endian 32-bit integers.
        """
        raw = texts.data.tobytes()
        if not self.fast or MARK.encode() in raw:
            if texts.n > 1:
                return [row for i in range(texts.n) for row in self.summed(tb.Texts(texts.data[texts.at[i] : texts.at[i + 1]], texts.at[i : i + 2] - texts.at[i]))]
            ids, begin, end = self.spans(raw.decode())
            spelled, edges = ",".join(map(str, ids)), np.append(begin, end[-1:]).astype("<i4")
            return [(len(ids), *(hashlib.sha256(x).hexdigest() for x in (spelled.encode(), self.library.decode(ids).encode(), edges)))]
        begin, stop, of, spaced = self.units(texts)
        (spelled, long), (width, count), (same, _), (other, size) = self.words.look(spaced, begin, stop)
        first = np.searchsorted(of, np.arange(texts.n + 1))  # words by text
        to_spelled, to_width, to_other = (np.concatenate([[0], np.cumsum(x)]) for x in (long, count, size))
        text_width = to_width[first]
        running = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        edges = np.zeros(len(width) + texts.n, "<i4")
        tokens = np.diff(text_width)
        own = np.repeat(np.arange(texts.n), tokens)
        # the first mark is of no byte
        edges[np.arange(len(width)) + own + 1] = running[1:] - running[text_width[:-1]][own] - 1
        strange = np.add.reduceat(np.append(1 - same.astype(np.int64), 0), first[:-1]) * (np.diff(first) > 0) if len(of) else np.zeros(texts.n, np.int64)
        out, view = [], spelled.data
        places = zip(tokens.tolist(), to_spelled[first].tolist()[:-1], to_spelled[first].tolist()[1:], text_width.tolist(), texts.at.tolist()[:-1], texts.at.tolist()[1:], strict=False)
        for i, (n, a, b, w, low, high) in enumerate(places):
            decoded = raw[low:high]
            if strange[i]:
                decoded = b"".join(other[to_other[j] : to_other[j + 1]].tobytes() if not same[j] else spaced.data[begin[j] : stop[j]].tobytes() for j in range(first[i], first[i + 1]))
                decoded = decoded[1:] if decoded.startswith(b" ") else decoded
            sums = (view[a : max(a, b - 1)], decoded, edges[w + i : w + i + n + 1 if n else w + i])
            out.append((n, *(hashlib.sha256(x).hexdigest() for x in sums)))
        return out

    def spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """ids and, of each, the begin and end of its bytes in the text; together they cover it in order."""
        normal, source = self.normalise(text)
        ids = self.library.encode(text)
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        if any(self.kinds[i] == UNKNOWN for i in ids):  # an unknown piece stands for the characters up to the next piece
            normal_pieces = self.library.encode(text, out_type=str)
            width = np.array([1 if self.kinds[i] == BYTE else len(p.encode()) for i, p in zip(ids, normal_pieces, strict=True)])
        end = np.cumsum(width)
        return ids, source[end - width], source[end]


def _encoder(path: str) -> Encoder:
    return hold(f"pieces of {path}", lambda: Encoder(path))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and `begins` and `ends`, the original byte span of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                some = batch.slice(a, 64)
                rows = [_encoder(model).spans(t or "") for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2))], ["doc_id", "ids", "begins", "ends"]
                )

    return by_batch(_source(docs), run, "doc_id long, ids array<int>, begins array<long>, ends array<long>", caches=True)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256, without keeping the ids and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tb.pieces(batch.column("text")):
                rows = zip(*_encoder(model).summed(texts), strict=True)
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))], names)

    return by_batch(_source(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", caches=True)
