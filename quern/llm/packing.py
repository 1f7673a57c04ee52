"""Best-fit vector packing of tokenised documents into sequences.

A piece is a vector (tokens, documents, attention cost = tokens squared); a
sequence has a capacity in each. Pieces go longest first into the open sequence
whose weighted residual norm is least after it, under every constraint. Only a
piece's length matters, so the plan is made on the histogram of lengths, at most
`capacity` rows, with runs of like sequences handled at once; the pieces
then find their places by their rank among pieces of their length. The driver
holds the histogram and the plan, never the pieces.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
import re
import string
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.words import BUFFER, inverse, mix, powers

#: Entries of a worker's memory of units; it is emptied when full.
CACHE = 1_000_000
_DOUBLE_SPACE = re.compile(r"\s\s")
_U = np.uint64
#: Between texts; UTF-8 has no such byte.
_EDGE = 0xFF
_LETTER, _MARK, _SPLIT = (np.isin(np.arange(256), list(chars)) for chars in (string.ascii_letters.encode(), b"!#$%&()*+,-./:;<=>?@[]^_{|}~", [0x20, 0x0A, _EDGE]))
#: Two numbers for each byte, so that two hashes tell units apart by 128 bits.
_CODES = [np.where(_SPLIT, _U(0), mix(mix(np.arange(1, 257, dtype=_U)) + _U(salt))) for salt in (1, 2)]
#: A run of letters, a blank before it or none: one match of the splitter. How the model's vocabulary writes a blank and the bytes of such letters.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
_SHOWN = {0x20: 0x120} | {b: 0x122 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 0x143}
_BASE = _U(0x9E3779B97F4A7C15)
#: Kinds of units: after a blank, after a line feed, all others.
_BLANK, _FEED, _BARE = range(3)


def units(buffer: bytes) -> tuple[np.ndarray, ...]:
    """(start, end, kind, name, check) of the units of texts that stand between edges; name and check are two hashes of kind and bytes.

    A unit is what stands between single blanks and line feeds, and is cut where a mark follows an ASCII letter: no match of the splitter goes on there.
    """
    data = np.frombuffer(buffer, np.uint8)
    split = _SPLIT[data]
    at = np.flatnonzero(split[:-1] | np.concatenate((_LETTER[data[:-2]] & _MARK[data[1:-1]], [False])))
    # a blank, feed or edge stands before its unit, the letter before a mark belongs to the unit before
    start, parted = at + 1, ~split[at]
    before = data[at]
    kind = np.where(parted, _BARE, np.where(before == 0x20, _BLANK, np.where(before == 0x0A, _FEED, _BARE)))
    end = np.append(start[1:] - ~parted[1:], len(data) - 1)
    salt = (end - start).astype(_U) * _U(4) + kind.astype(_U)
    power, back = powers(_BASE, len(data)), powers(inverse(_BASE), len(data))[start]
    name, check = (mix(np.add.reduceat(codes[data] * power, start) * back + salt) for codes in _CODES)
    return start, end, kind, name | _U(1), check


class Memory:
    """Ids of units by name and check, in a table of open places. Units of one name but another check are told by -2, unknown ones by -1."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.count, self.used, self.bits = 0, 0, 12
        self.name, self.check = np.zeros((2, 1 << self.bits), _U)
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.first, self.ids = np.zeros(1024, np.int64), np.zeros(1 << 14, "<u4")

    def find(self, name: np.ndarray, check: np.ndarray) -> np.ndarray:
        at = (name >> _U(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero((self.name[at] != name) & (self.name[at] != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.name[at[left]]
            left = left[(found != name[left]) & (found != 0)]
        return np.where(self.name[at] == 0, -1, np.where(self.check[at] == check, self.entry[at], -2))

    def add(self, name: np.ndarray, check: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Distinct unknown names; the ids of all, one after the other."""
        n = self.count + len(name)
        while 2 * n > 1 << self.bits:
            self.bits += 1
            full = np.flatnonzero(self.name)
            old = self.name[full], self.check[full], self.entry[full]
            self.name, self.check = np.zeros((2, 1 << self.bits), _U)
            self.entry = np.zeros(1 << self.bits, np.int32)
            self._put(*old)
        self._put(name, check, np.arange(self.count, n, dtype=np.int32))
        if n >= len(self.first):
            self.first = np.concatenate((self.first, np.zeros(n, np.int64)))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(self.used + len(ids), "<u4")))
        self.first[self.count + 1 : n + 1] = self.used + np.cumsum(lengths)
        self.ids[self.used : self.used + len(ids)] = ids
        self.count, self.used = n, self.used + len(ids)

    def _put(self, name: np.ndarray, check: np.ndarray, entry: np.ndarray) -> None:
        at = (name >> _U(64 - self.bits)).astype(np.int64)
        left = np.arange(len(name))
        while len(left):
            free = left[self.name[at[left]] == 0]
            self.name[at[free]] = name[free]  # of several at one place the last one stays, the others go on
            left = left[self.name[at[left]] != name[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.check[at], self.entry[at] = check, entry


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, .. of each, n of them, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary's splitter never joins what a single blank or line feed between two other
    characters separates, nor an ASCII letter with a mark after it, so the units between are encoded once and remembered;
    texts with other white space go through the tokenizer whole. Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.known, self.merged = Memory(), self.tokenizer.model.tokenize
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def direct(self, texts: list[str]) -> list[bytes]:
        ids = [array.array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for a in ids:
                a.byteswap()
        return [a.tobytes() for a in ids]

    def apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, all ids) of words without line feeds, each by itself. Letters go to the model at once, which spares the splitter's time."""
        found: list[list[int] | None] = [[t.id for t in self.merged(w.decode("latin-1").translate(_SHOWN))] if _LETTERS.fullmatch(w) else None for w in words]
        left = [i for i, ids in enumerate(found) if ids is None]
        for lo in range(0, len(left), 32):  # many are encoded as one text, a line each; the feed's id marks where one ends
            some = left[lo : lo + 32]
            ids = self.tokenizer.encode_batch_fast([b"\n".join([*(words[i] for i in some), b""]).decode()], add_special_tokens=False)[0].ids  # without offsets, which cost time
            if ids.count(self.feed) != len(some):
                raise ValueError("the vocabulary joins line feeds with words")
            last = 0
            for i in some:
                end = ids.index(self.feed, last)
                found[i], last = ids[last:end], end + 1
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(itertools.chain.from_iterable(found), "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if not t or t[0].isspace() or t[-1].isspace() or _DOUBLE_SPACE.search(t):
                (out[i],) = self.direct([t])
                continue
            held.append((i, t.encode()))
            size += len(held[-1][1])
            if size > BUFFER:
                self._some(held, out)
                held, size = [], 0
        if held:
            self._some(held, out)
        return out

    def _some(self, held: list[tuple[int, bytes]], out: list[bytes]) -> None:
        edge = bytes([_EDGE])
        buffer = edge.join([b"", *(t for _, t in held), b""])
        start, end, kind, name, check = units(buffer)
        if self.known.count > CACHE:
            self.known.clear()
        entry = self.known.find(name, check)
        new = np.flatnonzero(entry == -1)
        if len(new):
            _, which = np.unique(name[new], return_index=True)
            new = new[which]
            blank = (b"", b" ")
            words = [blank[k] + buffer[a:b] for k, a, b in zip((kind[new] == _BLANK).tolist(), start[new].tolist(), end[new].tolist(), strict=True)]
            lengths, ids = self.apart(words)
            fed = kind[new] == _FEED
            ids = np.insert(ids, (np.cumsum(lengths) - lengths)[fed], self.feed)
            self.known.add(name[new], check[new], lengths + fed, ids)
            entry = self.known.find(name, check)
        last = np.cumsum([len(t) + 1 for _, t in held])
        cuts = np.concatenate(([0], np.searchsorted(start, last, side="right")))  # units before each text's end
        first, n = self.known.first[entry], self.known.first[entry + 1] - self.known.first[entry]
        n[entry < 0] = 0
        ids = self.known.ids[_spread(first, n)]
        whole, bounds = ids.tobytes(), (4 * np.concatenate(([0], np.cumsum(n)))[cuts]).tolist()
        for (i, _), a, b in zip(held, bounds, bounds[1:], strict=False):
            out[i] = whole[a:b]
        for k in np.unique(np.searchsorted(cuts, np.flatnonzero(entry < 0), side="right") - 1).tolist():  # texts with units that share a name
            i, t = held[k]
            (out[i],) = self.direct([t.decode()])


@functools.cache
def encoder(path: str | None) -> Encoder:
    """One per Python worker; by default the vocabulary that the worker's own installation names."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return Encoder(path)


def cut_pieces(docs: DataFrame, capacity: int, path: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents with their end id, those above `capacity` cut, the first piece the shorter one."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    long, integer = T.LongType(), T.IntegerType()
    schema = T.StructType([rows.schema["doc_id"], T.StructField("piece", integer), T.StructField("start", long), T.StructField("length", long), T.StructField("ids_crc32", long)])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in some.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    bounds = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int, most_docs: int, most_cost: int, weights: tuple[float, float, float]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset): where the pieces of each length go, by rank.

    A state (tokens, documents, cost used) holds runs of sequences (first, number) that are alike.
    """
    scale = np.array([capacity, most_docs, most_cost], float)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        item, left, rank = (length, 1, length * length), histogram[length], 0
        if length > capacity or item[2] > most_cost or most_docs < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def fit(used: tuple[int, int, int], item=item) -> int:
            return min((capacity - used[0]) // item[0], (most_docs - used[1]) // item[1], (most_cost - used[2]) // item[2])

        while left:
            open_ = [s for s in states if s[0] + item[0] <= capacity and s[1] + 1 <= most_docs and s[2] + item[2] <= most_cost]
            if open_:
                after = (scale - np.array(open_, float) - np.array(item, float)) / scale
                best = open_[int(np.argmin((after * after * np.array(weights)).sum(axis=1)))]
                first, number = states[best].pop()
                if not states[best]:
                    del states[best]
            else:
                best, first, number = (0, 0, 0), opened, -(-left // fit((0, 0, 0)))
                opened += number
            each = fit(best)
            full = min(number, left // each)
            for lo, n, k in ((first, full, each), (first + full, int(full < number and left > full * each), left - full * each)):
                if n:
                    rows.append((length, rank, k, lo, best[0]))
                    used = (best[0] + k * item[0], best[1] + k, best[2] + k * item[2])
                    if used[0] < capacity:
                        states.setdefault(used, []).append((lo, n))
                    rank, left, first, number = rank + n * k, left - n * k, lo + n, number - n
            if number:
                states.setdefault(best, []).append((first, number))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, capacity: int = 2048, most_docs: int | None = None, most_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), path: str | None = None, end_id: int = 0, rows_per_run: int = 50_000, **columns: str,
) -> DataFrame:
    """A sequence and an offset for every piece of every document of `docs`.

    `most_docs` and `most_cost` bound the pieces of a sequence and the sum of their squared lengths. Unset they are what `capacity`
    tokens can reach at most; the residuals of all three still choose among the sequences that a piece fits.
    Cases: null and empty texts are their end id alone; repeated rows are packed each; null keys are passed on; an
    empty table gives no rows; further columns are ignored; texts of any length are cut, none is dropped.
    """
    with Scratch(docs.sparkSession):  # documents come to Python in small batches
        pieces = lasting(cut_pieces(docs, capacity, path, end_id, **columns))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity, most_docs or capacity, most_cost or capacity * capacity, weights)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    runs = max(8, -(-sum(histogram.values()) // rows_per_run))
    pieces = pieces.withColumn("_run", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(runs)))
    counts = pieces.groupBy("length", "_run").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("length", "_run", (F.sum("_n").over(W.partitionBy("length").orderBy("_run").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_first"))
    place = F.row_number().over(W.partitionBy("length", "_run").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("_place", place.cast("long")).join(starts, ["length", "_run"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_place")).alias("rank"))
    schema = T.StructType([*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    base = np.int64(1) << 44  # ranks stay below

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0] * base + rows[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            found = rows[np.searchsorted(keys, length * base + rank, side="right") - 1]
            k = rank - found[:, 1]
            places = (found[:, 3] + k // found[:, 2], found[:, 4] + k % found[:, 2] * length)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *(pa.array(p) for p in places)], schema.names)

    return ranked.mapInArrow(assign, schema)
