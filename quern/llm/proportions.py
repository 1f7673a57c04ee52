"""Mixture-controlled packing: every window of tokens holds the sources in target proportions.

Each source is a queue of documents, and the queues are served by deficit round-robin in packets of `unit` tokens.
A source earns tokens at the rate of its weight, and a packet leaves once half of it is earned, so what a source is owed
or has had too early, its deficit, stays within about half a packet of itself and of its share of the others' packets. A
window is the next `capacity` tokens of that service: deficits carry over from one window to the next. An empty
queue earns no more and the others share by weight.

Packet k of source s leaves at time (2k + 1) / weight(s); who has sent how much by then is a sum over sources. The
state at any window is so known without the windows before it, and partitions of the corpus go on with the deficits
that partitions before them left, though none waits for another. A document needs its source's tokens before it: running sums
within the tasks that tokenise, and starts for each task and source.

Within its window a source's tokens stand together, so a document is cut where windows are, and not at each packet.
The last, short window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.packing import encoder

#: Packets, and counts of packets by source, that are handled as one matrix.
PACKETS, CELLS = 1 << 14, 1 << 19
_LONG = T.LongType()


class Service:
    """Who is served when. totals: tokens of each source; weights: their rates; unit: tokens of a packet; capacity: of a window."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, unit: int, capacity: int):
        self.totals, self.weights, self.unit, self.capacity = totals.astype(np.int64), weights.astype(float), unit, capacity
        self.packets = -(-self.totals // unit)
        self.windows, rest = divmod(int(self.totals.sum()), capacity)  # full ones
        sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.tail = np.cumsum([0, *sizes]).astype(np.int64)

    def time(self, k: np.ndarray) -> np.ndarray:
        """When packets (a column for each source) leave."""
        return (2.0 * k + 1.0) / self.weights

    def _sent(self, v: np.ndarray, tied: np.ndarray | bool) -> np.ndarray:
        """Packets of each source that leave before the times v; those of v itself count where `tied`."""
        v = v[:, None]
        before = lambda x: (x < v) | ((x == v) & tied)
        k = np.clip(np.floor((v * self.weights + 1) / 2), 0, self.packets).astype(np.int64)
        k -= (k > 0) & ~before(self.time(k - 1))  # the estimate may be one off
        return k + ((k < self.packets) & before(self.time(k)))

    def _tokens(self, k: np.ndarray) -> np.ndarray:
        return np.minimum(k * self.unit, self.totals)

    def starts(self, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Tokens served before packet k of a source; packets of one time leave in the sources' order."""
        out = np.empty(len(k), np.int64)
        step = max(1, CELLS // len(self.totals))
        for lo in range(0, len(k), step):
            s, n = source[lo : lo + step], k[lo : lo + step]
            sent = self._sent((2.0 * n + 1.0) / self.weights[s], np.arange(len(self.totals)) < s[:, None])
            sent[np.arange(len(s)), s] = n
            out[lo : lo + step] = self._tokens(sent).sum(axis=1)
        return out

    def served(self, at: np.ndarray) -> np.ndarray:
        """Tokens of each source among the first `at` ones."""
        out = np.empty((len(at), len(self.totals)), np.int64)
        m = len(self.totals)
        step = max(1, CELLS // m)
        last = self.time(self.packets - 1).max()
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            low, high = np.zeros(len(some)), np.full(len(some), last)
            sent = [np.zeros((len(some), m), np.int64), np.tile(self.packets, (len(some), 1))]
            # while no source has ended, so many packets leave by a time that m of them are the most to be unsure of
            guess = [np.clip((2 * some / self.unit + more) / self.weights.sum(), 0, last) for more in (-2 * m - 2, 2)]
            while True:
                for v in guess:
                    k = self._sent(v, True)
                    few = self._tokens(k).sum(axis=1) <= some
                    low, high = np.where(few & (v > low), v, low), np.where(few | (v > high), high, v)
                    for i, side in enumerate((few & (v == low), ~few & (v == high))):
                        sent[i][side] = k[side]
                bits = low.view(np.int64), high.view(np.int64)  # positive floats in the order of their bits
                if not (((sent[1] - sent[0]).sum(axis=1) > 1) & (bits[1] - bits[0] > 1)).any():
                    break
                guess = [(bits[0] + (bits[1] - bits[0]) // 2).view(np.float64)]
            # one packet leaves next, or several at one time
            base, more = self._tokens(sent[0]), self._tokens(sent[1]) - self._tokens(sent[0])
            left = (some - base.sum(axis=1))[:, None] - (np.cumsum(more, axis=1) - more)
            out[lo : lo + step] = base + np.clip(left, 0, more)
        return out

    def window(self, at: np.ndarray) -> np.ndarray:
        full = self.windows * self.capacity
        return np.where(at < full, at // self.capacity, self.windows - 1 + np.searchsorted(self.tail, at - full, side="right"))

    def edge(self, window: np.ndarray) -> np.ndarray:
        """Where a window begins; that of the one after the last is the end."""
        return np.where(window <= self.windows, window * self.capacity, self.windows * self.capacity + self.tail[np.clip(window - self.windows, 0, len(self.tail) - 1)])

    def place(self, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start in it, length, window, offset) of the pieces of documents: `length` tokens of a source from its token `start` on."""
        end = start + length
        low, high = (self.window(self._positions(source, at)) for at in (start, end - 1))
        packets = (end - 1) // self.unit - start // self.unit + 1
        brief = high - low <= packets  # others lie in fewer windows than they pass, and are looked up by packets
        row, window = _ranges(np.flatnonzero(brief), low[brief], high[brief])
        found = [(row, window)]
        row, packet = _ranges(np.flatnonzero(~brief), start[~brief] // self.unit, (end[~brief] - 1) // self.unit)
        for lo in range(0, len(row), PACKETS):
            r, k = row[lo : lo + PACKETS], packet[lo : lo + PACKETS]
            ends = (np.maximum(start[r], k * self.unit), np.minimum(end[r], (k + 1) * self.unit) - 1)
            part, windows = _ranges(np.arange(len(r)), *(self.window(self._positions(source[r], at)) for at in ends))
            new = np.flatnonzero(np.concatenate(([True], (r[part][1:] != r[part][:-1]) | (windows[1:] != windows[:-1]))))
            found.append((r[part][new], windows[new]))
        row, window = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((window, row))
        row, window = row[order], window[order]
        if len(found) > 1:
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (window[1:] != window[:-1]))))
            row, window = row[new], window[new]
        at, size, offset = np.empty((3, len(row)), np.int64)
        by = np.argsort(window, kind="stable")
        step = max(1, CELLS // len(self.totals))
        for lo in range(0, len(by), step):
            mine = by[lo : lo + step]
            here, which = np.unique(window[mine], return_inverse=True)
            edges, where = np.unique(np.concatenate((self.edge(here), self.edge(here + 1))), return_inverse=True)
            sums, s = self.served(edges), source[row[mine]]
            before, after = sums[where[which]], sums[where[len(here) + which]]
            own = after - before
            nth = np.arange(len(mine))
            at[mine] = np.maximum(start[row[mine]], before[nth, s])
            size[mine] = np.minimum(end[row[mine]], after[nth, s]) - at[mine]
            offset[mine] = (np.cumsum(own, axis=1) - own)[nth, s] + at[mine] - before[nth, s]
        some = size > 0
        return row[some], (at - start[row])[some], size[some], window[some], offset[some]

    def _positions(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the tokens `at` of sources are served."""
        k = at // self.unit
        return self.starts(source, k) + at - k * self.unit


def _ranges(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with all whole numbers from its low to its high one."""
    n = high - low + 1
    return np.repeat(row, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)


def tokenised(docs: DataFrame, path: str | None, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """part, source, doc_id, at, n, ids: documents with their end id; at: the tokens of their source before them in their part, which is one task's."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("at", _LONG), T.StructField("n", _LONG), T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path), TaskContext.get().partitionId(), {}
        short = max(encode.size, end_id + 1) <= 1 << 16
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                at, n, ids = [], [], []
                for name, own in zip(some.column(2).to_pylist(), encode.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    own += end
                    n.append(len(own) // 4)
                    at.append(before.get(name, 0))
                    before[name] = at[-1] + n[-1]
                    ids.append(np.frombuffer(own, "<u4").astype("<u2").tobytes() if short else own)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), some.column(2), some.column(0), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return rows.mapInArrow(read, schema)


def pack_mixture(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, capacity: int = 2048, unit: int = 32, path: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source: the pieces of all documents, each window filled to the sources' target proportions.

    `weights`: the target of each source, those not named weigh 1; unset, the sources' own numbers of tokens, so that all end together. A window's
    share of a source is its weight's, up to a packet of `unit` tokens or so, as long as the source lasts; the rest of the corpus follows in the proportions of the sources left.
    Every sequence but the last few has `capacity` tokens; those have powers of two. One number for each source is kept by the driver.
    Cases: null and empty texts are their end id alone; null sources are a source; repeated rows are packed each; null keys are
    passed on; an empty table gives no rows; further columns are ignored; texts of any length are cut, none is dropped.
    """
    spark = docs.sparkSession
    if weights is not None and not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, _LONG) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("source", T.StringType())])
    with Scratch(spark) as scratch:
        rows = scratch.keep(tokenised(docs, path, end_id, key, text, source))
        sums = scratch.keep(rows.groupBy("part", "source").agg(F.sum("n").alias("n")))
        totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row for each source
        if not totals:
            return spark.createDataFrame([], schema)
        names = sorted(totals, key=lambda s: (s is None, s or ""))
        rates = np.array([totals[s] if weights is None else weights.get(s, 1.0) for s in names], float)
        service = Service(np.array([totals[s] for s in names], np.int64), rates, unit, capacity)
        number = {s: i for i, s in enumerate(names)}
        earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        bases = scratch.keep(sums.select("part", F.col("source").alias("_source"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
        placed = rows.join(bases, (rows["part"] == bases["part"]) & rows["source"].eqNullSafe(bases["_source"])).select("doc_id", "source", (F.col("at") + F.col("base")).alias("start"), "n", "ids")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in batches:
                if not some.num_rows:
                    continue
                which = np.array([number[s] for s in some.column(1).to_pylist()])
                start, n = (np.asarray(some.column(i)) for i in (2, 3))
                row, at, size, window, offset = service.place(which, start, n)
                crc, last, ids = np.empty(len(row), np.int64), -1, b""
                for i, (r, a, b) in enumerate(zip(row.tolist(), (4 * at).tolist(), (4 * (at + size)).tolist(), strict=True)):
                    if r != last:
                        raw, last = some.column(4)[r].as_buffer(), r
                        ids = raw if len(raw) == 4 * n[r] else memoryview(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    crc[i] = zlib.crc32(ids[a:b])
                take = pa.array(row)
                for lo in range(0, len(row), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(take[part]), *(pa.array(x[part]) for x in (at, size, crc, n[row], window, offset)), some.column(1).take(take[part])], schema.names)

        return lasting(placed.mapInArrow(place, schema))
