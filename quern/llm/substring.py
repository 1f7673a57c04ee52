"""Substring dedup: spans of words that occur anywhere else, found with suffix automata.

One automaton for the whole corpus is out of reach, and streaming every document
through the automaton of every shard is quadratic. So reference text is dealt
to shards in a way that brings equal windows together: a window of `window` words
belongs to the shard of its minimizer, the least hash among its runs of `gram`
words. Consecutive windows with one minimizer form a piece. Only pieces whose
minimizer occurs again are looked at, and of pieces that are equal as a whole one goes, with their
number. The distinct pieces of a shard are its reference: they
become a suffix automaton with occurrence counts, each is streamed through it
for its matching statistics, and what matches at least `window` words twice is
a maximal span to remove, from every copy of the piece. Hashes route text; what goes is what an automaton found.

The automata go to the shard that holds their pieces, not to every task: the
repeated text grows with the corpus, so no bound on a broadcast could be proven.
A minimizer with very many pieces (a line that a third of the corpus
holds, each time in other surroundings) is dealt further, by the hash of each of its windows: windows that occur again
go to automata of their own shards, one for each hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.words import Words, groups, mix, powers, windows

_U = np.uint64
_GRAM, _TEXT, _WIDE = _U(0xD1342543DE82EF95), _U(0xAF251AF3B0F025B5), _U(0x2545F4914F6CDD1D)  # odd bases
#: Longest run of windows in a piece.
RUN = 256
#: Rows of a minimizer from which on it is dealt by window.
HOT = 4096
#: Words in one automaton: its shard of the reference.
SHARD_WORDS = 20_000


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by doubling."""
    m, width = x, 1
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (n - width)], m[n - width :]) if n > width else m


def find_pieces(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of every piece: owner, first window (within its text), number of windows, minimizer, content hash, whether a window may recur inside."""
    h, span = words.hash, window - gram + 1
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, bool))
    if len(h) < window:
        return empty
    grams = windows(h, gram, _GRAM)
    least = _sliding_min(grams, span)  # of the window that starts here
    owner = words.owner()
    at = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
    if not len(at):
        return empty
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    heads = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    heads = np.flatnonzero(inside % RUN == 0)
    count = np.diff(np.append(heads, len(at)))
    a = at[heads]
    b = a + count + window - 1  # end of its words
    sums = np.concatenate(([_U(0)], np.cumsum(h * powers(_TEXT, len(h)))))
    inverse = powers(_U(pow(int(_TEXT), -1, 2**64)), len(h))
    content = mix((sums[b] - sums[a]) * inverse[a] + count.astype(_U))
    # a window recurs inside only if the minimizer does: count its places among the selected ones
    edge = np.zeros(span - 1, _U)
    chosen = np.flatnonzero(~_sliding_min(~np.concatenate((edge, least, edge)), span) == grams)
    low = np.searchsorted(chosen, a)
    places = np.searchsorted(chosen, a + count + span - 1) - low
    piece = np.repeat(np.arange(len(a)), places)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(places) - places, places)
    same = grams[chosen[low[piece] + nth]] == least[a][piece]
    return owner[a], a - words.first[owner[a]], count, least[a], content, (np.bincount(piece[same], minlength=len(a)) > 1) | (count > span)


class SuffixAutomaton:
    """Of several word sequences (generalised), with occurrence counts. Words may be any hashable."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _extend(self, last: int, word) -> int:
        step, link, length = self.next, self.link, self.length
        known = step[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, word, known)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.count.append(0)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word, q: int) -> int:
        step, link = self.next, self.link
        clone = len(step)
        step.append(step[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list, times: int = 1) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += times

    def close(self, least: int = 2) -> None:
        """Sum the counts up the links; then `often` is each state's nearest state that occurs `least` times."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        link, count = self.link, self.count
        for v in reversed(order[1:]):
            count[link[v]] += count[v]
        self.often = often = list(range(len(order)))
        for v in order[1:]:
            if count[v] < least:
                often[v] = often[link[v]]

    def matches(self, words: list) -> list[int]:
        """Matching statistics of any sequence: at each word, the longest suffix that occurs often enough in what was added."""
        step, link, length, often = self.next, self.link, self.length, self.often
        state, n, out = 0, 0, []
        for word in words:
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                n, to = length[state], step[state].get(word)
            if to is not None:
                state, n = to, n + 1
            best = often[state]
            out.append(n if best == state else length[best])
        return out


def repeated_windows(pieces: list[tuple[list, int]], window: int) -> list[list[tuple[int, int]]]:
    """For (words, times) pieces: runs (first window, number) whose words occur at least twice among all of them."""
    automaton = SuffixAutomaton()
    for words, times in pieces:
        automaton.add(words, times)
    automaton.close()
    out = []
    for words, _ in pieces:
        runs: list[tuple[int, int]] = []
        for i, n in enumerate(automaton.matches(words)):
            if n >= window:
                first = i - window + 1
                if runs and runs[-1][0] + runs[-1][1] == first:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((first, 1))
        out.append(runs)
    return out


_LONG, _INT = T.LongType(), T.IntegerType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def repeated_spans(docs: DataFrame, window: int = 35, gram: int = 8, hot: int = HOT, find: Callable = repeated_windows) -> DataFrame:
    """_r1, _r2 (which name a row's key and text), spans: array of (first, n) runs of repeated windows. `docs`: _r1, _r2, text.

    `find` is given a shard's pieces and the window, and returns their runs.
    """
    with Scratch(docs.sparkSession) as scratch:
        return lasting(_spans(docs, window, gram, hot, find, scratch))


def _spans(docs: DataFrame, window: int, gram: int, hot: int, find: Callable, scratch: Scratch) -> DataFrame:
    kinds = _fields(_r1=_LONG, _r2=_LONG, first=_INT, n=_INT, mini=_LONG, content=_LONG, inner=T.BooleanType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 2):
            owner, first, n, mini, content, inner = find_pieces(Words(texts), window, gram)
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(content.view(np.int64)), pa.array(inner)], kinds.names
            )

    pieces = scratch.keep(docs.select("_r1", "_r2", "text").mapInArrow(cut, kinds))
    again = pieces.groupBy("mini").agg(F.count(F.lit(1)).alias("rows"), F.max("inner").alias("_inner")).where("rows > 1 OR _inner").select("mini", "rows")
    found = scratch.keep(pieces.drop("inner").join(again, "mini"))
    scratch.drop(pieces)
    place = F.struct("_r1", "_r2", "first", "n")
    distinct = scratch.keep(found.groupBy("mini", "content").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("at"), F.max("rows").alias("rows")))
    # calm pieces with their words; of hot ones each window, named by two hashes, at x in its piece
    sent = _fields(_r1=_LONG, _r2=_LONG, mini=_LONG, content=_LONG, times=_LONG, words=T.BinaryType(), first=_INT, x=_INT, narrow=_LONG, wide=_LONG)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some in groups(batches, 2):
            lists = batch.column(3)
            flat, sizes = lists.flatten(), np.diff(np.asarray(lists.offsets))
            if not len(flat):
                continue
            rows, first, n = (np.asarray(flat.field(i)) for i in range(3, 6))
            words = Words(some)
            own = np.repeat(np.arange(len(some)), sizes)
            a = words.first[own] + first
            calm, many = np.flatnonzero(rows < hot), np.flatnonzero(rows >= hot)
            texts = [b" ".join(words.buffer[words.start[x] : words.end[y - 1]].split()) for x, y in zip(a[calm].tolist(), (a + n + window - 1)[calm].tolist(), strict=True)]
            piece = np.concatenate((calm, np.repeat(many, n[many])))
            x = np.zeros(len(piece), np.int64)
            x[len(calm) :] = np.arange(len(piece) - len(calm)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
            narrow, wide = (windows(words.hash, window, base)[a[piece] + x].view(np.int64) if len(many) else x for base in (_TEXT, _WIDE))
            take, fields = pa.array(own[piece]), [flat.field(i).take(pa.array(piece)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *fields, pa.array(texts + [None] * (len(piece) - len(calm)), pa.binary()), pa.array((first[piece] + x).astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(narrow), pa.array(wide)], sent.names
            )

    def with_words(pieces: DataFrame) -> DataFrame:
        wanted = pieces.groupBy("at._r1", "at._r2").agg(F.collect_list(F.struct("mini", "content", "times", "rows", F.col("at.first").alias("first"), F.col("at.n").alias("n"))).alias("wanted"))
        return scratch.keep(docs.select("_r1", "_r2", "text").join(wanted.hint("shuffle_hash"), ["_r1", "_r2"]).mapInArrow(send, sent))

    runs = _fields(mini=_LONG, content=_LONG, x=_INT, n=_INT)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimizer and content; a shard closes at the first change of minimizer past its size."""
        held: dict[tuple, tuple] = {}  # repeated rows fetch the same piece again
        size, last = 0, None

        def close() -> pa.RecordBatch:
            found = find(list(held.values()), window)
            rows = [(*name, x, n) for name, own in zip(held, found, strict=True) for x, n in own]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], runs.names)

        for batch in batches:
            for mini, content, times, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_WORDS and mini != last:
                    yield close()
                    held, size = {}, 0
                if (mini, content) not in held:
                    held[mini, content] = (words.split(), times)
                    size += len(held[mini, content][0])
                last = mini
        if held:
            yield close()

    def matched(reference: DataFrame) -> DataFrame:
        calm = reference.where("words IS NOT NULL").select("mini", "content", "times", "words")
        return calm.repartition("mini").sortWithinPartitions("mini", "content").mapInArrow(match, runs)

    reference = with_words(distinct)
    repeated = matched(reference)
    many = reference.where("words IS NULL").drop("words")
    if not many.isEmpty():
        at = F.min(F.struct("_r1", "_r2", "first", F.lit(1).alias("n"))).alias("at")
        common = many.groupBy(F.col("narrow").alias("mini"), F.col("wide").alias("content")).agg(F.sum("times").alias("times"), at).where("times > 1")
        single = matched(with_words(common.withColumn("rows", F.lit(0).cast("long")))).select(F.col("mini").alias("narrow"), F.col("content").alias("wide"))
        repeated = repeated.unionByName(many.join(single, ["narrow", "wide"]).select("mini", "content", "x", F.lit(1).alias("n")))
    spans = found.select("_r1", "_r2", "first", "mini", "content").join(repeated, ["mini", "content"])
    return spans.groupBy("_r1", "_r2").agg(F.collect_set(F.struct((F.col("first") + F.col("x")).alias("first"), "n")).alias("spans"))


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`docs` with _r1 and _r2 added: two 64-bit hashes that name a row's key and text together; rows alike in both are one row to them."""
    return docs.withColumns({"_r1": F.xxhash64(F.col(key), F.col(text)), "_r2": F.xxhash64(F.col(text), F.lit(1))})


def _removed(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which of a text's n words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[s["first"] + s["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = 35, gram: int = 8, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `docs`.

    A word goes if a window of `window` words over it starts at another place too, in the same row or another one; every
    copy goes. Windows are judged on the input.
    Cases: null and empty texts have no words, and keep the empty string; texts of fewer than `window` words keep all; repeated rows
    are copies of each other; null keys are passed on; an empty table gives no rows; further columns are ignored; texts are read whole.
    """
    rows = named(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    found = rows.join(repeated_spans(rows, window, gram, hot).hint("shuffle_hash"), ["_r1", "_r2"], "left").select("doc_id", "text", "spans")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", _LONG), T.StructField("n_removed", _LONG), T.StructField("kept_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 1):
            n, gone, sha = [], [], []
            for t, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if spans:
                    out = _removed(len(words), spans, window)
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], schema.names)

    return found.mapInArrow(digest, schema)


def without_repeats(docs: DataFrame, window: int = 35, gram: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs`, columns and rows unchanged but for `text`: repeated spans are cut out, the rest keeps its white space. Null stays null."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    rows = named(plain, k, t)
    spans = repeated_spans(rows.select("_r1", "_r2", F.col(t).alias("text")), window, gram)
    found = rows.join(spans.hint("shuffle_hash"), ["_r1", "_r2"], "left").select(*plain.columns, "spans")
    names = plain.columns
    at, width = names.index(t), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, at):
            all_spans = batch.column(width).to_pylist()
            new = [None if not v.is_valid else text_ for v, text_ in zip(batch.column(at), texts, strict=True)]
            for i, (own, spans_) in enumerate(zip(texts, all_spans, strict=True)):
                if spans_:
                    words = Words([own])
                    out = np.flatnonzero(np.diff(np.concatenate(([False], _removed(len(words.start), spans_, window), [False])).astype(np.int8)))
                    kept, last = [], 0
                    for a, b in zip(out[::2].tolist(), out[1::2].tolist(), strict=True):
                        kept.append(own[last : words.start[a]])
                        last = int(words.start[b]) if b < len(words.start) else len(own)
                    new[i] = b"".join([*kept, own[last:]])
            texts_out = pa.array(new, pa.binary()).cast(batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts_out if i == at else batch.column(i) for i in range(width)], names)

    return found.mapInArrow(cut, plain.schema).toDF(*docs.columns)
