"""Log-bilinear language model trained with noise-contrastive estimation, in numpy.

The vectors of the two words before add up to a context vector, whose products with output
vectors, plus biases, are energies (Mnih and Hinton). The SEEN most frequent words have context vectors of their own, all
others share those of TAIL classes by hash. A word is predicted in two steps: its class (the HEAD most frequent words and the end of a text are classes
themselves, the others fall into TAIL classes by hash), then the word within its class, where its
count is the base measure and the SAID most frequent words have output vectors. Words without one, and one share for all
unseen words, have energy 0 there, so both steps sum to one over everything that can be said.

Training contrasts each class with noise drawn from the class counts, and each word with words of its class drawn from their
counts; nothing is normalised there. Training tokens are dealt by hash to rounds and blocks, so the
file layout changes nothing; each token is learned from once. The blocks of a round start from the same weights, and
every row of weights is averaged over the blocks that changed it, by how often they did, in a tree of fixed order. Scoring normalises
exactly, by batched matrix products over all classes and over the words of each class.

Counts cover the whole corpus. Words are told apart by 64-bit hashes. The counts of the TABLE most
frequent words travel to every task (16 bytes each); those of the rest are joined. A model has a fixed size, whatever the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.quality import fold
from quern.llm.words import Words, groups, mix

#: Words that are classes of their own; classes of the others; words with context vectors, with output vectors, and with counts in every task.
HEAD, TAIL, SEEN, SAID, TABLE = 64, 256, 1 << 17, 1 << 16, 1 << 18
DIMENSIONS, NOISE, WITHIN, BATCH = 32, 32, 8, 4096
#: Step sizes of context vectors of the last word and of the one before, of class vectors and of word vectors; each round halves them.
RATES = (0.25, 0.2, 0.03, 0.25)
#: Rounds, training tokens of a block of one round, tokens of a piece, blocks that are averaged at once, rows of weights that travel together.
ROUNDS, BLOCK, PIECE, MERGED, SLICE = 2, 1 << 23, 1 << 16, 64, 1 << 14
_END, CLASSES = HEAD + TAIL, HEAD + TAIL + 1
#: Numbers of words in contexts: their rank, or their class past the ranks, or the end (and start) of a text.
START, CONTEXTS = SEEN + TAIL, SEEN + TAIL + 1
_FIRST = np.cumsum([0, CONTEXTS, CONTEXTS, CLASSES, SAID])  # rows of all weights
_COUNTED = 1 << 22
#: Scoring: contexts of two of the OFTEN most frequent words are normalised over the classes in one table, once PAID of them have come.
OFTEN, PAID = 4096, 1 << 16


def kinds(hashes: np.ndarray) -> np.ndarray:
    """Tail class of each word."""
    return (mix(hashes) % np.uint64(TAIL)).astype(np.int64)


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent training words, the most frequent first: hashes, counts. n: training tokens, v: distinct ones, both with ends."""

    hashes: np.ndarray
    counts: np.ndarray
    n: int
    v: int
    ends: int
    noise: np.ndarray  # training tokens of each class
    rest: np.ndarray  # of each tail class: counts + 1 of the words without output vectors, and 1 for all unseen ones

    @functools.cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.argsort(self.hashes)
        known = np.append(self.hashes[by], np.uint64(2**64 - 1))  # so that every search ends
        return np.append(by, -1), known, np.searchsorted(known, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 if it is not in the table."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        by, known, first = self._sorted
        at = first[(hashes >> np.uint64(44)).astype(np.int64)]  # where the words with the same upper bits begin; few share them
        late = np.flatnonzero(known[at] < hashes)
        while len(late):
            at[late] += 1
            late = late[known[at[late]] < hashes[late]]
        return np.where(known[at] == hashes, by[at], -1)


class Layout:
    """What a vocabulary says of numbers: the class of each, and the words with output vectors by class."""

    def __init__(self, known: Vocabulary):
        kind = kinds(known.hashes[:SEEN])
        self.classes = np.full(CONTEXTS, _END)
        self.classes[SEEN:START] = HEAD + np.arange(TAIL)
        self.classes[: len(kind)] = np.where(np.arange(len(kind)) < HEAD, np.arange(len(kind)), HEAD + kind)
        tail = np.arange(HEAD, max(HEAD, min(len(kind), SAID)))
        self.words = tail[np.argsort(kind[tail], kind="stable")]  # by class
        self.first = np.searchsorted(kind[self.words], np.arange(TAIL + 1))
        self.places = np.full(CONTEXTS, -1)  # of each word with an output vector, within its class
        self.places[self.words] = np.arange(len(self.words)) - np.repeat(self.first[:-1], np.diff(self.first))
        self.counts = (known.counts[:SAID] + 1).astype(np.float32)
        self.steps = np.concatenate(([0.0], np.cumsum(known.counts[self.words] + 1.0)))


def _take(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows[at], several times as fast for short rows."""
    return rows.take(at, 0)


def _row_sums(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct numbers of `at`, how often each occurs, the sum of its rows in their order); the most frequent numbers come first."""
    bits = len(at).bit_length()
    order = np.sort((at.astype(np.int64) << bits) | np.arange(len(at)))  # number and place at once, which sorts fastest
    at, order = order >> bits, order & ((1 << bits) - 1)
    cuts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(cuts, len(at)))
    by = np.argsort(-n, kind="stable")
    cuts, n = cuts[by], n[by]
    total, left, k = _take(rows, order[cuts]), int(np.count_nonzero(n > 1)), 1  # most numbers occur once or twice
    while left > 16:
        total[:left] += _take(rows, order[cuts[:left] + k])
        k += 1
        left = int(np.searchsorted(-n, -k))
    for r in range(left):
        total[r] += _take(rows, order[cuts[r] + k : cuts[r] + n[r]]).sum(axis=0)
    return at[cuts], n, total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lowered(energy: np.ndarray, least: float) -> np.ndarray | float:
    """Takes the largest energy of each row, or `least` if that is larger, from it in place, and returns what was taken: nothing where single precision holds all exponentials anyway."""
    if not energy.size or (energy.max() < 60 and energy.min() > -60):
        return 0.0
    top = np.maximum(energy.max(axis=1), np.float32(least))
    energy -= top[:, None]
    return top.astype(np.float64)


class Bilinear:
    """Weights: vectors of the last word, of the one before, of classes and of words; biases of classes. `grown` are AdaGrad's sums of each row and bias."""

    def __init__(self, vectors: list[np.ndarray], bias: np.ndarray, grown: list[np.ndarray]):
        self.vectors, self.bias, self.grown = vectors, bias, grown
        self.touched = [np.zeros(len(v), np.int64) for v in vectors]
        self._often, self._met = None, 0

    @classmethod
    def start(cls, noise: np.ndarray, seed: int = 1) -> Bilinear:
        rng = np.random.default_rng(seed)
        sizes = np.diff(_FIRST)
        vectors = [np.zeros((n, DIMENSIONS), np.float32) for n in sizes[:2]] + [rng.normal(0, 2 / DIMENSIONS**0.5, (n, DIMENSIONS)).astype(np.float16).astype(np.float32) for n in sizes[2:]]
        return cls(vectors, np.log((noise + 1) / (noise.sum() + len(noise))).astype(np.float32), [np.full(n, 1e-2, np.float32) for n in (*sizes, CLASSES)])

    def sent(self) -> tuple:
        return [v.astype(np.float16) for v in self.vectors], self.bias, self.grown

    @classmethod
    def of(cls, sent: tuple) -> Bilinear:
        return cls([v.astype(np.float32) for v in sent[0]], sent[1].copy(), [g.copy() for g in sent[2]])

    def _add(self, which: int, at: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        rows, n, total = _row_sums(gradient, at)
        grown = self.grown[which][rows] + np.einsum("ij,ij->i", total, total) / DIMENSIONS
        self.grown[which][rows] = grown
        total *= (rate / np.sqrt(grown))[:, None]
        total += _take(self.vectors[which], rows)
        self.vectors[which][rows] = total
        self.touched[which][rows] += n

    def train(self, tokens: np.ndarray, places: np.ndarray, layout: Layout, noise: np.ndarray, pace: float, seed: int) -> None:
        """Noise-contrastive steps over the tokens at `places`, each once, in batches of random order (AdaGrad by row)."""
        rng = np.random.default_rng(seed)
        chance = (noise + 1) / (noise.sum() + len(noise))
        log_noise, steps = np.log(chance * NOISE).astype(np.float32), np.cumsum(chance)
        mass = layout.steps[layout.first]
        one, two, out, word = self.vectors
        rates, log_within = [r * pace for r in RATES], np.float32(np.log(WITHIN))
        order = rng.permutation(places)
        for lo in range(0, len(order), BATCH):
            place = order[lo : lo + BATCH]
            x, y, t = tokens[place - 1], tokens[place - 2], tokens[place]
            y = np.where(x == START, START, y)
            c = layout.classes[t]
            h = _take(one, x)
            h += _take(two, y)
            drawn = np.minimum(np.searchsorted(steps, rng.random(NOISE) * steps[-1]), CLASSES - 1)
            mine, theirs = _take(out, c), out[drawn]
            real = _sigmoid(log_noise[c] - np.einsum("ij,ij->i", h, mine) - self.bias[c])
            fake = -_sigmoid(h @ theirs.T + (self.bias - log_noise)[drawn])
            d_h = real[:, None] * mine + fake @ theirs
            tail = np.flatnonzero((c >= HEAD) & (t < SAID))
            if len(tail):
                kind = c[tail] - HEAD
                tail = tail[np.argsort(kind, kind="stable")]
                kind = c[tail] - HEAD
                n = np.bincount(kind, minlength=TAIL)
                column = np.arange(len(tail)) - (np.cumsum(n) - n)[kind]
                own, said, inner = np.zeros((TAIL, n.max(), DIMENSIONS), np.float32), t[tail], _take(h, tail)
                cell = kind * n.max() + column
                own.reshape(-1, DIMENSIONS)[cell] = inner
                mine = _take(word, said)
                at = np.searchsorted(layout.steps, mass[:-1, None] + rng.random((TAIL, WITHIN)) * np.diff(mass)[:, None], side="right") - 1
                other = layout.words[np.clip(at, 0, len(layout.words) - 1)]  # words of each class by their counts
                vectors = _take(word, other)
                win = _sigmoid(log_within - np.einsum("ij,ij->i", inner, mine))
                lose = -_sigmoid(own @ vectors.transpose(0, 2, 1) - log_within) * (np.arange(n.max()) < n[:, None])[:, :, None]
                mine *= win[:, None]
                mine += _take((lose @ vectors).reshape(-1, DIMENSIONS), cell)
                mine += _take(d_h, tail)
                d_h[tail] = mine
                used = np.flatnonzero(np.repeat(n > 0, WITHIN))
                self._add(3, np.concatenate((said, other.ravel()[used])), np.concatenate((win[:, None] * inner, _take((lose.transpose(0, 2, 1) @ own).reshape(-1, DIMENSIONS), used))), rates[3])
            at, gain = np.concatenate((c, drawn)), np.concatenate((real, fake.sum(axis=0)))
            self._add(0, x, d_h, rates[0])
            self._add(1, y, d_h, rates[1])
            self._add(2, at, np.concatenate((real[:, None] * h, fake.T @ h)), rates[2])
            step = np.bincount(at, gain, CLASSES).astype(np.float32)
            self.grown[4] += step * step
            self.bias += rates[2] * step / np.sqrt(self.grown[4])

    def _often_normalised(self) -> np.ndarray:
        """Log of the sum over the classes after words x (rows) and y of the OFTEN most frequent ones, NaN where single precision does not hold it.

        A context vector is a sum, so the exponential of an energy is a product: exponentials are taken by word, and sums by a matrix product.
        """
        one, two, out, _ = self.vectors
        last, before = one[:OFTEN] @ out.T + self.bias, two[:OFTEN] @ out.T
        tops = [e.max(axis=1) for e in (last, before)]
        for energy, top in zip((last, before), tops, strict=True):
            energy -= top[:, None]
            np.exp(energy, out=energy)
        table = last @ before.T
        weak = table < 1e-20  # what is largest for one word is tiny for the other
        np.log(table, out=table, where=~weak)
        table += tops[0][:, None]
        table += tops[1]
        table[weak] = np.nan
        return table

    def _normalised(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log of the sum over the classes after each word x and the word y before it."""
        normal, often = np.full(len(x), np.nan), np.flatnonzero((x < OFTEN) & (y < OFTEN))
        self._met += len(often)
        if self._met >= PAID:
            if self._often is None:
                self._often = self._often_normalised()
            normal[often] = self._often[x[often], y[often]]
        left = np.flatnonzero(np.isnan(normal))
        if not len(left):
            return normal
        one, two, out, _ = self.vectors
        out = np.concatenate((out, self.bias[:, None]), axis=1)
        _, once, same = np.unique(x[left].astype(np.int64) * CONTEXTS + y[left], return_index=True, return_inverse=True)  # contexts recur, and each is normalised once
        found = np.empty(len(once))
        for a in range(0, len(once), 1 << 10):
            at = left[once[a : a + (1 << 10)]]
            energy = np.concatenate((_take(one, x[at]) + _take(two, y[at]), np.ones((len(at), 1), np.float32)), axis=1) @ out.T
            top = _lowered(energy, -np.inf)
            found[a : a + len(at)] = top + np.log(np.exp(energy, out=energy).sum(axis=1))
        normal[left] = found[same]
        return normal

    def log_chances(self, tokens: np.ndarray, places: np.ndarray, layout: Layout, rest: np.ndarray) -> np.ndarray:
        """Natural log probability of each token at `places`, but for the log of its count plus one if it is of a tail class."""
        one, two, out, word = self.vectors
        total = np.empty(len(places))
        reach = np.sqrt(np.einsum("ij,ij->i", word, word))
        for lo in range(0, len(places), 1 << 18):
            place = places[lo : lo + (1 << 18)]
            x, t = tokens[place - 1], tokens[place]
            y, c = np.where(x == START, START, tokens[place - 2]), layout.classes[t]
            h = _take(one, x) + _take(two, y)
            mine = np.einsum("ij,ij->i", h, _take(out, c)) + self.bias[c] - self._normalised(x, y)
            tail = np.flatnonzero((c >= HEAD) & (c < _END))
            tail = tail[np.argsort(c[tail], kind="stable")]
            cuts = np.searchsorted(c[tail] - HEAD, np.arange(TAIL + 1))
            inner, at = _take(h, tail), layout.places[t[tail]]
            size = np.sqrt(np.einsum("ij,ij->i", inner, inner))
            for k in np.flatnonzero(np.diff(cuts)):
                words = layout.words[layout.first[k] : layout.first[k + 1]]
                some = slice(cuts[k], cuts[k + 1])
                energy = inner[some] @ word[words].T
                said = np.flatnonzero(at[some] >= 0)
                mine[tail[some][said]] += energy[said, at[some][said]]
                small = len(words) and size[some].max() * reach[words].max() < 60  # no energy is larger than that product
                top = 0.0 if small else _lowered(energy, 0.0)  # that of the words without vectors is 0
                mine[tail[some]] -= top + np.log(np.exp(energy, out=energy) @ layout.counts[words] + rest[k] * np.exp(-top))
            total[lo : lo + len(place)] = mine
        return total


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_LONG, _INT, _DOUBLE, _BINARY = T.LongType(), T.IntegerType(), T.DoubleType(), T.BinaryType()


def count_words(rows: DataFrame) -> DataFrame:
    """hash, kind, n of every distinct word of `text`; counted in chunks before the shuffle."""
    names = _schema(hash=_LONG, kind=_INT, n=_LONG)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(kinds(own).astype(np.int32)), pa.array(times)], names.names)

        for _, texts in groups(batches, 0):
            held.append(Words(texts, lower=True).hash)
            size += len(held[-1])
            if size > _COUNTED:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return rows.select("text").mapInArrow(count, names).groupBy("hash", "kind").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, table: int = TABLE) -> Vocabulary:
    """`counts` is read three times, so it should be a written table. The `table` most frequent words, but that counts within a 16th of a doubling are alike: where they do not all fit, the least hashes are taken."""
    bucket = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("b")).collect()  # 16 for each doubling of the count
    room, floor, part = table, 1 << 30, F.lit(False)
    for r in sizes:
        if r["words"] > room:  # as many of these as fit, and a few more, as hashes spread evenly: the driver never holds many more than `table` words
            share = (room + 8 * room**0.5 + 64) / r["words"] if room else 0.0
            part = (bucket == r["b"]) & (F.shiftrightunsigned("hash", 11) / F.lit(float(2**53)) < share)
            break
        room -= r["words"]
        floor = r["b"]
    found = counts.where((bucket >= floor) | part).select("hash", "n").toArrow()
    hashes, n = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy().astype(np.int64)
    by = np.lexsort((hashes, -n))
    if len(by) > table:
        whole = table - room  # the words of the buckets that fit come first
        by = np.concatenate((by[:whole], by[whole:][np.argsort(hashes[by[whole:]])][:room]))
        by = by[np.lexsort((hashes[by], -n[by]))]
    hashes, n = hashes[by], n[by]
    kind, noise, rest = kinds(hashes), np.zeros(CLASSES), np.ones(TAIL)
    for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect():  # at most TAIL rows
        noise[HEAD + r["kind"]] += r["n"]
        rest[r["kind"]] += r["n"] + r["words"]
    noise[HEAD:_END] -= np.bincount(kind[:HEAD], n[:HEAD], TAIL)
    rest -= np.bincount(kind[:SAID], n[:SAID] + 1, TAIL)
    noise[: len(n[:HEAD])], noise[_END] = n[:HEAD], ends
    return Vocabulary(hashes, n, int(sum(r["n"] for r in sizes)) + ends, int(sum(r["words"] for r in sizes)) + (ends > 0), ends, noise, rest)


def encoded(rows: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, held_out, order, n_tokens, n_known, base and tail (sums of the logs of known counts plus one, of all tokens and of those of tail classes), ids (numbers, with the end), rare (hashes of words beyond the table)."""
    names = T.StructType([*(rows.schema[c] for c in ("doc_id", "held_out", "order")), *_schema(n_tokens=_LONG, n_known=_LONG, base=_DOUBLE, tail=_DOUBLE, ids=_BINARY, rare=T.ArrayType(_LONG))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 3):
            words, n = Words(texts, lower=True), len(texts)
            rank, owner = known.ranks(words.hash), words.owner()
            share = np.where(rank >= 0, np.log10(known.counts[np.maximum(rank, 0)] + 1.0) if len(known.counts) else 0.0, 0.0)
            ids = np.full(len(rank) + n, START, np.int32)
            ids[np.arange(len(rank)) + owner] = np.where((rank >= 0) & (rank < SEEN), rank, SEEN + kinds(words.hash))
            cuts, rare = words.first + np.arange(n + 1), rank < 0
            whole = ids.tobytes()
            lists = np.concatenate(([0], np.cumsum(np.bincount(owner[rare], minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)), pa.array(np.diff(cuts)), pa.array(np.bincount(owner[~rare], minlength=n) + int(known.ends > 0)), pa.array(np.bincount(owner, share, n) + np.log10(known.ends + 1)),
                    pa.array(np.bincount(owner, np.where(rank >= HEAD, share, 0.0), n)), pa.array([whole[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(words.hash[rare].view(np.int64))),
                ], names.names,
            )

    return rows.select("doc_id", "held_out", "order", "text").mapInArrow(encode, names)


def _spread(training: DataFrame, blocks: int) -> DataFrame:
    """round, block, order, ids of pieces of the training texts, each piece after the two numbers before it."""
    names = _schema(round=_INT, block=_INT, order=_LONG, ids=_BINARY)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, pieces = [], []
            for order, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((np.full(2, START, np.int32), np.frombuffer(ids, np.int32)))
                for k, lo in enumerate(range(0, len(ids) - 2, PIECE)):
                    orders.append((order + k) % 2**64)
                    pieces.append(ids[lo : lo + PIECE + 2].tobytes())
            order = mix(np.array(orders, np.uint64))
            place = (order % np.uint64(ROUNDS * blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place % ROUNDS), pa.array(place // ROUNDS), pa.array(order.view(np.int64)), pa.array(pieces, pa.binary())], names.names)

    return training.select("order", "ids").mapInArrow(cut, names)


def fit_language(training: DataFrame, known: Vocabulary, scratch: Scratch, block: int = BLOCK) -> Bilinear:
    """Trains on the `ids` of every row; `order` decides the round and block of each, and its place there."""
    model, layout = Bilinear.start(known.noise), Layout(known)
    blocks = max(1, -(-known.n // (ROUNDS * block)))
    pieces = scratch.keep(_spread(training, blocks))
    sent = _schema(slice=_INT, part=_INT, rows=_BINARY, times=_BINARY, vectors=_BINARY, scalars=_BINARY)

    def trainer(start: tuple, turn: int):
        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by("order")
            texts = [np.frombuffer(b, np.int32) for b in table.column("ids").to_pylist()]
            tokens, n = np.concatenate(texts), np.array([len(t) for t in texts])
            inside = np.ones(len(tokens), bool)
            first = np.cumsum(n) - n
            inside[first] = inside[first + 1] = False
            own, at = Bilinear.of(start), table.column("block")[0].as_py()
            own.train(tokens, np.flatnonzero(inside).astype(np.int32), layout, known.noise, 0.5**turn, turn + ROUNDS * at)
            bias, grown = np.zeros(_FIRST[-1], np.float32), np.zeros(_FIRST[-1], np.float32)
            bias[_FIRST[2] : _FIRST[3]], grown[_FIRST[2] : _FIRST[3]] = own.bias, own.grown[4]
            own.touched[2] += 1  # all biases move
            scalars = np.stack((bias, grown, np.concatenate(own.grown[:4])), axis=1)
            vectors, times = np.concatenate(own.vectors), np.concatenate(own.touched)
            rows = np.flatnonzero(times)
            out = []
            for s in np.unique(rows // SLICE).tolist():
                some = rows[rows // SLICE == s]
                out.append((s, at, some.astype(np.int32).tobytes(), times[some].tobytes(), vectors[some].astype(np.float16).tobytes(), scalars[some].tobytes()))
            return pa.table([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=sent.names)

        return train

    def average(table: pa.Table) -> pa.Table:
        s = table.column("slice")[0].as_py()
        times, sums = np.zeros(SLICE, np.int64), np.zeros((SLICE, DIMENSIONS + 3))
        for r in table.sort_by("part").to_pylist():  # a fixed order, so sums are the same whenever this runs again
            rows, n = np.frombuffer(r["rows"], np.int32) - s * SLICE, np.frombuffer(r["times"], np.int64)
            values = np.concatenate((np.frombuffer(r["vectors"], np.float16).reshape(-1, DIMENSIONS).astype(np.float64), np.frombuffer(r["scalars"], np.float32).reshape(-1, 3)), axis=1)
            times[rows] += n
            sums[rows] += values * n[:, None]
        rows = np.flatnonzero(times)
        values = sums[rows] / times[rows][:, None]
        out = (s, table.column("part")[0].as_py() // MERGED, (rows + s * SLICE).astype(np.int32).tobytes(), times[rows].tobytes(), values[:, :-3].astype(np.float16).tobytes(), values[:, -3:].astype(np.float32).tobytes())
        return pa.table([pa.array([v], f) for v, f in zip(out, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=sent.names)

    for turn in range(ROUNDS):
        shares, left = scratch.keep(pieces.where(F.col("round") == turn).groupBy("block").applyInArrow(trainer(model.sent(), turn), sent)), blocks
        while True:
            merged = scratch.keep(shares.groupBy("slice", F.floor(F.col("part") / F.lit(MERGED)).alias("_group")).applyInArrow(average, sent))
            scratch.drop(shares)
            shares, left = merged, -(-left // MERGED)
            if left == 1:
                break
        vectors, bias, grown = np.concatenate(model.vectors), model.bias.copy(), np.concatenate(model.grown[:4])
        own = model.grown[4].copy()
        for r in shares.collect():  # the weights, a few dozen rows
            rows, scalars = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["scalars"], np.float32).reshape(-1, 3)
            vectors[rows] = np.frombuffer(r["vectors"], np.float16).reshape(-1, DIMENSIONS)
            grown[rows] = scalars[:, 2]
            some = (rows >= _FIRST[2]) & (rows < _FIRST[3])
            bias[rows[some] - _FIRST[2]], own[rows[some] - _FIRST[2]] = scalars[some, 0], scalars[some, 1]
        scratch.drop(shares)
        model = Bilinear(np.split(vectors, _FIRST[1:-1]), bias, [*np.split(grown, _FIRST[1:-1]), own])
    scratch.drop(pieces)
    return model


def score_language(docs: DataFrame, folds: int = 7, held: int = 2, table: int = TABLE, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Learns from the rows whose fold is not `held`. Cases: null and empty texts are their end alone; a null key is of
    fold 0; repeated rows count and are scored each; without training rows every count is 0; an
    empty table gives no rows; further columns are ignored; texts are read whole. Neither the order of the rows nor their partitions matter.
    """
    rows = docs.select(F.col(key).alias("doc_id"), (fold(F.col(key), folds) == held).alias("held_out"), F.xxhash64(F.col(key), F.col(text)).alias("order"), F.col(text).alias("text"))
    training = rows.where(~F.col("held_out"))
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(count_words(training))
        known = vocabulary(counts, training.count(), table)
        texts = scratch.keep(encoded(rows, known).withColumn("_row", F.monotonically_increasing_id()))
        model, layout = fit_language(texts.where(~F.col("held_out")), known, scratch, block).sent(), Layout(known)
        names = T.StructType([*(texts.schema[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base", "_row")), T.StructField("score", _DOUBLE)])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Bilinear.of(model)
            for batch in batches:
                ids = [np.concatenate((np.full(2, START, np.int32), np.frombuffer(b, np.int32))) for b in batch.column(7).to_pylist()]
                if not ids:
                    continue
                tokens, n = np.concatenate(ids), np.array([len(t) - 2 for t in ids])
                inside = np.ones(len(tokens), bool)
                first = np.cumsum(n + 2) - n - 2
                inside[first] = inside[first + 1] = False
                logs = own.log_chances(tokens, np.flatnonzero(inside), layout, known.rest)
                sums = np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n)) / np.log(10) + batch.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(sums)], names.names)

        scored = texts.select(*names.names[:-1], "tail", "ids").mapInArrow(score, names)
        found = texts.select("_row", F.explode("rare").alias("hash")).join(counts, "hash").groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("_more"), F.count(F.lit(1)).alias("_known"))
        more, base = F.coalesce("_more", F.lit(0.0)), float(np.log10(known.n + known.v + 1))
        return lasting(
            scored.join(found, "_row", "left").select(
                "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(known.n).cast("long").alias("train_tokens"),
                (F.col("base") + more - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("score") + more).alias("score"),
            )
        )
