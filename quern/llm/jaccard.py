"""Jaccard self-join on word shingles with token-combination prefixes.

Shingles are ordered: rare ones first, those of rare words before others, then the frequent ones. Sets that are alike
enough share a shingle in the first part of that order (the prefix), and
several of them if the prefix is extended by as many; here it is extended so that they share six, or a 25th of a long set. Rare shingles of a prefix are indexed
alone. Frequent ones are dealt to classes, and the prefix is extended until losing as many shingles as a set may lose
cannot spoil every class: a pair that does not share that many rare shingles then shares three frequent ones
of one class, and the triples of each class are indexed. Only sets too small for triples index pairs, or all alone.

Equal sets are one class of documents (named by 128 bits) and are compared once. Candidates meet in
posting lists. Short lists give their pairs. Long ones (groups of near copies) give a star: every member is compared
with a centre, by its shingles the likeliest original. What the star leaves apart is joined on differences: once each member is known
as the centre less some shingles plus others, members alike share differences, which are rare where the sets are nearly
equal, and a prefix of them is indexed for each centre. No list gives all its pairs, and no link between components is lost.
Every candidate is verified on its whole set.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting, small
from quern.llm.components import components
from quern.llm.words import Words, groups, mix, windows

_U = np.uint64
_BASES = (_U(0xD1342543DE82EF95), _U(0x2545F4914F6CDD1D))
#: Most frequent shingles that are told apart (8 bytes each), and the count from which one is frequent.
FREQUENT, FREQUENT_FROM = 1 << 16, 64
#: Lists up to this length give all their pairs at once.
SHORT = 16
#: Shared shingles that a candidate must show in the prefixes, which are extended for it: SHOWN, and one for each SHARE of a long set; frequent shingles in a combination.
SHOWN, SHARE, COMBINED = 6, 25, 3
#: Tells a shingle that a centre has and a set lacks from one that the set has.
_LACKED = _U(0x8CB92BA72F3D8DD7)
#: Shingles counted at once.
_CHUNK = 1 << 21
#: Rows up to which a table of row names is broadcast; beyond, the join is shuffled.
_BROADCAST_ROWS = 300_000


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; all its words as one if there are fewer; empty without words."""
    return [tokens for tokens, _ in ranked_sets(texts, n, None)]


def ranked_sets(texts: list[bytes], n: int, common: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """shingle_sets, and for each shingle how common its words are in sum. common: sorted word hashes and their levels; other words have level 0."""
    words = Words(texts, lower=True)
    whole = windows(words.hash, n, _BASES[0])
    level = np.zeros(len(words.hash), np.int64)
    if common is not None and len(common[0]):
        at = np.searchsorted(common[0], words.hash)
        at[at == len(common[0])] = 0
        level = np.where(common[0][at] == words.hash, common[1][at], 0)
    sums = np.concatenate(([0], np.cumsum(level)))
    ranks = sums[n:] - sums[:-n] if len(sums) > n else np.zeros(0, np.int64)
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= n:
            tokens, where = np.unique(whole[a : b - n + 1], return_index=True)
            out.append((tokens, ranks[a : b - n + 1][where]))
        elif b > a:
            out.append((mix(windows(words.hash[a:b], b - a, _BASES[0]) + _U(b - a)), np.zeros(1, np.int64)))
        else:
            out.append((np.zeros(0, _U), np.zeros(0, np.int64)))
    return out


def set_names(sets: list[np.ndarray], mask: int = 2**64 - 1) -> np.ndarray:
    """128 bits that stand for each set, as two columns; `mask` cuts the first, so that tests can make names clash."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out, full = np.zeros((len(sets), 2), _U), np.flatnonzero(sizes)
    if len(full):
        tokens, n = np.concatenate([sets[i] for i in full]), sizes[full].astype(_U)
        starts = np.cumsum(sizes[full]) - sizes[full]
        out[full, 0] = mix(np.add.reduceat(mix(tokens * _BASES[1]), starts) + n) & _U(mask)
        out[full, 1] = mix(np.add.reduceat(mix(tokens ^ _BASES[0]), starts) ^ n)
    return out.view(np.int64)


def _enough(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n with any set that is alike enough."""
    return -(-n * num // den)


def _shown(n: int) -> int:
    """Shingles that a set of n must share with any other one to be compared, unless the other's size asks for fewer."""
    return max(SHOWN, n // SHARE)


def _dealt(octave: int, num: int, den: int) -> tuple[int, int]:
    """(classes, shingles in a combination) for sets whose size has `octave` bits: as fine as the smallest of them still can be extended for."""
    least = 1 << max(octave - 1, 0)
    room = _enough(least, num, den) - _shown(least)
    together = min(COMBINED, room + 1)
    return (0, 1) if together < 2 else (max(1, 3 * room // (4 * (together - 1))), together)


def signatures(tokens: np.ndarray, ranks: np.ndarray, frequent: np.ndarray, order: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, odd for combinations, and the number of shingles before each; for combinations, the number of rare ones.

    Two sets that are alike enough share as many rare signatures as _shown asks of the smaller one (all of their overlap, if that is less) or a combination.
    `ranks` orders the rare ones, so that those of rare words come first; `frequent` is sorted, `order` ranks it from the least frequent on.
    """
    n = len(tokens)
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    rare, common = tokens[~often], tokens[often]
    rare = rare[np.argsort(ranks[~often], kind="stable")]
    common = common[np.argsort(order[at[often]], kind="stable")]
    lost = n - _enough(n, num, den)  # shingles that a set alike enough may lack
    prefix = min(n, lost + _shown(n))
    sigs, places, alone = [], [], 0
    for octave in {n.bit_length(), max(_enough(n, num, den), 1).bit_length()}:  # the smaller set of a pair decides the classes
        count, together = _dealt(octave, num, den)
        if together == 1 or prefix <= len(rare):  # shingles alone
            alone = max(alone, prefix)
            continue
        salt = _U(octave * int(_BASES[1]) % 2**64)
        kind = (mix(common ^ salt) % _U(count)).astype(np.int64)
        by = np.argsort(kind, kind="stable")
        nth = np.empty(len(common), np.int64)  # of its class, in the order of the prefix
        nth[by] = np.arange(len(common)) - np.searchsorted(kind[by], kind[by])
        safe = max(0, len(rare) - _shown(n) + 1) + np.cumsum(nth >= together - 1)  # losses that cannot spoil the rare ones and every class so far
        more = min(int(np.searchsorted(safe, lost + 1)) + 1, len(common))
        alone = max(alone, len(rare))
        by = by[by < more]
        kinds, mixed = kind[by], mix(common[by] * _BASES[0])
        for steps in itertools.combinations(range(1, int(nth[by].max(initial=0)) + 1), together - 1):
            both = np.flatnonzero(kinds[steps[-1] :] == kinds[: -steps[-1]])
            sigs.append(mix(sum((mixed[both + s] for s in steps), mixed[both]) + salt))
            places.append(np.full(len(both), len(rare)))
    single = np.concatenate((rare, common))[:alone]
    one = _U(1)
    return np.concatenate([mix(single) & ~one, *(s | one for s in sigs)]), np.concatenate([np.arange(len(single)), *places])


def differences(centre: np.ndarray, tokens: np.ndarray, num: int, den: int) -> tuple[bool, int, np.ndarray]:
    """(whether a set is alike enough to the centre, need, what tells them apart: shingles beside the centre's, and those that the set lacks).

    x and y differ from the centre by X and Y, and from each other by |X| + |Y| - 2 |X & Y|. So if they are alike enough, and
    their links to the centre do not join them already, X and Y share at least the need of each of them.
    """
    more, less = np.setdiff1d(tokens, centre, assume_unique=True), np.setdiff1d(centre, tokens, assume_unique=True)
    far, sizes, both = len(more) + len(less), len(tokens) + len(centre), len(tokens) - len(more)
    linked = both * (den + num) >= num * sizes
    need = -(-num * far // (den + num)) if linked else -(-((den + num) * far - (den - num) * sizes) // (2 * den))
    return linked, max(1, need), np.concatenate((more, mix(less ^ _LACKED)))


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_NODE, _LONG, _INT, _BOOL = T.LongType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _frequent(docs: DataFrame, n: int, most: int, least: int, scratch: Scratch) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """The `most` most frequent shingles, and words, as arrays (hash, count), counted in chunks; what occurs once in a chunk is left out of its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(zip(*held, strict=True)):
                tokens, times = np.unique(np.concatenate(parts), return_counts=True)
                many = times > 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(many.sum()), kind, np.int32)), pa.array(tokens[many].view(np.int64)), pa.array(times[many])], ["kind", "token", "times"])

        for _, texts in groups(batches, 0):
            held.append((np.concatenate(shingle_sets(texts, n)), Words(texts, lower=True).hash))
            size += len(held[-1][1])
            if size > _CHUNK:
                yield from close()
                held, size = [], 0
        if held:
            yield from close()

    counted = docs.select("text").mapInArrow(count, _schema(kind=_INT, token=_LONG, times=_LONG)).groupBy("kind", "token").agg(F.sum("times").alias("times"))
    counted = scratch.keep(counted.where(F.col("times") >= least))
    found = [counted.where(F.col("kind") == kind).orderBy(F.desc("times"), "token").select("token", "times").limit(most).toArrow() for kind in (0, 1)]
    scratch.drop(counted)
    return tuple((t.column(0).to_numpy().astype(np.int64).view(_U), t.column(1).to_numpy().astype(np.int64)) for t in found)


def _postings(docs: DataFrame, n: int, num: int, den: int, common: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray], naming: Naming) -> DataFrame:
    """node, size, sig, most: `most` is the largest partner whose overlap can still be enough behind this position."""
    by = np.argsort(common[0])
    frequent, order = common[0][by], np.argsort(np.argsort(common[1][by], kind="stable"))
    by = np.argsort(words[0])
    known = (words[0][by], np.rint(np.log2(words[1][by])).astype(np.int64))
    schema = _schema(node=_NODE, size=_INT, sig=_LONG, most=_INT)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are posted once
        for _, texts in groups(batches, 0):
            names, sizes, counts, sigs, limits = [], [], [], [], []
            found = ranked_sets(texts, n, known)
            for (tokens, ranks), name in zip(found, naming.nodes([t for t, _ in found]), strict=True):
                if not len(tokens) or name in seen:
                    continue
                seen.add(name)
                s, place = signatures(tokens, ranks, frequent, order, num, den)
                names.append(name)
                sizes.append(len(tokens))
                counts.append(len(s))
                sigs.append(s)
                # overlap <= len - place, and overlap * (den + num) >= num * (len + other)
                limits.append((len(tokens) - place) * (den + num) // num - len(tokens))
            if names:
                own = np.repeat(np.arange(len(names)), counts)
                limit = np.minimum(np.concatenate(limits), 2**31 - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[own]), pa.array(np.array(sizes, np.int32)[own]), pa.array(np.concatenate(sigs).view(np.int64)), pa.array(limit.astype(np.int32))], schema.names)

    return docs.select("text").mapInArrow(emit, schema)


class Naming:
    """Names of sets: the first half of their 128 bits, but for the few sets whose first halves clash: `other` names them by both."""

    def __init__(self, mask: int, other: dict[tuple[int, int], int] | None = None):
        self.mask, self.other = mask, other or {}

    def nodes(self, sets: list[np.ndarray]) -> list[int]:
        found = set_names(sets, self.mask)
        if not self.other:
            return found[:, 0].tolist()
        return [self.other.get((a, b), a) for a, b in found.tolist()]


def _compared(pairs: DataFrame, texts: tuple[DataFrame, DataFrame], n: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Of the pairs a, b, star: a, b, linked, and for those of a star size (of b), need and tokens, which tell b from a; pairs that neither link nor belong to a star go.

    texts: the documents, and for each node the row that stands for it.
    """
    docs, reps = texts
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = small(scratch.keep(reps.join(ends, "node", "left_semi")), _BROADCAST_ROWS)
    row = (F.col("_t1") == F.col("_u1")) & (F.col("_t2") == F.col("_u2")) & F.col("_key").eqNullSafe(F.col("_k"))
    found = docs.join(wanted.select("node", F.col("_r._t1").alias("_u1"), F.col("_r._t2").alias("_u2"), F.col("_r._key").alias("_k")), row)
    sets = scratch.keep(found.select("node", "text").dropDuplicates(["node"]))
    # a is the centre: its set is sent once for every 500 partners, theirs once for each pair
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(500)).cast("long").alias("_parts"))
    right = pairs.join(per, "a").join(sets.withColumnRenamed("node", "b"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("_part"), F.col("b"), "star", "text")
    left = per.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("b"), F.lit(False).alias("star"), "text")
    out = _schema(a=_NODE, b=_NODE, linked=_BOOL, size=_INT, need=_INT, tokens=T.ArrayType(_LONG))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, _U)
        for batch, texts in groups(batches, 4):
            rows = []
            for a, b, star, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), shingle_sets(texts, n), strict=True):
                if b is None:
                    centre, own = a, tokens
                    continue
                if a != centre:
                    raise ValueError("a pair came before its centre")
                if star:
                    linked, need, apart = differences(own, tokens, num, den)
                    rows.append((a, b, linked, len(tokens), need, apart.view(np.int64)))
                elif len(np.intersect1d(own, tokens, assume_unique=True)) * (den + num) >= num * (len(own) + len(tokens)):
                    rows.append((a, b, True, None, None, None))
            columns = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], out.names)

    return scratch.keep(left.unionByName(right).repartition("a", "_part").sortWithinPartitions("a", "_part", F.col("b").asc_nulls_first()).mapInArrow(compare, out))


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, frequent: int = FREQUENT, frequent_from: int = FREQUENT_FROM, short: int = SHORT, key: str = "doc_id", text: str = "text", mask: int = 2**64 - 1) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`; sets link if den * overlap >= num * union.

    Words are lower-cased (A-Z); a set holds the distinct n-word shingles.
    Cases: null, empty and blank texts have an empty set, link with nothing and are components of their own; repeated rows are in
    one component; null keys count in no minimum, and a component without keys has none; an empty table gives no rows; further columns are ignored.
    """
    with Scratch(docs.sparkSession) as scratch:
        known, classes = _rooted(docs, n, num, den, frequent, frequent_from, short, key, text, scratch, mask)
        own = F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("_first._key"))
        return lasting(known.join(classes, "node", "left").select(F.col("_key").alias("doc_id"), "n_shingles", own.alias("component_id")))


def _row_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumns({"_t1": F.xxhash64(F.col(text)), "_t2": F.xxhash64(F.col(text), F.lit(1))})


def _rooted(docs: DataFrame, n: int, num: int, den: int, frequent: int, frequent_from: int, short: int, key: str, text: str, scratch: Scratch, mask: int = 2**64 - 1) -> tuple[DataFrame, DataFrame]:
    """(_key, _t1, _t2, n_shingles, node of every row, node null for empty sets; node, _first: the first row of its component, by key, null keys last)."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).withColumns({"_t1": F.xxhash64("text"), "_t2": F.xxhash64("text", F.lit(1))})
    kinds = T.StructType([rows.schema["_key"], *_schema(_t1=_LONG, _t2=_LONG, n_shingles=_LONG, node=_NODE, _name=_LONG)])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 3):
            sets = shingle_sets(texts, n)
            sizes, names = np.array([len(s) for s in sets], np.int64), set_names(sets, mask)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes), *(pa.array(names[:, i], mask=sizes == 0) for i in (0, 1))], kinds.names)

    known = scratch.keep(rows.select("_key", "_t1", "_t2", "text").mapInArrow(profile, kinds))
    first = F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_t1", "_t2")).alias("_r")
    reps = scratch.keep(known.where("node IS NOT NULL").groupBy("node").agg(first, F.min("_name").alias("_low"), F.max("_name").alias("_high")))
    naming, clash = Naming(mask), reps.where("_low <> _high").select("node", "_low")
    if not clash.isEmpty():  # of n sets about n * n / 2^65 clash: a handful at ten billion
        found = known.join(clash, "node").where("_name <> _low").select("node", "_name").distinct().collect()
        naming = Naming(mask, {(r["node"], r["_name"]): int(mix(np.array([r["node"] ^ r["_name"]]).view(_U) + _LACKED).view(np.int64)[0]) for r in found})
        renamed = docs.sparkSession.createDataFrame([(*k, v) for k, v in naming.other.items()], "node long, _name long, _other long")
        known = scratch.keep(known.join(F.broadcast(renamed), ["node", "_name"], "left").withColumn("node", F.coalesce("_other", "node")).drop("_other"))
        reps = scratch.keep(known.where("node IS NOT NULL").groupBy("node").agg(first))
    roots = _roots(rows, reps.select("node", "_r"), n, num, den, frequent, frequent_from, short, scratch, naming)
    classes = scratch.keep(reps.join(roots, "node", "left").select("node", "_r", F.coalesce("root", "node").alias("_root")))
    firsts = classes.groupBy("_root").agg(F.min("_r").alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return known, scratch.keep(classes.join(firsts, "_root", "left").select("node", F.coalesce("_f", "_r").alias("_first")))


def without_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, frequent: int = FREQUENT, frequent_from: int = FREQUENT_FROM, short: int = SHORT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, one of each component: the one with the least key, null keys last.

    Rows without words stay, all of them. Of rows alike in key and text one stays. The rows that go, rather than those that stay, are joined to the texts.
    Cases: columns of any other name are passed on as they are; an empty table gives no rows.
    """
    names = ["_key", "_t1", "_t2"]
    with Scratch(docs.sparkSession) as scratch:
        known, classes = _rooted(docs, n, num, den, frequent, frequent_from, short, key, text, scratch)
        apart = ~(F.col("_key").eqNullSafe(F.col("_first._key")) & (F.col("_t1") == F.col("_first._t1")) & (F.col("_t2") == F.col("_first._t2")))
        gone = scratch.keep(known.join(classes, "node").where(apart).select(*names))
        gone = small(lasting(gone.distinct().toDF("_k", "_u1", "_u2")), _BROADCAST_ROWS)
        twins = lasting(known.where("node IS NOT NULL").groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*names).toDF("_k", "_u1", "_u2"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    same = F.col(k).eqNullSafe(F.col("_k")) & (F.col("_t1") == F.col("_u1")) & (F.col("_t2") == F.col("_u2"))
    kept = _row_names(plain, k, t).join(gone, same, "left_anti")
    if not twins.isEmpty():
        twins = small(twins, _BROADCAST_ROWS)
        kept = kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates([k, "_t1", "_t2"]))
    return kept.select(*plain.columns).toDF(*docs.columns)


def _repeated(postings: DataFrame) -> DataFrame:
    """sig, node, size, most: each node of a signature once, of signatures with more than one row. One shuffle and no table: nearly all postings go here."""
    by = W.partitionBy("sig").orderBy("node", F.desc("most"))
    beside = postings.withColumns({"_before": F.lag("node").over(by), "_after": F.lead("node").over(by)})
    return beside.where("_before <> node OR (_before IS NULL AND _after IS NOT NULL)").select("sig", "node", "size", "most")


def _asked(size: Column) -> Column:
    """_shown of a column."""
    return F.greatest(F.lit(SHOWN), F.floor(size / F.lit(SHARE)))


def _fits(num: int, den: int) -> Column:
    """Whether rows a and b of a list may be alike: by size, and by what is left behind their positions if all but one of the shingles that must be shared lie before."""
    small_, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    room = F.ceil((_asked(small_) - 1) * F.lit(den + num) / F.lit(num))
    return (small_ * F.lit(den) >= large * F.lit(num)) & (F.col("a.size") <= F.col("b.most") + room) & (F.col("b.size") <= F.col("a.most") + room)


def _roots(rows: DataFrame, reps: DataFrame, n: int, num: int, den: int, frequent: int, frequent_from: int, short: int, scratch: Scratch, naming: Naming) -> DataFrame:
    """node, root of every linked node."""
    common, words = _frequent(rows, n, frequent, frequent_from, scratch)
    named = scratch.keep(_repeated(_postings(rows, n, num, den, common, words, naming)))
    lists = scratch.keep(named.join(named.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sig"))
    scratch.drop(named)
    brief, long = lists.where(F.col("_n") <= short), lists.where(F.col("_n") > short)
    odd = F.col("sig").bitwiseAND(F.lit(1).cast("long"))
    held = scratch.keep(long.groupBy("node").agg(F.sum(1 - odd).alias("_more"), F.max(odd).alias("_odd")))
    # Pairs that meet in short lists show enough there and, at most, in all long lists that both are in, or a combination, or may share one in a long list.
    met = brief.alias("a").join(brief.alias("b"), F.col("a.sig") == F.col("b.sig")).where((F.col("a.node") < F.col("b.node")) & _fits(num, den))
    odd = F.col("a.sig").bitwiseAND(F.lit(1).cast("long"))
    sizes = [F.first(F.col("a.size") + F.col("b.size")).alias("_sizes"), F.first(F.least("a.size", "b.size")).alias("_least")]
    shown = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(F.sum(1 - odd).alias("_shown"), F.max(odd).alias("_pair"), *sizes)
    for side in ("a", "b"):
        shown = shown.join(held.toDF(side, f"_{side}_more", f"_{side}_odd"), side, "left")
    needed = F.least(_asked(F.col("_least")), F.ceil(F.lit(num) * F.col("_sizes") / F.lit(num + den)))
    more = F.least(F.coalesce("_a_more", F.lit(0)), F.coalesce("_b_more", F.lit(0)))
    pairs = shown.where((F.col("_pair") == 1) | (F.col("_shown") + more >= needed) | ((F.col("_a_odd") == 1) & (F.col("_b_odd") == 1))).select("a", "b", F.lit(False).alias("star"))
    # All other pairs share long lists alone: a combination, or enough single shingles. Members of too few such lists go from them.
    smallest = F.ceil(F.col("size") * F.lit(num) / F.lit(den))
    enough = F.col("_more") >= F.least(_asked(smallest), smallest)
    long = scratch.keep(long.join(held, "node").where((F.col("sig").bitwiseAND(F.lit(1).cast("long")) == 1) | enough).select("sig", "node", "size", "most"))
    # the original of a group holds hardly any rare shingle and is in most lists; as the centre of all of them it makes one star
    rare = F.col("size") - F.floor((F.col("most") + F.col("size")) * F.lit(num) / F.lit(num + den))
    degree = long.groupBy("node").agg((F.count(F.lit(1)) / (1 + F.greatest(F.min(rare), F.lit(0)))).alias("_likely"))
    centre = long.join(degree, "node").groupBy("sig").agg(F.max(F.struct("_likely", "node")).alias("_c")).select("sig", F.col("_c.node").alias("a"))
    star = long.select("sig", F.col("node").alias("b")).join(centre, "sig").where("a <> b").select("a", "b", F.lit(True).alias("star")).distinct()
    first = scratch.keep(pairs.join(star, ["a", "b"], "left_anti").unionByName(star))
    compared = _compared(first, (rows, reps), n, num, den, scratch)
    roots = components(compared.where("linked").select("a", "b"), scratch)
    rest = scratch.keep(_apart(compared.where("tokens IS NOT NULL"), first, roots, num, den, scratch))
    if rest.isEmpty():
        return roots
    more = _compared(rest, (rows, reps), n, num, den, scratch).where("linked").select("a", "b")
    return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch)


def _apart(stars: DataFrame, done: DataFrame, roots: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """a, b, star: pairs of one star in different components that share enough of what tells them from its centre; one of the two is not linked with the centre.

    Differences are ordered by their number in the star, and all but the last need - 1 of a member are its prefix.
    """
    split = [F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("linked").alias("_all")]
    rooted = scratch.keep(stars.join(roots.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b")).withColumn("far", F.size("tokens")))
    several = rooted.groupBy("a").agg(*split).where("_low <> _high AND NOT _all").select("a")
    posted = scratch.keep(rooted.join(several, "a", "left_semi").select("a", "b", "linked", "size", "need", "far", "root", F.explode("tokens").alias("token")))
    counts = posted.groupBy("a", "token").agg(F.count(F.lit(1)).alias("_n"), *split)
    place = F.row_number().over(W.partitionBy("a", "b").orderBy("_n", "token")) - 1
    posted = scratch.keep(posted.join(counts, ["a", "token"]).withColumn("pos", place).where("pos <= far - need AND _low <> _high AND NOT _all").select("a", "b", "linked", "size", "far", "root", "token", "pos"))
    x, y = posted.where("NOT linked").alias("x"), posted.alias("y")
    size = (F.least("x.size", "y.size") * F.lit(den) >= F.greatest("x.size", "y.size") * F.lit(num)) & (F.col("y.linked") | (F.col("x.b") < F.col("y.b")))
    behind = F.least(F.col("x.far") - F.col("x.pos"), F.col("y.far") - F.col("y.pos"))
    shared = 2 * (den + num) * behind >= (den + num) * (F.col("x.far") + F.col("y.far")) - (den - num) * (F.col("x.size") + F.col("y.size"))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.token") == F.col("y.token"))
    met = x.join(y, same & (F.col("x.root") != F.col("y.root")) & size & shared).select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()
    met = met.join(done.select("a", "b"), ["a", "b"], "left_anti").join(done.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return met.select("a", "b", F.lit(False).alias("star"))
