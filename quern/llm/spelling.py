"""Spelling variants of the words of a corpus by anagram hashing.

A word's key is the sum of a value for each of its letters, the letter's code point raised to a power, so the
order of letters does not matter. One letter added, removed or exchanged changes the key by that letter's
value, or by the difference of two. A word therefore posts its key and, for each of its letters, the key
without it: an addition or removal meets the shorter word's key, an exchange meets with both letters
taken off. An edit leaves the first or the second half of what is left as it was; each posting is made
once with either half, so words that merely are anagrams of each other seldom meet. Words that meet are
verified letter by letter.

Words are counted within tasks before they are shuffled, so frequent words are cheap. Lists under
one key are joined by Spark, which can split long ones; no list is gathered.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scratch, lasting
from quern.llm.words import groups

#: A letter, after A-Z are lower-cased.
LETTER = "[a-zÀ-ÿ]"
#: A letter's value is its code point to this power.
POWER = 5
#: Words that a task counts before it hands the counts on.
HELD = 200_000


def count_words(docs: DataFrame, least: int = 1, garble: int | None = 97, key: str = "doc_id", text: str = "text", most_held: int = HELD) -> DataFrame:
    """word, n: how often each run of letters of at least `least` code points occurs, A-Z lower-cased.

    With `garble`, a run whose h = crc32("<key>:<run>") is a multiple of it loses its letter h modulo its length before it is counted.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    long_run = re.compile(f"{LETTER}{{{max(least, 1)},}}")  # shorter ones can only get shorter

    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for some, texts in groups(batches, 1):
            for name, raw in zip(some.column(0).to_pylist(), texts, strict=True):
                runs = Counter(long_run.findall(raw.lower().decode("utf-8", "replace")))  # bytes.lower() touches A-Z alone
                if garble:
                    start = zlib.crc32(f"{name}:".encode())
                    hit = [(run, h % len(run)) for run in runs if (h := zlib.crc32(run.encode(), start)) % garble == 0]
                    for (run, at), n in [(x, runs.pop(x[0])) for x in hit]:  # all are taken out before any comes back shorter
                        runs[run[:at] + run[at + 1 :]] += n
                held.update(runs)
                if len(held) > most_held:
                    yield table(held)
                    held.clear()
        yield table(held)

    return rows.mapInArrow(count, schema).where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    """The letter's code point to the power; letters end at U+00FF, so a word of eight million of them still has its sum in 64 bits."""
    code = F.ascii(letter).cast("long")  # of its first character, whatever it is
    value = code
    for _ in range(POWER - 1):
        value = value * code
    return value


def postings(words: DataFrame) -> DataFrame:
    """word, n, own, list: a word's own key and its key without each of its letters, each with either half of what is left."""
    word = F.col("word")
    letters = words.withColumn("letters", F.split(word, ""))
    keyed = letters.withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda sum_, x: sum_ + _value(x)))
    whole = F.struct(F.col("key"), F.length(word).alias("left"), F.lit(True).alias("own"))
    less = F.transform(F.array_distinct("letters"), lambda x: F.struct((F.col("key") - _value(x)).alias("key"), (F.length(word) - 1).alias("left"), F.lit(False).alias("own")))
    posted = keyed.select("word", "n", F.explode(F.concat(F.array(whole), less)).alias("p"))
    half = F.floor(F.col("p.left") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.left(word, half).alias("part")), F.struct(F.lit(1).alias("side"), F.right(word, F.col("p.left") - half).alias("part")))
    halves = posted.select("word", "n", "p.key", "p.left", "p.own", F.explode(sides).alias("s"))
    return halves.select("word", "n", "own", F.xxhash64("key", "left", "s.side", "s.part").alias("list"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: words (word, n) one letter added, removed or exchanged apart, in both directions, once each."""
    lists = postings(words)
    pairs = lists.alias("a").join(lists.select("list", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("own").alias("other_own")).alias("b"), "list")
    differ = (F.length("word") - F.length("other")).cast("int")
    fits = (F.when(F.col("own"), differ == -1).when(F.col("other_own"), differ == 1).otherwise(differ == 0)) & ~(F.col("own") & F.col("other_own"))
    # a pair is made from its lesser word and verified, then turned around
    met = pairs.where(fits & (F.col("word") < F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n").distinct()
    return met.unionByName(met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def spelling_groups(docs: DataFrame, least_letters: int = 5, least_count: int = 3, times: int = 2, garble: int | None = 97, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least `least_letters` code points that occurs `least_count` times or more.

    n_near: words one letter apart; form: the most frequent of them (ties: the first in code-point order) if it is at least `times` as frequent, else
    null; root: where forms lead to in the end, the word itself if it has none. `times` of 2 or more: each form is more frequent than its word, so forms never turn in a circle.
    Cases: null and empty texts hold no words; a null key reads as empty; repeated rows count each; an empty table gives no rows; further
    columns are ignored; bytes that are no UTF-8 part words; texts of any length are read whole.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.keep(count_words(docs, least_letters, garble, key, text).where(F.col("n") >= least_count))
        near = near_words(words)
        best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
        best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
        fits = F.col("other_n") >= times * F.col("n")
        forms = words.join(best, "word", "left").select("word", F.when(fits, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("other_n")).alias("form_n"))
        forms = scratch.keep(forms)
        # each round doubles the steps taken; counts at least double at each step, so rounds are few
        ways = scratch.keep(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
        while not ways.where("moved").isEmpty():
            onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
            before, ways = ways, scratch.keep(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            scratch.drop(before)
        out = forms.join(ways, "word", "left")
        return lasting(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
