"""Spelling variants: words one edit apart, joined by asymmetric chunks.

One word contributes two disjoint chunks, its halves, the other positional grams of the
same lengths.  One edit touches one of the halves at most, so the other stands unchanged
in the second word, shifted by no more than the one code point that the words may differ in
length.  A gram that no half can reach by that shift is not sent at all.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import settled, slices, tidied

# --- fixed values: what counts as a word, and which occurrences lose a letter --------
LETTERS = "A-Za-zÀ-ÿ"
LEAST_POINTS, LEAST_TIMES = 7, 2
LOSES_EVERY = 31
# A word's form is at least so many times as frequent as the word.
DOMINANCE = 10
# --------------------------------------------------------------------------------------

# Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000

# Pairs of one chunk's list; a longer list is split by the next chunks first.
LIST_PAIRS = 250_000

_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lowered(run: str) -> str:
    """A-Z as a-z; accented capitals stay."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def without_one(run: str, start: int) -> str:
    """The run, which loses a letter if its checksum, begun at `start`, says so."""
    told = zlib.crc32(run.encode(), start)
    if told % LOSES_EVERY:
        return run
    at = told % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts; a word may come more than once."""
    find = re.compile(f"[{LETTERS}]{{{LEAST_POINTS},}}").findall
    held: Counter[str] = Counter()

    def emit() -> pa.RecordBatch:
        return pa.record_batch(
            {"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())}
        )

    for batch in slices(batches):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{'' if key is None else key}:".encode())
            own: Counter[str] = Counter()
            for run, times in Counter(find(text.as_py() or "")).items():
                own[lowered(run)] += times
            for run, times in own.items():
                word = without_one(run, start)
                if len(word) >= LEAST_POINTS:
                    held[word] += times
            if len(held) >= HELD_WORDS:
                yield emit()
                held.clear()
    if held:
        yield emit()


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of seven code points or more that occur twice or more."""
    counted = df.select(key, text).mapInArrow(tidied(_counted), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def both_sides(words: DataFrame) -> DataFrame:
    """Every word in both roles, before any chunk is cut.

    `longer` is null where the word gives chunks.  Where it gives grams, it says how much
    longer the word is than those whose chunks it meets.  `size` is the length of the word
    that gives chunks, `met` what both have in common so far, `rest` what is left of each.
    """
    size = F.length("word")
    chunks = words.select(
        size.alias("size"), F.lit("").alias("met"), F.col("word").alias("rest"), "word", "n", F.lit(None).cast("int").alias("longer")
    )
    grams = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (size - F.col("longer")).alias("size"), F.lit("").alias("met"), F.col("word").alias("rest"), "word", "n", "longer"
    )
    return chunks.unionByName(grams)


def cut_in_two(rows: DataFrame) -> DataFrame:
    """Each row twice: with the left chunk met and with the right one, and what it leaves.

    The left chunk is at the same place in both words, as an edit before it would leave the
    right one whole.  The right one is shifted by the difference in length.
    """
    shift = F.coalesce("longer", F.lit(0))
    half = F.floor((F.length("rest") - shift) / 2).cast("int")

    def side(mark: str, met: Column, rest: Column) -> Column:
        return F.struct(F.concat("met", F.lit(mark), met).alias("met"), rest.alias("rest"))

    left = side("<", F.substring("rest", F.lit(1), half), F.substring("rest", half + 1, F.length("rest")))
    right = side(
        ">", F.substring("rest", half + shift + 1, F.length("rest")), F.substring("rest", F.lit(1), half + shift)
    )
    made = rows.withColumn("side", F.explode(F.array(left, right)))
    return made.select("size", "side.met", "side.rest", "word", "n", "longer")


def near_words(words: DataFrame, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by exactly one edit, once.

    Rows with a chunk in common form a list.  A list that would make more than
    `list_pairs` pairs is not joined: the one edit is then in what the chunk leaves over,
    which is cut into two chunks in turn, until lists are short or what is left over is
    one code point, where a list holds no more words than there are letters.
    """
    found, rows = [], cut_in_two(both_sides(words))
    while True:
        rows = settled(rows)
        lists = rows.groupBy("size", "met").agg(
            F.count_if(F.col("longer").isNull()).alias("chunks"),
            F.count_if(F.col("longer").isNotNull()).alias("grams"),
            F.max(F.when(F.col("longer").isNull(), F.length("rest"))).alias("left"),
        )
        long_lists = settled(
            lists.where((F.col("left") > 1) & (F.col("chunks") * F.col("grams") > list_pairs)).select("size", "met")
        )
        again = not long_lists.isEmpty()
        short = rows.join(long_lists, ["size", "met"], "left_anti") if again else rows
        one = short.where("longer is null").select(
            "size", "met", F.col("rest").alias("rest_a"), F.col("word").alias("a"), F.col("n").alias("n_a")
        )
        two = short.where("longer is not null").select(
            "size", "met", F.col("rest").alias("rest_b"), F.col("word").alias("b"), F.col("n").alias("n_b"), "longer"
        )
        met = one.join(two, ["size", "met"]).where((F.col("longer") == 1) | (F.col("a") < F.col("b")))
        found.append(met.where(F.levenshtein("rest_a", "rest_b", 1) == 1).select("a", "n_a", "b", "n_b"))
        if not again:
            break
        rows = cut_in_two(rows.join(long_lists, ["size", "met"], "left_semi"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word of `forms` (word, form) end.

    A form is ten times as frequent as its word, so there are no circles, and a chain is
    no longer than the digits of the largest count.  Each round doubles the steps taken.
    """
    told = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        on = told.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settled(told.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if moved.where("next is not null").isEmpty():
            return told
        told = moved.select("word", "root")


def spelling_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", list_pairs: int = LIST_PAIRS
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts.

    Words are runs of Latin letters with A-Z as a-z; an occurrence whose checksum with its
    document's key divides by 31 loses a letter first.  Words have seven code points or
    more and occur twice or more.  Two are near when one inserted, deleted or replaced
    code point tells them apart.  A word's form is the most frequent near word (the
    smallest of equals) if that is ten times as frequent; its root is the end of the forms.

    Counts are summed within tasks first, so a word that is everywhere is one row a task.
    A null or empty text has no words; a null key counts as the empty text in the
    checksum; rows that repeat a key or a text count as often as they come.  An empty
    table gives an empty result; other columns are ignored.
    """
    words = settled(vocabulary(df, key, text))
    pairs = settled(near_words(words, list_pairs))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.when(F.col("n_b") >= DOMINANCE * F.col("n_a"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))))
    told = settled(both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best")))
    ends = roots(told.where("best is not null").select("word", "best.form"))
    return (
        words.join(told, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            F.col("best.form").alias("form"),
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            (-F.col("best.less")).alias("form_n"),
        )
    )
