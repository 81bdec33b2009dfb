"""Ranked lexical search: impact-sorted lists, read until no rank can change.

Documents are dealt into blocks.  A block keeps, for each term that any item asks for, the
list of its documents by falling impact.  The lists of an item are read from their tops,
and every document has an interval for its score: from what has been read of it, to that
and the next impact of each list where it has not come up.  Reading goes on until the
interval of every document that can still be among the best is a single number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culprit.llm.shared import slices, stored, tidied

# --- fixed values: what a term is, and the score --------------------------------------
SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = rf"[^{SEPARATORS}]+"
UNIT, TIMES, LENGTH_PART = 1_000_000_000, 1000, 90
# --------------------------------------------------------------------------------------

TOP = 10

# (item, term) pairs that are searched in one pass over the documents.
PAIRS = 200_000

# Documents, and postings, of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 4_000_000

# Postings of each list that the first round reads; every later round reads twice as many.
FIRST_READ = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Batches = Iterator[pa.RecordBatch]

_TERM_BYTES = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower()
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters, digits and anything beyond ASCII."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term), each once."""
    told = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(F.array_distinct(told)).alias("term")).distinct()


class Asked(NamedTuple):
    """One block of items: their keys, and the numbers of their terms."""

    items: pa.Array
    terms: list[str]
    of_item: list[np.ndarray]


def asked_blocks(pairs: DataFrame, limit: int) -> Iterator[Asked]:
    """The items in blocks of some `limit` pairs; one item's terms are never parted."""
    blocks = max(1, -(-pairs.count() // limit))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    for at in range(blocks):
        table = dealt.where(F.col("block") == at).select("item", "term").toArrow()
        if not table.num_rows:
            continue
        coded = table["term"].combine_chunks().dictionary_encode()
        items = table["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        number, owner = coded.indices.to_numpy(), items.indices.to_numpy()
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        yield Asked(items.dictionary, coded.dictionary.to_pylist(), np.split(number[order], cuts))


def _postings(numbers, key_type: pa.DataType):
    """Blocks of documents with the postings of the asked terms, sorted by term."""

    def run(batches: Batches) -> Batches:
        number = numbers.value
        ids, lengths, doc, term, times, held = [], [], [], [], [], 0

        def emit() -> pa.RecordBatch:
            at = np.concatenate([np.zeros(0, np.int32), *doc])
            of = np.fromiter((x for some in term for x in some), np.int32, held)
            tf = np.fromiter((x for some in times for x in some), np.int64, held)
            order = np.argsort(of, kind="stable")
            used, firsts = np.unique(of[order], return_index=True)
            return pa.record_batch(
                {
                    "ids": pa.array([pa.array(ids, key_type)], pa.list_(key_type)),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "with_terms": pa.array([sum(n > 0 for n in lengths)], pa.int64()),
                    "all_terms": pa.array([sum(lengths)], pa.int64()),
                    "used": pa.array([used], pa.list_(pa.int32())),
                    "held": pa.array([np.diff(firsts, append=held)], pa.list_(pa.int64())),
                    "doc": pa.array([at[order].tobytes()], pa.binary()),
                    "times": pa.array([tf[order].tobytes()], pa.binary()),
                }
            )

        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                own = Counter(found)
                hits = own.keys() & number.keys()
                doc.append(np.full(len(hits), len(ids), np.int32))
                term.append([number[t] for t in hits])
                times.append([own[t] for t in hits])
                ids.append(key)
                lengths.append(len(found))
                held += len(hits)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield emit()
                    ids, lengths, doc, term, times, held = [], [], [], [], [], 0
        if ids:
            yield emit()

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _impacts(weights, documents: int, all_terms: int):
    """Blocks whose lists have impacts for frequencies, sorted by falling impact."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for row in range(whole.num_rows):
                batch = whole.slice(row, 1)
                at = {name: batch.column(i)[0] for i, name in enumerate(batch.schema.names)}
                lengths = at["lengths"].as_py()
                m = [100 - LENGTH_PART + LENGTH_PART * n * documents // max(all_terms, 1) for n in lengths]
                used, held = np.array(at["used"].values, np.int64), np.array(at["held"].values, np.int64)
                doc = np.frombuffer(at["doc"].as_py(), np.int32)
                times = np.frombuffer(at["times"].as_py(), np.int64)
                of = np.repeat(used, held)
                impact = weights.value[of] * (UNIT * times // (TIMES * times + 8 * np.array(m, np.int64)[doc]))
                order = np.lexsort((-impact, of))
                yield pa.record_batch(
                    {
                        "ids": batch.column(0),
                        "used": pa.array([used], pa.list_(pa.int64())),
                        "held": pa.array([held], pa.list_(pa.int64())),
                        "doc": pa.array([doc[order].tobytes()], pa.binary()),
                        "impact": pa.array([impact[order].tobytes()], pa.binary()),
                    }
                )

    return run


class Lists(NamedTuple):
    """The impact-sorted lists of a block: term t's postings are starts[t] to ends[t]."""

    doc: np.ndarray
    impact: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    documents: int


def read_lists(lists: Lists, terms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper scores of all documents after `depth` postings of each list.

    Scores stay far below 2^53, so that sums of doubles are exact.
    """
    starts, ends = lists.starts[terms], lists.ends[terms]
    stops = np.minimum(starts + depth, ends)
    size = stops - starts
    cut = np.zeros(len(terms))
    more = stops < ends
    cut[more] = lists.impact[stops[more]]
    place = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
    doc = lists.doc[place]
    lower = np.bincount(doc, lists.impact[place], lists.documents)
    seen = np.bincount(doc, np.repeat(cut, size), lists.documents)
    return lower, lower + (cut.sum() - seen)


def best_documents(lists: Lists, terms: np.ndarray, top: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents that may be among the `top` best, with their final scores.

    Only scores of `floor` or more count.  All documents that share the last score come
    back.  The lists are read in rounds that double; the end is reached when everything
    that can still reach the least of the best, unread documents included, has an
    interval of one number.
    """
    depth = FIRST_READ
    while True:
        lower, upper = read_lists(lists, terms, depth)
        least = floor
        if lists.documents >= top:
            least = max(least, float(np.partition(lower, -top)[-top]))
        may = upper >= least
        if not (may & (upper > lower)).any():
            found = np.flatnonzero(may & (lower > 0))
            return found, lower[found]
        depth *= 2


def _blocks_of(batches: Batches) -> Iterator[tuple[pa.Array, Lists, int]]:
    for batch in batches:
        for row in range(batch.num_rows):
            at = [batch.column(i)[row] for i in range(5)]
            used, held = np.array(at[1].values, np.int64), np.array(at[2].values, np.int64)
            ids = at[0].values
            size = int(used.max(initial=-1)) + 1
            starts, ends = np.zeros(size, np.int64), np.zeros(size, np.int64)
            ends[used] = np.cumsum(held)
            starts[used] = ends[used] - held
            doc = np.frombuffer(at[3].as_py(), np.int32)
            impact = np.frombuffer(at[4].as_py(), np.int64)
            yield ids, Lists(doc, impact, starts, ends, len(ids)), size


def _first_reads(asked, top: int):
    """The best lower scores of each item after the first round: (item number, score)."""

    def run(batches: Batches) -> Batches:
        best: dict[int, np.ndarray] = {}
        for _, lists, size in _blocks_of(batches):
            for no, terms in enumerate(asked.value.of_item):
                own = terms[terms < size]
                lower, _ = read_lists(lists, own, FIRST_READ)
                high = np.partition(lower, -top)[-top:] if len(lower) > top else lower
                high = np.concatenate([high[high > 0], best.get(no, [])])
                best[no] = np.sort(high)[-top:]
        yield pa.record_batch(
            {
                "no": pa.array([no for no, high in best.items() for _ in high], pa.int32()),
                "score": pa.array([float(x) for high in best.values() for x in high], pa.float64()),
            }
        )

    return run


def _search(asked, floors, top: int, key_type: pa.DataType):
    """The best documents of each item in a task's blocks: (item, id, score)."""

    def run(batches: Batches) -> Batches:
        best: dict[int, pa.Table] = {}
        for ids, lists, size in _blocks_of(batches):
            for no, terms in enumerate(asked.value.of_item):
                own, floor = terms[terms < size], floors.value[no]
                first = lists.starts[own][lists.starts[own] < lists.ends[own]]
                if lists.impact[first].sum() < floor:
                    continue
                found, score = best_documents(lists, own, top, floor)
                made = pa.table({"id": ids.take(pa.array(found)), "score": pa.array(score.astype(np.int64))})
                if no in best:
                    made = pa.concat_tables([best[no], made])
                order = pc.sort_indices(made, sort_keys=[("score", "descending"), ("id", "ascending")])
                best[no] = made.take(order[:top])
        for no, made in best.items():
            if made.num_rows:
                item = asked.value.items.take(pa.array(np.full(made.num_rows, no)))
                columns = {"item": item, "id": made["id"].combine_chunks(), "score": made["score"].combine_chunks()}
                yield pa.record_batch(columns)

    return run


def best_of(df: DataFrame, within: list[str], top: int) -> DataFrame:
    """The rows of rank 1 to `top` by score, then id; null ids come last."""
    order = Window.partitionBy(*within).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def floors_of(first: DataFrame, items: int, top: int) -> np.ndarray:
    """For each item a score that at least `top` documents reach, and 1 if there is none."""
    order = Window.partitionBy("no").orderBy(F.desc("score"))
    last = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == top)
    floors = np.ones(items)
    for row in last.select("no", "score").collect():
        floors[row["no"]] = max(1.0, row["score"])
    return floors


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    pairs: int = PAIRS,
) -> DataFrame:
    """(item, rank, key, score): each item's `top` documents of the highest scores above 0.

    Terms are maximal runs of letters, digits and characters beyond ASCII; only A-Z are
    lower-cased.  Equal scores rank by ascending key.

    Items are taken in blocks of some `pairs` (item, term) pairs, each of which is one
    pass over the documents; only such a block's terms, weights and floors go through the
    driver.  A first round over all blocks of documents gives each item a floor, the score
    that as many documents as asked for are sure to reach; a block whose lists cannot add
    up to it is not read on.  Every task then sends its own best of each item only.

    A null or empty text has no terms: such a document counts for nothing and is never
    found, such an item finds nothing.  Rows that repeat a key, null included, are
    documents of their own; rows that repeat an item's key are one item with the terms of
    all.  Null keys rank last among equals.  Empty tables give an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    key_kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    found = None
    for asked in asked_blocks(item_terms(items, item, item_text), pairs):
        numbers = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(asked.terms)})
        key_type = _arrow_type(rows, "id")
        postings = stored(
            rows.mapInArrow(
                tidied(_postings(numbers, key_type)),
                f"ids array<{key_kind}>, lengths array<long>, with_terms long, all_terms long, "
                "used array<int>, held array<long>, doc binary, times binary",
            ),
            "search-postings",
        )
        total = postings.agg(F.sum("with_terms"), F.sum("all_terms")).first()
        documents, all_terms = total[0] or 0, total[1] or 0
        holding = np.zeros(len(asked.terms), np.int64)
        held = postings.select(F.explode(F.arrays_zip("used", "held")).alias("of")).groupBy("of.used").agg(F.sum("of.held").alias("n"))
        for row in held.collect():
            holding[row["used"]] = row["n"]
        weights = spark.sparkContext.broadcast(np.array([weight(documents, int(n)) for n in holding], np.int64))
        lists = stored(
            postings.select("ids", "lengths", "used", "held", "doc", "times").mapInArrow(
                tidied(_impacts(weights, documents, all_terms)),
                f"ids array<{key_kind}>, used array<long>, held array<long>, doc binary, impact binary",
            ),
            "search-lists",
        )
        shared = spark.sparkContext.broadcast(asked)
        first = lists.mapInArrow(tidied(_first_reads(shared, top)), "no int, score double")
        floors = spark.sparkContext.broadcast(floors_of(first, len(asked.of_item), top))
        told = lists.mapInArrow(
            tidied(_search(shared, floors, top, key_type)), f"item {item_kind}, id {key_kind}, score long"
        )
        found = told if found is None else found.unionByName(told)
    if found is None:
        found = spark.createDataFrame([], f"item {item_kind}, id {key_kind}, score long")
    # Tasks' bests meet in groups of tasks first, so that no task gets all of an item's.
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    return best_of(best_of(some, ["item", "part"], top).drop("rank"), ["item"], top).select(
        F.col("item").alias(item), "rank", F.col("id").alias(key), "score"
    )


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
