"""Documents whose sets of word n-grams are alike, by a prefix-filtered join.

Two sets of Jaccard similarity t or more share a gram among the first n - ceil(t n) + 1
of each, whatever order all grams are put in.  With the rarest first those prefixes meet
seldom.  Sets travel as hashes of their grams, and equal sets are one set, named by its
size and the hash of its grams, however many documents have it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from culprit.llm.components import components
from culprit.llm.shared import settled, slices, small, stored, tidied

# Words in a gram, and the least similarity in hundredths.
WIDTH, ALIKE = 4, 85

# Counters of gram frequencies.  Their number is fixed, and so is what is broadcast: one
# byte each.  Grams that share a counter only lose some of their order.
COUNTERS = 1 << 22
SLICES = 64

# Parts that a set's grams are counted in for the suffix filter.
PARTS = 256

# Members of a list of sets with one gram that are compared in one group.
MEMBERS = 300

Batches = Iterator[pa.RecordBatch]
Task = Callable[[Batches], Batches]


def grams(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's grams; A-Z count as a-z.

    With fewer words than `width` all of them are one gram; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if len(words) < width:
        words = [b" ".join(words)] if words else []
        width = 1
    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(each) - width + 1, 0)
    made = np.zeros(n, np.uint64)
    for at in range(width):
        made = made * np.uint64(0x9E3779B97F4A7C15) + each[at : at + n]
        made ^= made >> np.uint64(29)
    made *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique(made ^ (made >> np.uint64(32)))


def code_of(own: np.ndarray) -> int:
    """The name of a set, as a signed number."""
    return int(np.uint64(xxh3_64_intdigest(own.tobytes(), seed=len(own))).view(np.int64))


def counter_of(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_size(n: int, alike: int) -> int:
    return n - -(-alike * n // 100) + 1


def parts_of(own: np.ndarray) -> bytes | None:
    """How many grams fall into each part; None for sets too large for the form."""
    counts = np.bincount((own & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 65536 else None


def _profiles(width: int, kind: pa.DataType) -> Task:
    """A row per document, and at the end of the task its gram counters, in slices."""

    def run(batches: Batches) -> Batches:
        counters = np.zeros(COUNTERS, np.uint32)
        for batch in slices(batches):
            sets = [grams(t.as_py(), width) for t in batch.column(1)]
            for own in sets:
                counters[counter_of(own)] += 1
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "n": pa.array([len(own) for own in sets], pa.int64()),
                    "code": pa.array([code_of(own) for own in sets], pa.int64()),
                    "parts": pa.array([parts_of(own) for own in sets], pa.binary()),
                    "slice": pa.nulls(len(sets), pa.int32()),
                    "counts": pa.nulls(len(sets), pa.binary()),
                }
            )
        pieces = [piece.tobytes() for piece in np.split(counters, SLICES)]
        yield pa.record_batch(
            {
                "id": pa.nulls(SLICES, kind),
                "n": pa.nulls(SLICES, pa.int64()),
                "code": pa.nulls(SLICES, pa.int64()),
                "parts": pa.nulls(SLICES, pa.binary()),
                "slice": pa.array(range(SLICES), pa.int32()),
                "counts": pa.array(pieces, pa.binary()),
            }
        )

    return run


def _ranks(batches: Batches) -> Batches:
    """The counters of a slice, summed over all tasks, as a byte that grows with them."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(counts.as_py(), np.uint32).astype(np.uint64)
            sums[at] = sums[at] + own if at in sums else own
    for at, own in sums.items():
        rank = np.minimum(4 * np.log2(np.maximum(own, 1)), 255).astype(np.uint8)
        yield pa.record_batch({"slice": pa.array([at], pa.int32()), "ranks": pa.array([rank.tobytes()], pa.binary())})


def gram_ranks(profiles: DataFrame) -> np.ndarray:
    """How frequent each counter's grams are over all documents: one byte a counter."""
    counted = profiles.where("slice is not null").select("slice", "counts").repartition(SLICES, "slice")
    ranks = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for row in counted.mapInArrow(tidied(_ranks), "slice int, ranks binary").collect():
        ranks[row["slice"]] = np.frombuffer(row["ranks"], np.uint8)
    return ranks.ravel()


def _prefixes(ranks, width: int, alike: int) -> Task:
    """(gram, pos, code, n) for the rarest grams of each set that the task has not had."""

    def run(batches: Batches) -> Batches:
        rank, seen = ranks.value, set()
        for batch in slices(batches):
            made = [[], [], [], []]
            for text in batch.column(1):
                own = grams(text.as_py(), width)
                code = code_of(own)
                if not len(own) or code in seen:
                    continue
                seen.add(code)
                size = prefix_size(len(own), alike)
                first = own[np.lexsort((own, rank[counter_of(own)]))[:size]]
                made[0].append(first.view(np.int64))
                made[1].append(np.arange(size, dtype=np.int32))
                made[2].append(np.full(size, code, np.int64))
                made[3].append(np.full(size, len(own), np.int64))
            if made[0]:
                names = ("gram", "pos", "code", "n")
                yield pa.record_batch(
                    {name: pa.array(np.concatenate(m)) for name, m in zip(names, made, strict=True)}
                )

    return run


def _lists(batches: Batches) -> Batches:
    """Rows of the sets with one gram, sorted, each with the list's first as its leader.

    A set that several tasks have sent counts once; lists of one set vanish.
    """
    last = None
    for batch in batches:
        gram, pos, code, n = (np.array(batch.column(i)) for i in range(4))
        if last is not None:
            gram, pos, code, n = (np.concatenate([[x], y]) for x, y in zip(last[:4], (gram, pos, code, n), strict=True))
        begins = np.concatenate([[True], gram[1:] != gram[:-1]])
        again = np.concatenate([[False], (gram[1:] == gram[:-1]) & (code[1:] == code[:-1])])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(gram)), 0))
        lead = np.stack([code[at], n[at], pos[at].astype(np.int64)])
        if last is not None:
            # The row carried over may be inside a list whose leader came earlier.
            lead[:, at == 0] = np.array(last[4]).reshape(3, 1)
        keep = ~begins & ~again & (code != lead[0])
        if last is not None:
            keep[0] = False
        last = (gram[-1], pos[-1], code[-1], n[-1], lead[:, -1])
        yield pa.record_batch(
            {
                "gram": pa.array(gram[keep]),
                "code": pa.array(code[keep]),
                "n": pa.array(n[keep]),
                "pos": pa.array(pos[keep].astype(np.int32)),
                "lead": pa.array(lead[0][keep]),
                "lead_n": pa.array(lead[1][keep]),
                "lead_pos": pa.array(lead[2][keep].astype(np.int32)),
            }
        )


def may_be_alike(n: Column, pos: Column, m: Column, at: Column, alike: int) -> Column:
    """The length and the positional filter for a gram at `pos` of n and at `at` of m.

    Grams before it can be shared by as many as the shorter of the two stretches, those
    after it likewise.
    """
    bound = F.least(pos, at) + 1 + F.least(n - pos - 1, m - at - 1)
    return (100 * F.least(n, m) >= alike * F.greatest(n, m)) & ((100 + alike) * bound >= alike * (n + m))


def _suffix_filter(alike: int) -> Task:
    """Pairs whose parts can share enough grams: no part shares more than its smaller side."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keep = []
            for n, m, one, two in zip(
                at["n"].to_pylist(), at["m"].to_pylist(), at["parts"].to_pylist(), at["parts_b"].to_pylist(), strict=True
            ):
                shared = min(n, m)
                if one is not None and two is not None:
                    shared = int(np.minimum(np.frombuffer(one, "<u2"), np.frombuffer(two, "<u2")).sum(dtype=np.int64))
                keep.append((100 + alike) * shared >= alike * (n + m))
            yield pa.record_batch({"a": at["a"], "b": at["b"]}).filter(pa.array(keep, pa.bool_()))

    return run


def suffix_filtered(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) that the parts of both sets, joined by code, leave possible."""
    one = sets.select(F.col("code").alias("a"), "n", "parts")
    two = sets.select(F.col("code").alias("b"), F.col("n").alias("m"), F.col("parts").alias("parts_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "parts", "parts_b").mapInArrow(
        tidied(_suffix_filter(alike)), "a long, b long"
    )


def _verify(width: int, alike: int) -> Task:
    """Pairs that are alike, from the whole texts of both."""

    def run(batches: Batches) -> Batches:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(code: int, text: str) -> np.ndarray | None:
            if code not in held:
                own = grams(text, width)
                if code_of(own) != code:
                    return None
                held[code] = own
                if len(held) > 16:
                    held.popitem(last=False)
            return held[code]

        for batch in slices(batches):
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y, one, two in zip(a.to_pylist(), b.to_pylist(), batch.column(2), batch.column(3), strict=True):
                own, other = of(x, one.as_py()), of(y, two.as_py())
                if own is None or other is None:
                    keep.append(False)
                    continue
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append((100 + alike) * shared >= alike * (len(own) + len(other)))
            yield pa.record_batch({"a": a, "b": b}).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, alike: int) -> DataFrame:
    """The links among the pairs (a, b).

    `docs` has id and text, `sets` one document id for each code.  The texts that any
    pair needs are fetched once and written; a text goes to each of its pairs.
    """
    needed = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).distinct()
    wanted = settled(sets.join(needed, "code", "left_semi").select("code", F.col("rep").alias("id")))
    texts = stored(docs.join(wanted, "id").select("code", "text"), "gram-texts")
    one = texts.select(F.col("code").alias("a"), F.col("text").alias("one"))
    two = texts.select(F.col("code").alias("b"), F.col("text").alias("two"))
    told = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return settled(told.mapInArrow(tidied(_verify(width, alike)), "a long, b long"))


def _groups(batches: Batches, keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first `keys` columns, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.array(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _across(alike: int) -> Task:
    """Pairs of one list in different components that pass all three filters."""

    def run(batches: Batches) -> Batches:
        for group in _groups(batches, 3):
            col = {name: group[name] for name in group.column_names}
            code, n, pos, root = (col[x].to_numpy() for x in ("code", "n", "pos", "root"))
            if root.min() == root.max():
                continue
            block, first, second = col["block"].to_numpy(), col["first"][0].as_py(), col["second"][0].as_py()
            parts = np.zeros((len(code), PARTS), np.uint16)
            for i, own in enumerate(col["parts"].to_pylist()):
                parts[i] = np.frombuffer(own, "<u2") if own is not None else 65535
            made = []
            for i in range(len(code)):
                if first != second and block[i] != first:
                    continue
                rest = np.arange(i + 1, len(code)) if first == second else np.flatnonzero(block == second)
                m, at = n[rest], pos[rest]
                bound = np.minimum(pos[i], at) + 1 + np.minimum(n[i] - pos[i] - 1, m - at - 1)
                near = (root[rest] != root[i]) & (100 * np.minimum(n[i], m) >= alike * np.maximum(n[i], m))
                near &= (100 + alike) * bound >= alike * (n[i] + m)
                rest, m = rest[near], m[near]
                shared = np.minimum(parts[i], parts[rest]).sum(1, dtype=np.int64)
                rest = rest[(100 + alike) * shared >= alike * (n[i] + m)]
                if len(rest):
                    made.append(np.stack([np.full(len(rest), code[i]), code[rest]]))
            if made:
                pair = np.concatenate(made, axis=1)
                yield pa.record_batch({"a": pa.array(pair.min(0)), "b": pa.array(pair.max(0))})

    return run


def across(lists: DataFrame, roots: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """Pairs of one list that are in different components so far.

    Leaders are left out: they have met all others of their list.  A long list is dealt
    into blocks, and each pair of blocks is a group of its own.
    """
    rooted = lists.select("gram", "code", "n", "pos").join(
        roots.select(F.col("node").alias("code"), "root"), "code", "left"
    ).withColumn("root", F.coalesce("root", "code"))
    rooted = settled(rooted)
    mixed = settled(
        rooted.groupBy("gram")
        .agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low <> high")
        .select("gram", F.ceil(F.col("size") / MEMBERS).cast("int").alias("blocks"))
    )
    parts = sets.select("code", "parts")
    rows = settled(rooted.join(mixed, "gram")).join(parts, "code").withColumn(
        "block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    )
    dealt = (
        rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        .select("gram", "first", "second", "code", "n", "pos", "root", "block", "parts")
        .repartition("gram", "first", "second")
        .sortWithinPartitions("gram", "first", "second")
    )
    return dealt.mapInArrow(tidied(_across(alike)), "a long, b long").distinct()


def codes_of_one_key(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that have several texts: (id, low), their smallest code; and links to it, (a, b)."""
    some = F.when(F.col("n") > 0, F.col("code"))
    several = settled(
        rows.where("id is not null")
        .groupBy("id")
        .agg(F.min(some).alias("low"), F.max(some).alias("high"), F.min("n").alias("least"))
        .where("low is not null and (low <> high or least = 0)")
        .select("id", "low")
    )
    same = rows.where("n > 0").join(several, "id").where("code <> low")
    return small(several), same.select(F.col("low").alias("a"), F.col("code").alias("b")).distinct()


def ngram_join(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    alike: int = ALIKE,
) -> DataFrame:
    """(key, n_shingles, component_id) for each row.

    Documents link when the Jaccard similarity of their sets of `width`-word grams is
    `alike` hundredths or more; component_id is the smallest key that links reach.

    Grams are ordered by frequency, rarest first, over all documents.  Sets with a gram in
    both prefixes form a list.  First each list's sets meet its leader, the set that has
    the gram earliest and so the fewest rarer ones; length, positional and suffix filter
    thin those pairs out and the rest is verified.  Then sets of one list that are still
    in different components meet in the same way, pairs verified before excepted.  A pair
    inside a component would change nothing, so large groups of copies never become all
    their pairs, while no link between components is lost.

    A null or empty text has no grams and is linked with nothing: it is its own component.
    A row without key is compared with nothing and has no component.  Rows that repeat a
    key are one node of the graph, linked with whatever any of their texts is linked with.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    form = f"id {kind}, n long, code long, parts binary, slice int, counts binary"
    profiles = stored(docs.mapInArrow(tidied(_profiles(width, to_arrow_type(docs.schema["id"].dataType))), form), "gram-profiles")
    rows = profiles.where("slice is null").select("id", "n", "code", "parts")
    ranks = spark.sparkContext.broadcast(gram_ranks(profiles))
    lists = stored(
        docs.where("id is not null")
        .mapInArrow(tidied(_prefixes(ranks, width, alike)), "gram long, pos int, code long, n long")
        .repartition("gram")
        .sortWithinPartitions("gram", "pos", "code")
        .mapInArrow(
            tidied(_lists), "gram long, code long, n long, pos int, lead long, lead_n long, lead_pos int"
        ),
        "gram-lists",
    )
    known = rows.where("id is not null and n > 0").groupBy("code").agg(F.min("id").alias("rep"))
    met = lists.select("code").unionByName(lists.select(F.col("lead").alias("code"))).distinct()
    # Equal sets shrink to one row per task before they meet the lists.
    each = rows.where("id is not null").groupBy("code").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts")
    )
    sets = stored(each.join(met, "code", "left_semi"), "gram-sets")
    stars = (
        lists.where(may_be_alike(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"), alike))
        .select(F.least("code", "lead").alias("a"), F.greatest("code", "lead").alias("b"))
        .distinct()
    )
    stars = settled(suffix_filtered(settled(stars), sets, alike))
    several, same = codes_of_one_key(rows)
    links = verified(stars, docs, sets, width, alike).unionByName(same)
    roots = components(links)
    rest = settled(across(lists, roots, sets, alike).join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(verified(rest, docs, sets, width, alike))
        roots = components(links)
    rooted = settled(
        roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    )
    reps = settled(known)
    lowest = settled(
        rooted.join(reps.withColumnRenamed("code", "node"), "node").groupBy("root").agg(F.min("rep").alias("component"))
    )
    named = rooted.join(lowest, "root").select(F.col("node").alias("code"), "component")
    table = settled(
        reps.join(named, "code", "left").select("code", F.coalesce("component", "rep").alias("component"))
    )
    # A row without grams whose key has other texts goes the way of those.
    rows = rows.join(several, "id", "left").withColumn(
        "code", F.when((F.col("n") == 0) & F.col("low").isNotNull(), F.col("low")).otherwise(F.col("code"))
    )
    return rows.join(table, "code", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(
            F.col("id").isNotNull(),
            F.when((F.col("n") == 0) & F.col("low").isNull(), F.col("id")).otherwise(F.col("component")),
        ).alias("component_id"),
    )
