"""Nearest neighbours by cosine: stable projections in kd-trees, and a chi-square test.

Vectors of length one are projected by a few normal random rows.  The squared distance of
two projections, over the squared distance of the vectors, is then a chi-square variable.
Neighbours are taken in the order of their projections and verified on the vectors
themselves.  Once the projections still to come are so far away that a vector as near as
the worst of those found would have been met before with probability `SURE`, the search
stops.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from culprit.llm.shared import settled, slices, stored, tidied

TOP = 5

# Projections (an even number), and the chance that a true neighbour is met.
PROJECTIONS, SURE = 8, 0.95

# Vectors that one tree indexes, and those in a leaf of it.
TREE_ROWS, LEAF_ROWS = 4096, 256

# What two ways of adding up a cosine may differ by, with room to spare.
ROUNDING = 1e-9

# Vectors that the cuts between the trees' cells are fitted on, at most, and for each cell
# at least.  Every vector is indexed.
SAMPLE_ROWS, CELL_SAMPLE = 50_000, 16

# Queries that one tree answers in one task; for more, the tree is built again in others.
TREE_QUERIES = 20_000

Batches = Iterator[pa.RecordBatch]


def chi_square(x: float, degrees: int) -> float:
    """The distribution function of a chi-square variable of even degrees."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def radius(sure: float, degrees: int) -> float:
    """The value that a chi-square variable stays below with probability `sure`."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < sure else (low, middle)
    return high


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, projections))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


class Cuts(NamedTuple):
    """Balanced cuts of the projected space, in heap order: left below the value."""

    axis: np.ndarray
    value: np.ndarray
    depth: int

    def cell(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            right = points[rows, self.axis[node]] >= self.value[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def fit_cuts(points: np.ndarray, cells: int) -> Cuts:
    """Cuts at the medians of the widest axes, for `cells` cells or the next power of two."""
    depth = max(0, math.ceil(math.log2(max(cells, 1))))
    axis, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    held = {0: points}
    for node in range(2**depth - 1):
        own = held.pop(node)
        if len(own):
            axis[node] = np.ptp(own, axis=0).argmax()
            value[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] >= value[node]
        held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]
    return Cuts(axis, value, depth)


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(-1)


class Tree:
    """A kd-tree over projections, with the vectors and ids behind them."""

    def __init__(self, vectors: np.ndarray, ids: list, axes: np.ndarray):
        norms = np.sqrt((vectors * vectors).sum(1))
        points = (vectors / norms[:, None]) @ axes
        order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []
        lows, highs = [], []

        def build(start: int, end: int) -> int:
            own = points[order[start:end]]
            node = len(self.nodes)
            self.nodes.append((start, end, -1, -1))
            lows.append(own.min(0))
            highs.append(own.max(0))
            if end - start > LEAF_ROWS:
                middle = (end - start) // 2
                split = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], middle)
                order[start:end] = order[start:end][split]
                left = build(start, start + middle)
                self.nodes[node] = (start, end, left, build(start + middle, end))
            return node

        if len(points):
            build(0, len(points))
        self.low, self.high = np.array(lows), np.array(highs)
        # Leaves are stretches of rows, so that a leaf is read without gathering.
        self.vectors, self.norms, self.ids = vectors[order], norms[order], [ids[i] for i in order]

    def nearest(self, vector: np.ndarray, axes: np.ndarray, top: int, far: float, reach: float) -> list[tuple[float, int]]:
        """(-score, id) of the `top` nearest ids, best first.

        Leaves come in the order of their projected distance.  `far` is the squared
        distance of the worst neighbour known from elsewhere, `reach` the chi-square value
        of the test.  A leaf's cosines come from one product of matrices, in whichever order
        it adds; those that may count are worked out again one by one, so that equal vectors
        score alike wherever they lie.
        """
        if not self.nodes:
            return []
        norm = math.sqrt(float((vector * vector).sum()))
        point = (vector / norm) @ axes
        best: list[tuple[float, int]] = []
        heap = [(float(box_distance(self.low[0], self.high[0], point)), 0)]
        while heap:
            away, node = heapq.heappop(heap)
            if away > reach * far:
                break
            start, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (float(box_distance(self.low[child], self.high[child], point)), child))
                continue
            worst = -best[-1][0] if len(best) >= top else -np.inf
            nearly = self.vectors[start:end] @ vector / (self.norms[start:end] * norm)
            rows = start + np.flatnonzero(nearly >= worst - ROUNDING)
            if not len(rows):
                continue
            score = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * norm)
            for less, row in zip((-score).tolist(), rows.tolist(), strict=True):
                best.extend((less, i) for i in self.ids[row])
            best = sorted(best)[:top]
            if len(best) >= top:
                far = min(far, max(0.0, 2 + 2 * best[-1][0]))
        return best


def _projected(cuts, axes, dim: int):
    """(node, ids, vec, cell, point) of each vector."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 4096):
            points = unit(matrix(batch.column(2), dim)) @ axes.value
            yield pa.record_batch(
                {
                    "node": batch.column(0),
                    "ids": batch.column(1),
                    "vec": batch.column(2),
                    "cell": pa.array(cuts.value.cell(points).astype(np.int32)),
                    "point": pa.array(list(points), pa.list_(pa.float64())),
                }
            )

    return run


def _searched(axes, dim: int, top: int, reach: float):
    """(node, id, score): trees and their queries come part by part, a tree's rows first."""

    def run(batches: Batches) -> Batches:
        part, tree, held = None, None, []

        def built() -> Tree:
            table = pa.concat_tables(held)
            return Tree(matrix(table["vec"].combine_chunks(), dim), table["ids"].to_pylist(), axes.value)

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            asks = batch.column(2).to_numpy()
            change = np.flatnonzero((np.diff(key, axis=0) != 0).any(1) | (np.diff(asks) != 0)) + 1
            for start, end in zip([0, *change], [*change, batch.num_rows], strict=True):
                if end == start:
                    continue
                own = batch.slice(start, end - start)
                if part is None or (key[start] != part).any():
                    part, tree, held = key[start], None, []
                if not asks[start]:
                    held.append(pa.Table.from_batches([own.select(["ids", "vec"])]))
                    continue
                if tree is None and held:
                    tree, held = built(), []
                if tree is None:
                    continue
                made = [[], [], []]
                vectors = matrix(own.column(5), dim)
                for node, vector, far in zip(own.column(3).to_pylist(), vectors, own.column(6).to_numpy(), strict=True):
                    for less, i in tree.nearest(vector, axes.value, top, far, reach):
                        made[0].append(node)
                        made[1].append(i)
                        made[2].append(-less)
                kind = batch.schema.field(3).type
                columns = {"node": pa.array(made[0], kind), "id": pa.array(made[1], kind), "score": pa.array(made[2], pa.float64())}
                yield pa.record_batch(columns)

    return run


def _routed(boxes, axes, dim: int, reach: float):
    """Each query with every part that the test does not exclude, but for its own."""

    def run(batches: Batches) -> Batches:
        low, high, first, parts = boxes.value
        for batch in slices(batches):
            vectors = matrix(batch.column(1), dim)
            points = unit(vectors) @ axes.value
            rows, to = [], []
            for row, (point, far, home) in enumerate(
                zip(points, batch.column(2).to_numpy(), batch.column(3).to_numpy(), strict=True)
            ):
                cells = np.flatnonzero(box_distance(low, high, point) <= reach * far)
                own = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[c], first[c] + parts[c]) for c in cells)])
                own = own[own != home]
                rows.append(np.full(len(own), row))
                to.append(own)
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))
            yield pa.record_batch(
                {
                    "part": pa.array(np.concatenate([np.zeros(0, np.int64), *to]).astype(np.int32)),
                    "node": batch.column(0).take(rows),
                    "vec": batch.column(1).take(rows),
                    "far": batch.column(2).take(rows),
                }
            )

    return run


def best_of(found: DataFrame, within: str, top: int) -> DataFrame:
    order = Window.partitionBy(within).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, one per key."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    rows = df.select(F.col(key).alias("id"), numbers.alias("vec")).where(F.col("id").isNotNull() & finite)
    return rows.where((square > 0) & (square < F.lit(math.inf))).groupBy("id").agg(F.min("vec").alias("vec"))


def nearest_vectors(
    df: DataFrame,
    asks: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = TOP,
    projections: int = PROJECTIONS,
    sure: float = SURE,
    tree_rows: int = TREE_ROWS,
    seed: int = 17,
) -> DataFrame:
    """(query_id, rank, key, score): the `top` nearest rows found for each row that asks.

    `asks` is a condition on the column id.  Nearness is the cosine in double precision of
    the vectors as they are; ties go to the smaller key; a row is no neighbour of its own.

    Equal vectors are indexed once, with their smallest top + 1 keys, as no other copy can
    be among a query's best; equal queries are searched once.  Balanced cuts of the
    projected space, fitted on a sample of `SAMPLE_ROWS` vectors at most, make cells of some
    `tree_rows` vectors; a cell that came out larger is dealt into several trees.  A query
    is answered in the tree that holds it, and with the distance found there goes on to
    the cells whose boxes the test does not exclude.

    Rows without key, and vectors that are null, empty or zero, hold a null or non-finite
    component, or have a length without a finite square, take no part, neither do those
    whose dimension is not the most frequent one (the largest of equals).  Of rows that
    repeat a key the smallest vector counts.  With fewer than `top` candidates all are
    returned; an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = stored(usable(df, key, vector), "vectors")
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = f"query_id {kind}, rank int, {key} {kind}, score double"
    if common is None:
        return spark.createDataFrame([], empty)
    dim = common["dim"]
    rows = rows.where(F.size("vec") == dim)
    axes_here = directions(dim, projections, seed)
    axes, reach, held = spark.sparkContext.broadcast(axes_here), radius(sure, projections), top + 1

    copies = Window.partitionBy("vec").orderBy("id")
    firsts = rows.withColumn("at", F.row_number().over(copies)).where(F.col("at") <= held)
    vectors = settled(
        firsts.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vec")
    )
    n = vectors.count()
    asked = settled(rows.where(asks).join(vectors.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), "node"))

    # A hash of the key falls evenly between the ends of 64 bits.
    part_of = F.xxhash64(F.lit(seed), "node").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    sample = vectors.where(part_of < F.lit(min(1.0, SAMPLE_ROWS / max(n, 1)))).select("vec").limit(SAMPLE_ROWS).toArrow()
    points = np.zeros((0, projections))
    if sample.num_rows:
        points = unit(matrix(sample["vec"].combine_chunks(), dim)) @ axes_here
    cells = min(-(-n // tree_rows), max(1, len(points) // CELL_SAMPLE))
    cuts = spark.sparkContext.broadcast(fit_cuts(points, cells))
    form = f"node {kind}, ids array<{kind}>, vec array<double>, cell int, point array<double>"
    placed = stored(vectors.mapInArrow(tidied(_projected(cuts, axes, dim)), form), "vectors-placed")

    told = placed.groupBy("cell").agg(
        F.count("*").alias("rows"),
        *(f(F.col("point")[i]).alias(f"{name}{i}") for i in range(projections) for name, f in (("low", F.min), ("high", F.max))),
    ).toPandas()
    all_cells = 2**cuts.value.depth
    low, high = np.full((all_cells, projections), np.inf), np.full((all_cells, projections), -np.inf)
    parts, at = np.zeros(all_cells, np.int64), told["cell"].to_numpy()
    for i in range(projections):
        low[at, i], high[at, i] = told[f"low{i}"], told[f"high{i}"]
    parts[at] = -(-told["rows"].to_numpy() // tree_rows)
    first = np.cumsum(parts) - parts
    boxes = spark.sparkContext.broadcast((low, high, first, parts))
    ranges = F.broadcast(spark.createDataFrame(list(zip(range(all_cells), first.tolist(), parts.tolist(), strict=True)), "cell int, first long, parts long"))
    salt = F.pmod(F.xxhash64(F.lit(seed + 1), "node"), F.col("parts"))
    trees = placed.join(ranges, "cell").select((F.col("first") + salt).cast("int").alias("part"), "node", "ids", "vec")
    trees = stored(trees, "vectors-dealt")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * int(parts.sum()))

    def search(queries: DataFrame) -> DataFrame:
        """(node, id, score) for queries (part, node, vec, far)."""
        blocks = settled(queries.groupBy("part").agg(F.ceil(F.count("*") / TREE_QUERIES).cast("int").alias("blocks")))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        asking = queries.join(blocks, "part").select(
            "part", block.alias("block"), F.lit(1).alias("asks"), "node", F.lit(None).cast(f"array<{kind}>").alias("ids"), "vec", "far"
        )
        indexed = trees.join(blocks, "part").select(
            "part",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.lit(0).alias("asks"),
            "node",
            "ids",
            "vec",
            F.lit(None).cast("double").alias("far"),
        )
        # A number of tasks of its own: trees take time, not room, and would else share tasks.
        both = indexed.unionByName(asking).repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "asks")
        return both.mapInArrow(tidied(_searched(axes, dim, held, reach)), f"node {kind}, id {kind}, score double")

    wanted = asked.select("node").distinct()
    queries = settled(trees.join(wanted, "node", "left_semi").select("part", "node", "vec", F.lit(math.inf).alias("far")))
    home = settled(search(queries))
    known = home.groupBy("node").agg(
        F.when(F.count("*") >= held, F.greatest(2 - 2 * F.min("score"), F.lit(0.0))).otherwise(F.lit(math.inf)).alias("far")
    )
    going = queries.drop("far").join(known, "node").select("node", "vec", "far", "part")
    routed = stored(
        going.mapInArrow(tidied(_routed(boxes, axes, dim, reach)), f"part int, node {kind}, vec array<double>, far double"),
        "vectors-routed",
    )
    best = settled(best_of(home.unionByName(search(routed)), "node", held).select("node", "id", "score"))
    pairs = asked.join(best, "node").where(F.col("id") != F.col("query_id"))
    return best_of(pairs, "query_id", top).select("query_id", "rank", F.col("id").alias(key), "score")
