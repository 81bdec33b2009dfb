"""Where did it come from: column lineage walked over an edge table.

Edges and nodes describe models, not data, so a walk only ever touches metadata.
Starts are reduced to distinct (model, column) pairs before the walk; a fleet of
incidents joins the finished walks afterwards.  No join is hinted: edge tables are
small enough for Spark to broadcast by its own size check, and larger ones shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from culprit.functions.keys import length_then_text, text_key
from culprit.schemas import EDGE, WALK_STEP
from culprit.sources.constants import constant_frame

# --- fixed values ------------------------------------------------------------------
DIRECT_CERTAINTY, AGG_CERTAINTY, NO_HOP_CERTAINTY = 1.0, 0.6, 0.5
OTHER_KEY_FACTOR = 0.7
DEFAULT_KEY = "id"
# -----------------------------------------------------------------------------------


# Hops that one job follows, and the hops and places up to which a walk is pruned first.
HOPS_AT_ONCE, PRUNED_HOPS, PRUNED_PLACES = 4, 32, 100_000

WALK_STEP_ARRAY = f"array<{WALK_STEP.simpleString()}>"


def edge_frame(spark: SparkSession, edges: Sequence[tuple]) -> DataFrame:
    """(down model, down column, up model, up column, agg, window, cast[, ordinal]) rows."""
    rows = [e if len(e) == 8 else (*e, 0) for e in edges]
    return constant_frame(spark, rows, EDGE)


def transform_tag() -> Column:
    """What an edge does to its column; losing row identity outranks the rest."""
    return (
        F.when(F.col("has_agg"), "AGG")
        .when(F.col("has_window"), "WINDOW")
        .when(F.col("has_cast"), "CAST")
        .otherwise("DIRECT")
    )


def edge_certainty(crossed_agg: Column) -> Column:
    return F.when(crossed_agg, AGG_CERTAINTY).otherwise(DIRECT_CERTAINTY)


def hops(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The one edge a walk follows out of each column: the first by ordinal.

    With a node table, only models have upstreams; seeds and sources end a walk.
    """
    first = edges.groupBy("downstream_model", "downstream_column").agg(
        F.min_by(
            F.struct("upstream_model", "upstream_column", "has_agg", "has_window", "has_cast"),
            F.struct("ordinal", "upstream_model", "upstream_column"),
        ).alias("up")
    )
    flat = first.select("downstream_model", "downstream_column", "up.*").withColumn(
        "transform_type", transform_tag()
    )
    if nodes is not None:
        models = nodes.filter(F.col("kind") == "model").select(
            F.col("name").alias("downstream_model")
        )
        flat = flat.join(models, "downstream_model", "left_semi")
    return flat.select(
        "downstream_model",
        "downstream_column",
        "upstream_model",
        "upstream_column",
        "transform_type",
        F.col("has_agg").alias("crossed_agg"),
    )


def _rounds(step: DataFrame) -> int:
    """How often paths must double until none goes on.

    Works on (model, column) pairs alone: jumps of 1, 2, 4, ... steps, until there is none
    so long.  A walk in a circle has seen all of it when it is longer than there are
    places.
    """
    # A row per model column, read by every job below.
    step = step.coalesce(1).persist()
    places = step.count()
    jumps = step.select(
        F.struct(F.col("at_model").alias("m"), F.col("at_column").alias("c")).alias("node"),
        F.struct(F.col("upstream_model").alias("m"), F.col("upstream_column").alias("c")).alias(
            "reached"
        ),
    )
    rounds = 0
    while True:
        rounds += 1
        far = jumps.select(F.col("node").alias("reached"), F.col("reached").alias("next"))
        jumps = jumps.join(far, "reached").select("node", F.col("next").alias("reached"))
        if 2**rounds > places or jumps.isEmpty():
            step.unpersist()
            return rounds


def _on_the_way(asked: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`asked`, and the steps that walks from there can take.

    The asked places and those reached come to the driver as metadata, PRUNED_PLACES at
    most, so that neither is computed again.  With more of them, or beyond PRUNED_HOPS, all
    steps are given back, which lead to the same walks.
    """
    spark = asked.sparkSession
    places = asked.limit(PRUNED_PLACES + 1).collect()
    if len(places) > PRUNED_PLACES:
        return asked, step
    asked = constant_frame(spark, [tuple(p) for p in places], asked.schema)
    at, up = ["at_model", "at_column"], [F.col("upstream_model"), F.col("upstream_column")]
    here = asked.toDF(*at)
    found: dict[tuple, tuple] = {}
    held = step.persist()
    for _ in range(PRUNED_HOPS // HOPS_AT_ONCE):
        taken = None
        for hop in range(HOPS_AT_ONCE):
            out = here.join(held, at).select(*step.columns, F.lit(hop).alias("hop"))
            taken = out if taken is None else taken.unionByName(out)
            here = out.select(*up).distinct().toDF(*at)
        ends = set()
        new = taken.limit(HOPS_AT_ONCE * PRUNED_PLACES + 1).collect()
        for *row, hop in new:
            found[tuple(row[:2])] = tuple(row)
            if hop == HOPS_AT_ONCE - 1:
                ends.add(tuple(row[2:4]))
        if len(found) > PRUNED_PLACES or len(new) > HOPS_AT_ONCE * PRUNED_PLACES:
            break
        ends -= found.keys()
        if not ends:
            step = constant_frame(spark, list(found.values()), step.schema)
            break
        here = constant_frame(spark, sorted(ends), asked.schema).toDF(*at)
    held.unpersist()
    return asked, step


def _until_seen_again(moves: Column) -> Column:
    """The moves of a path up to the one that would enter a place a second time."""

    def place(move: Column, side: str) -> Column:
        return F.concat_ws("\u0000", move["step"][f"{side}_model"], move["step"][f"{side}_column"])

    visited = F.concat(
        F.array(place(F.get(moves, F.lit(0)), "downstream")),
        F.transform(moves, lambda m: place(m, "upstream")),
    )
    # The i-th move enters visited[i]; array positions begin with 1.
    stays = F.transform(
        F.slice(visited, 2, F.size(moves)), lambda v, i: F.array_position(visited, v) <= i + 1
    )
    first = F.array_position(stays, F.lit(True))
    return F.when(first > 0, F.slice(moves, F.lit(1), (first - 1).cast("int"))).otherwise(moves)


def walk_lineage(
    starts: DataFrame, edges: DataFrame, nodes: DataFrame | None = None
) -> DataFrame:
    """Follow each distinct (model, column) upstream until nothing leads further.

    Paths double: each round joins the paths so far with those that begin where they end,
    so a walk of any length takes as many rounds as its length has binary digits.  Paths
    are made of the steps that the starts lead to, not of the project's other columns.  A
    walk that would enter a column twice stops there.
    """
    step = hops(edges, nodes).select(
        F.col("downstream_model").alias("at_model"),
        F.col("downstream_column").alias("at_column"),
        "upstream_model",
        "upstream_column",
        "transform_type",
        "crossed_agg",
    )
    asked, step = _on_the_way(
        starts.select("model", F.coalesce("column", F.lit("")).alias("column")).distinct(), step
    )
    edge = F.struct(
        F.col("at_model").alias("downstream_model"),
        F.col("at_column").alias("downstream_column"),
        "upstream_model",
        "upstream_column",
        "transform_type",
        edge_certainty(F.col("crossed_agg")).alias("attribution_certainty"),
    ).cast(WALK_STEP)
    # A path: where it starts, and its steps with whether each crossed an aggregation.
    move = F.struct(edge.alias("step"), F.col("crossed_agg").alias("agg"))
    paths = step.select("at_model", "at_column", F.array(move).alias("moves"))
    none = F.array().cast(paths.schema["moves"].dataType)
    for _ in range(_rounds(step)):
        end = F.get("moves", F.size("moves") - 1)["step"]
        more = paths.select(
            F.col("at_model").alias("end_model"),
            F.col("at_column").alias("end_column"),
            F.col("moves").alias("more"),
        )
        longer = paths.withColumns(
            {"end_model": end["upstream_model"], "end_column": end["upstream_column"]}
        ).join(more, ["end_model", "end_column"], "left")
        paths = longer.select(
            "at_model",
            "at_column",
            _until_seen_again(F.concat("moves", F.coalesce("more", none))).alias("moves"),
        )
    paths = paths.select(
        F.col("at_model").alias("model"),
        F.col("at_column").alias("column"),
        _until_seen_again(F.col("moves")).alias("moves"),
    )
    moves = F.coalesce("moves", none)
    met = asked.join(paths, ["model", "column"], "left").select(
        "model",
        "column",
        F.transform(moves, lambda m: m["step"]).alias("walk_path"),
        F.exists(moves, lambda m: m["agg"]).alias("hit"),
    )
    n_hops, hit = F.size("walk_path"), F.col("hit")
    last = F.get("walk_path", n_hops - 1)
    return met.select(
        "model",
        "column",
        F.coalesce(last["upstream_model"], "model").alias("blame_model"),
        F.coalesce(last["upstream_column"], "column").alias("blame_column"),
        F.when(n_hops == 0, NO_HOP_CERTAINTY).otherwise(edge_certainty(hit)).alias("certainty"),
        hit.alias("hit_agg_boundary"),
        n_hops.alias("hops"),
        "walk_path",
    )


# Parts that the keys of one place are dealt into, and the places times parts that may be
# copied for it.
PLACE_PARTS, COPIED_PLACES = 1024, 1_000_000


def carry_keys(keys: DataFrame, blamed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys travel unchanged; past an aggregation they no longer name rows and drop out.

    A handful of places hold all keys, so keys are dealt by their own hash too and each part
    meets a copy of the places.  Those are counted first: there are as many parts as leave
    the copies few, and with very many places each has few keys and needs no parts.
    """
    kept = blamed.filter(~F.col("hit_agg_boundary")).select(*on).distinct()
    parts = max(1, min(PLACE_PARTS, COPIED_PLACES // max(1, kept.count())))
    if parts == 1:
        return keys.join(kept, list(on), "left_semi")
    copies = kept.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = keys.withColumn("_part", F.pmod(F.xxhash64("pk"), F.lit(parts)).cast("int"))
    return dealt.join(copies, [*on, "_part"], "left_semi").drop("_part")


def first_keys(rows: DataFrame, by: Sequence[str], limit: int) -> DataFrame:
    """The first `limit` keys of each group in display order (length, text), ranked.

    Spark pushes the rank filter below the shuffle as a per-task group limit, so a
    group of any size sends at most `limit` rows per task.
    """
    order = Window.partitionBy(*by).orderBy(length_then_text(F.col("pk")))
    ranked = rows.select(*by, "pk").withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= limit)


def verify_rows(upstream: DataFrame, upstream_pk: str, keys: DataFrame) -> DataFrame:
    """How many of the carried keys exist upstream."""
    wanted = keys.select("pk").distinct()
    found = wanted.join(
        upstream.select(text_key(upstream_pk).alias("pk")), "pk", "left_semi"
    )
    return found.agg(F.count(F.lit(1)).alias("verified_rows"))


def key_column(model: Column, pk_map: Mapping[str, str]) -> Column:
    """Primary-key column of a model: the given map, else `id`."""
    known = F.lit(DEFAULT_KEY)
    for name, pk in pk_map.items():
        known = F.when(model == name, pk).otherwise(known)
    return known


@dataclass(frozen=True)
class KeyedEdge:
    downstream_model: str
    downstream_column: str
    upstream_model: str
    upstream_column: str
    downstream_pk: str
    upstream_pk: str


def keyed_attribution(
    tables: Mapping[str, DataFrame],
    edges: Sequence[KeyedEdge],
    model: str,
    column: str,
    pk: str,
    keys: DataFrame,
) -> DataFrame:
    """Attribution that re-reads the keys at every hop (one semi join each).

    It ends where no edge leads further, or where the walk has been before.
    """
    known = {(e.downstream_model, e.downstream_column): e for e in edges}
    certainty = 1.0
    rows = keys.select("pk")
    seen = set()
    while (edge := known.get((model, column))) is not None and (model, column) not in seen:
        seen.add((model, column))
        if edge.downstream_pk != pk:
            certainty *= OTHER_KEY_FACTOR
        upstream = tables[edge.upstream_model].select(text_key(edge.upstream_pk).alias("pk"))
        rows = upstream.join(rows, "pk", "left_semi")
        model, column, pk = edge.upstream_model, edge.upstream_column, edge.upstream_pk
    return rows.select(
        F.lit(model).alias("blame_model"),
        F.lit(column).alias("blame_column"),
        F.lit(certainty).alias("certainty"),
        "pk",
    )
