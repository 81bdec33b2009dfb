"""Failing rows carried upstream through joins, groups and windows, hop by hop.

A frontier is a place (model, column) with the keys of its suspect rows and how certain they
are.  Each hop finds the keys one model further up, by the values that the transformation
matches rows with, and multiplies the certainty.  Paths depend on the project alone; rows
only ever meet in semi joins on distinct values, so a value that many rows share is one row
of the smaller side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.functions.keys import text_key

# --- fixed values: what a hop leaves of the certainty, and where a walk gives up ----------
DIRECT, CAST, JOIN_KEY, AGG, WINDOW, OPAQUE = "DIRECT", "CAST", "JOIN_KEY", "AGG", "WINDOW", "UDF"
HOP_CERTAINTY = {DIRECT: 1.0, CAST: 0.95, JOIN_KEY: 0.85, AGG: 0.7, WINDOW: 0.8}
LEAST_CERTAINTY = 0.5
# ------------------------------------------------------------------------------------------

# Why a branch ended.
SOURCE, AGG_BOUNDARY, UNSURE, CIRCLE = "source", "agg_boundary", "unsure", "circle"


@dataclass(frozen=True)
class CarryEdge:
    """A column and what it is made of.

    `on` pairs the downstream columns with the upstream ones that match rows: the join key,
    the group's columns or the window's partition.  Rows keep their keys through DIRECT and
    CAST, which need none.
    """

    downstream_model: str
    downstream_column: str
    upstream_model: str
    upstream_column: str
    kind: str = DIRECT
    on: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Reached:
    """Where a branch ended: the place, how certain, why, after how many hops; and its keys."""

    model: str
    column: str
    certainty: float
    ended: str
    hops: int
    keys: DataFrame


def hop_keys(
    edge: CarryEdge, tables: Mapping[str, DataFrame], pks: Mapping[str, str], keys: DataFrame
) -> DataFrame:
    """(pk): keys of the upstream rows behind the downstream rows `keys`."""
    up, up_pk = tables[edge.upstream_model], pks[edge.upstream_model]
    if edge.kind in (DIRECT, CAST):
        return up.select(text_key(up_pk).alias("pk")).join(keys, "pk", "left_semi").distinct()
    if not edge.on:
        raise ValueError(f"{edge.kind} needs the columns that match rows: {edge}")
    down = tables[edge.downstream_model].withColumn("pk", text_key(pks[edge.downstream_model]))
    # Groups and windows put nulls together; joins never match them.
    names = [f"_on{i}" for i in range(len(edge.on))]
    values = down.join(keys, "pk", "left_semi").select(
        *[F.struct(F.col(d).alias("v")).alias(n) for n, (d, _) in zip(names, edge.on, strict=True)]
    )
    if edge.kind == JOIN_KEY:
        values = values.filter(" and ".join(f"{n}.v is not null" for n in names))
    matched = up.withColumns(
        {n: F.struct(F.col(u).alias("v")) for n, (_, u) in zip(names, edge.on, strict=True)}
    ).join(values.distinct(), names, "left_semi")
    return matched.select(text_key(up_pk).alias("pk")).filter(F.col("pk").isNotNull()).distinct()


def carry_rows(
    tables: Mapping[str, DataFrame],
    edges: Sequence[CarryEdge],
    pks: Mapping[str, str],
    model: str,
    column: str,
    keys: DataFrame,
) -> list[Reached]:
    """The ends of all branches that lead up from `column`, for the failing rows `keys` (pk).

    A branch ends at a source, behind an aggregation, where an opaque function or too little
    certainty lets nothing be said, or where it would enter a place again.  All frames are
    lazy; a frontier that several branches share is one plan.
    """
    upstream: dict[tuple[str, str], list[CarryEdge]] = {}
    for e in edges:
        upstream.setdefault((e.downstream_model, e.downstream_column), []).append(e)
    ends: list[Reached] = []
    queue = [(model, column, 1.0, 0, keys.select("pk").distinct(), frozenset([(model, column)]))]
    while queue:
        model, column, certainty, hops, rows, seen = queue.pop(0)
        onward = upstream.get((model, column), [])
        if not onward:
            ends.append(Reached(model, column, certainty, SOURCE, hops, rows))
        for e in onward:
            place = (e.upstream_model, e.upstream_column)
            if e.kind == OPAQUE:
                ends.append(Reached(model, column, certainty, OPAQUE.lower(), hops, rows))
            elif place in seen:
                ends.append(Reached(model, column, certainty, CIRCLE, hops, rows))
            else:
                sure = certainty * HOP_CERTAINTY[e.kind]
                found = hop_keys(e, tables, pks, rows)
                if e.kind == AGG:
                    ends.append(Reached(*place, sure, AGG_BOUNDARY, hops + 1, found))
                elif sure <= LEAST_CERTAINTY:
                    ends.append(Reached(*place, sure, UNSURE, hops + 1, found))
                else:
                    queue.append((*place, sure, hops + 1, found, seen | {place}))
    return ends


def carried(ends: Sequence[Reached]) -> DataFrame:
    """(blame_model, blame_column, pk, certainty, ended, hops): each row by its surest branch."""
    frames = [
        e.keys.select(
            F.lit(e.model).alias("blame_model"),
            F.lit(e.column).alias("blame_column"),
            "pk",
            F.struct(
                F.lit(e.certainty).alias("certainty"), F.lit(-e.hops).alias("less"), F.lit(e.ended).alias("ended")
            ).alias("how"),
        )
        for e in ends
    ]
    best = reduce(DataFrame.unionByName, frames).groupBy("blame_model", "blame_column", "pk").agg(
        F.max("how").alias("how")
    )
    return best.select(
        "blame_model", "blame_column", "pk", "how.certainty", "how.ended", (-F.col("how.less")).alias("hops")
    )
