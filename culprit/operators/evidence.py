"""Evidence: one wide row per (group, incident) from a few fused scans.

All incidents that blame the same table, or have it as a parent, share one aggregation
over it, whatever their number, and one more for distinct values; a relationship adds a
count of rows by key and one anti join on distinct keys.  The partial
results are unioned and folded with a single groupBy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.functions.dtypes import first_temporal, norm_dtype
from culprit.operators.probes import FACTS, column_facts, key_rows, lag_seconds, orphan_keys
from culprit.schemas import (
    EVIDENCE_DEFAULTS,
    EVIDENCE_FIELDS,
    EVIDENCE_LABELS,
    FLAG,
    REAL,
    TEXT,
    record,
)
from culprit.sources.constants import constant_frame

# --- fixed values -------------------------------------------------------------------
SLA_MINUTES = 1440.0
STALE_PARENT_MINUTES, FRESH_CHILD_MINUTES = 1440.0, 120.0
# ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """What to probe for one incident; `key` names it in the result."""

    key: str
    failing_test_kind: str
    failing_model: str
    failing_column: str | None
    blame_model: str
    blame_column: str | None
    blame_pk_column: str
    parent_table: str | None = None
    parent_pk_column: str | None = None
    expected_dtype: str | None = None
    expected_mean: float | None = None
    expected_stddev: float | None = None
    sla_minutes: float = SLA_MINUTES

    @property
    def is_relationship(self) -> bool:
        return bool(
            self.failing_test_kind == "relationships"
            and self.parent_table
            and self.parent_pk_column
            and self.blame_column
        )


def _latest(df: DataFrame) -> Column:
    """Newest value of the table's first temporal column, null without one."""
    ts = first_temporal(df.schema)
    return (F.max(ts) if ts else F.lit(None)).cast("timestamp_ntz")


# The facts a partial result may bring, with the type they are folded in.
PARTIALS = {
    "blame_row_count": "bigint",
    "blame_latest": "timestamp_ntz",
    "blame_pk_dupe_count": "bigint",
    "blame_null_rate": "double",
    "blame_cardinality_ratio": "double",
    "blame_integer_compatible_ratio": "double",
    "blame_float_compatible_ratio": "double",
    "blame_mean": "double",
    "blame_anomaly_score": "double",
    "parent_row_count": "bigint",
    "parent_latest": "timestamp_ntz",
    "parent_pk_dupe_count": "bigint",
    "parent_has_null": "boolean",
    "orphan_rows": "bigint",
}


def _per_target(slots: Sequence[tuple[str, Mapping[str, str]]]) -> Column:
    """A row per target and role out of a wide aggregate: `inline` over structs of one type.

    Facts are SQL texts over the aggregate's columns; what a target lacks is null.
    """

    def struct(key: str, facts: Mapping[str, str]) -> str:
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        fields = [f"'target', '{quoted}'"]
        for name, dtype in PARTIALS.items():
            fields.append(f"'{name}', CAST({facts.get(name, 'NULL')} AS {dtype})")
        return f"named_struct({', '.join(fields)})"

    return F.expr(f"inline(array({', '.join(struct(k, f) for k, f in slots)}))")


def _ratio(part: str, whole: str) -> str:
    return f"IF({whole} > 0, {part} / ({whole}), 0D)"


def _blame_slots(
    df: DataFrame, targets: Sequence[Target], aggs: dict[str, Column], wanted: Sequence[str]
) -> list[tuple[str, dict[str, str]]]:
    """What the targets want to know about a table that they blame, but for distinct values."""
    slots = []
    for t in targets:
        facts = {"blame_row_count": "n", "blame_latest": "latest"}
        if t.blame_column in df.columns:
            got = {}
            for fact, agg in column_facts(df, t.blame_column, wanted).items():
                if fact != "distinct_count":
                    aggs[f"{fact}_{t.blame_column}"] = agg
                    got[fact] = f"`{fact}_{t.blame_column}`"
            facts |= {
                "blame_null_rate": _ratio(got["null_count"], "n"),
                "blame_integer_compatible_ratio": got["int_ratio"],
                "blame_float_compatible_ratio": got["float_ratio"],
                "blame_mean": got["mean"],
                "blame_anomaly_score": f"abs({got['skew']})",
            }
            if "distinct_count" in wanted:
                # Where there are values, they are counted apart.
                facts["blame_cardinality_ratio"] = f"IF(n > {got['null_count']}, NULL, 0D)"
        slots.append((t.key, facts))
    return slots


def _parent_slots(
    df: DataFrame, targets: Sequence[Target], aggs: dict[str, Column]
) -> list[tuple[str, dict[str, str]]]:
    """Row count, freshness and null keys of a table that is a parent."""
    slots = []
    for t in targets:
        facts = {"parent_row_count": "n", "parent_latest": "latest"}
        if t.parent_pk_column in df.columns:
            pk = t.parent_pk_column
            aggs[f"null_{pk}"] = F.max(F.col(pk).isNull())
            facts["parent_has_null"] = f"`null_{pk}`"
        slots.append((t.key, facts))
    return slots


def _distinct_scans(
    df: DataFrame,
    blaming: Sequence[Target],
    parents: Sequence[Target],
    by: Sequence[str],
    wanted: Sequence[str],
) -> list[DataFrame]:
    """What needs distinct values: repeated keys, and how many values a blamed column has.

    All come from one aggregation that carries nothing else, which counts a column once
    whatever is asked of it; a single column is counted as in `key_rows`, without an Expand
    copy.  So are the keys of a relationship, as in `orphan_keys`, so that Spark shuffles them
    once for both.
    """
    asked: dict[str, list[tuple[str, str]]] = {}
    linked: dict[str, list[tuple[str, dict[str, str]]]] = {}
    for t in blaming:
        if t.blame_pk_column in df.columns:
            asked.setdefault(t.blame_pk_column, []).append((t.key, "blame_pk_dupe_count"))
        if t.blame_column in df.columns and "distinct_count" in wanted:
            if t.is_relationship:
                ratio = _ratio("distinct_values", "filled")
                linked.setdefault(t.blame_column, []).append((t.key, {"blame_cardinality_ratio": ratio}))
            else:
                asked.setdefault(t.blame_column, []).append((t.key, "blame_cardinality_ratio"))
    for t in parents:
        if t.parent_pk_column in df.columns:
            asked.setdefault(t.parent_pk_column, []).append((t.key, "parent_pk_dupe_count"))
    parts = []
    if asked:
        aggs = {"n": F.count(F.lit(1))}
        slots = []
        for column, facts in asked.items():
            keys, filled = f"`keys_{column}`", f"`filled_{column}`"
            aggs[f"keys_{column}"] = F.count_distinct(F.struct(column))  # null is a key like any other
            aggs[f"filled_{column}"] = F.count(column)
            values = f"({keys} - IF({filled} < n, 1, 0))"
            for target, fact in facts:
                told = _ratio(values, filled) if fact == "blame_cardinality_ratio" else f"n - {keys}"
                slots.append((target, {fact: told}))
        if len(asked) == 1:
            (column,) = asked
            counts = key_rows(df, column, by)
            rows = F.col("n")
            aggs = {
                "n": F.coalesce(F.sum(rows), F.lit(0)),
                f"keys_{column}": F.count(F.lit(1)),
                f"filled_{column}": F.coalesce(F.sum(F.when(F.col("key").isNotNull(), rows)), F.lit(0)),
            }
        else:
            counts = df
        wide = counts.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
        parts.append(wide.select(*by, _per_target(slots)))
    for column, told in linked.items():
        counts = key_rows(df.filter(F.col(column).isNotNull()), column, by).groupBy(*by).agg(
            F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("filled")
        )
        parts.append(counts.select(*by, _per_target(told)))
    return parts


def table_scan(
    df: DataFrame,
    blaming: Sequence[Target],
    parents: Sequence[Target],
    by: Sequence[str],
    wanted: Sequence[str] = FACTS,
) -> DataFrame:
    """Everything the targets want to know about one table, a row per group, target and source.

    `blaming` are the targets that blame the table, `parents` those that have it as parent;
    a key that is asked for in both roles is counted once.  Distinct values are counted apart
    from the other facts, whose state every row would carry along once per such column.
    """
    aggs = {"n": F.count(F.lit(1)), "latest": _latest(df)}
    slots = [*_blame_slots(df, blaming, aggs, wanted), *_parent_slots(df, parents, aggs)]
    wide = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
    parts = [wide.select(*by, _per_target(slots)), *_distinct_scans(df, blaming, parents, by, wanted)]
    return reduce(DataFrame.unionByName, parts)


def target_frame(spark: SparkSession, targets: Sequence[Target]) -> DataFrame:
    schema = record(
        target=TEXT,
        **dict.fromkeys(EVIDENCE_LABELS, TEXT),
        expected_dtype=TEXT,
        expected_mean=REAL,
        expected_stddev=REAL,
        sla_minutes=REAL,
        actual_dtype=TEXT,
        is_relationship=FLAG,
    )
    return constant_frame(
        spark,
        [
            (
                t.key,
                *[getattr(t, name) for name in EVIDENCE_LABELS],
                t.expected_dtype,
                t.expected_mean,
                t.expected_stddev,
                t.sla_minutes,
                None,
                t.is_relationship,
            )
            for t in targets
        ],
        schema,
    )


def assemble_evidence(
    targets: Sequence[Target],
    tables: Mapping[str, DataFrame],
    *,
    by: Sequence[str] = (),
    groups: Sequence[str] | None = None,
    observed_at: datetime | str | None = None,
    baselines: DataFrame | None = None,
    slas: DataFrame | None = None,
    wanted: Sequence[str] = FACTS,
    ignore_null_parents: bool = False,
    use_skew: bool = True,
    fanout_parent_only: bool = False,
) -> DataFrame:
    """Evidence for every target (and group).

    `observed_at` is the clock for freshness; without it there is no freshness
    evidence, because a wall clock would call all historic data late.  `baselines`
    (target, expected_dtype, expected_mean, expected_stddev, and optionally the `by`
    columns) overrides the expectations in the targets; `slas` (blame_model, sla_minutes)
    overrides how old a table may be.  `wanted` names the column facts
    to compute; the others count as not known.

    Every target has its row, in every group, whatever could be probed: a table or column
    that is not there leaves neutral values.
    """
    spark = next(iter(tables.values())).sparkSession
    parts: list[DataFrame] = []

    def split(df: DataFrame) -> list[str]:
        return [c for c in by if c in df.columns]

    def spread(df: DataFrame) -> DataFrame:
        """Facts of a table that is not split hold for every group."""
        if not by or split(df) == list(by) or groups is None:
            return df
        return df.withColumn(by[0], F.explode(F.array(*[F.lit(g) for g in groups])))

    loose: list[DataFrame] = []

    def keep(df: DataFrame) -> None:
        df = spread(df)
        (parts if split(df) == list(by) else loose).append(df)

    for name in dict.fromkeys(n for t in targets for n in (t.blame_model, t.parent_table) if n):
        if name in tables:
            blaming = [t for t in targets if t.blame_model == name]
            parents = [t for t in targets if t.parent_table == name]
            keep(table_scan(tables[name], blaming, parents, split(tables[name]), wanted))
    for t in targets:
        if t.is_relationship and t.blame_model in tables and t.parent_table in tables:
            child, parent = tables[t.blame_model], tables[t.parent_table]
            if t.blame_column in child.columns and t.parent_pk_column in parent.columns:
                found = orphan_keys(
                    child, t.blame_column, parent, t.parent_pk_column, by=by, groups=groups
                )
                cols = split(found)
                counted = found.groupBy(*cols).agg(F.sum("child_rows").alias("c"))
                keep(counted.select(*cols, _per_target([(t.key, {"orphan_rows": "c"})])))

    # A row without facts for every target, so that one that cannot be probed stays.
    keys = [F.lit(t.key) for t in targets]
    blank = [F.lit(None).cast(t).alias(c) for c, t in PARTIALS.items()]
    if not by or groups is not None:
        spots = spark.range(1).select(F.explode(F.array(*keys)).alias("target"))
        for c in by:
            spots = spots.withColumn(c, F.explode(F.array(*[F.lit(g) for g in groups])))
        parts.append(spots.select(*by, "target", *blank))
    elif parts:
        # The groups are those of the tables that could be probed.
        gone = [F.lit(t.key) for t in targets if t.blame_model not in tables]
        if gone:
            seen = reduce(DataFrame.unionByName, [p.select(*by) for p in parts]).distinct()
            parts.append(seen.select(*by, F.explode(F.array(*gone)).alias("target"), *blank))
    else:
        raise ValueError("no table to probe holds the groups; name them in `groups`")

    def fold(frames: list[DataFrame], keys: Sequence[str]) -> DataFrame:
        union = reduce(DataFrame.unionByName, frames)
        return union.groupBy(*keys, "target").agg(*[F.max(name).alias(name) for name in PARTIALS])

    facts = fold(parts, by)
    if loose:
        # One row per target: facts of tables without groups, given to every group.
        wide = fold(loose, [])
        wide = wide.select("target", *[F.col(n).alias(f"all_{n}") for n in PARTIALS])
        facts = facts.join(F.broadcast(wide), "target", "left")
        facts = facts.select(
            *by, "target", *[F.coalesce(n, f"all_{n}").alias(n) for n in PARTIALS]
        )
    return from_facts(
        facts,
        targets,
        tables,
        by=by,
        observed_at=observed_at,
        baselines=baselines,
        slas=slas,
        ignore_null_parents=ignore_null_parents,
        use_skew=use_skew,
        fanout_parent_only=fanout_parent_only,
    )


def from_facts(
    facts: DataFrame,
    targets: Sequence[Target],
    tables: Mapping[str, DataFrame],
    *,
    by: Sequence[str] = (),
    observed_at: datetime | str | None = None,
    baselines: DataFrame | None = None,
    slas: DataFrame | None = None,
    ignore_null_parents: bool = False,
    use_skew: bool = True,
    fanout_parent_only: bool = False,
) -> DataFrame:
    """Evidence rows from the facts of PARTIALS by (`by`, target)."""
    spark = facts.sparkSession
    dtypes = {
        t.key: tables[t.blame_model].schema[t.blame_column].dataType.simpleString()
        for t in targets
        if t.blame_model in tables and t.blame_column in tables[t.blame_model].columns
    }
    # One row per target, built from the list above: its length bounds the broadcast.
    known = target_frame(spark, targets)
    actual: Column = F.lit(None).cast("string")
    for key, dtype in dtypes.items():
        actual = F.when(F.col("target") == key, dtype).otherwise(actual)
    known = known.withColumn("actual_dtype", actual)
    rows = facts.join(F.broadcast(known), "target")
    if baselines is not None:
        on = ["target", *[c for c in by if c in baselines.columns]]
        given = ["expected_dtype", "expected_mean", "expected_stddev"]
        base = baselines.select(
            *on, *[F.col(c).alias(f"given_{c}") for c in given if c in baselines.columns]
        )
        rows = rows.join(base, on, "left")
        for c in given:
            if c in baselines.columns:
                rows = rows.withColumn(c, F.coalesce(f"given_{c}", c))
    if slas is not None:
        given = slas.select("blame_model", F.col("sla_minutes").alias("given_sla"))
        rows = rows.join(given, "blame_model", "left").withColumn(
            "sla_minutes", F.coalesce("given_sla", "sla_minutes")
        )
    return _derive(rows, by, observed_at, ignore_null_parents, use_skew, fanout_parent_only)


def _derive(
    rows: DataFrame,
    by: Sequence[str],
    observed_at: datetime | str | None,
    ignore_null_parents: bool,
    use_skew: bool,
    fanout_parent_only: bool,
) -> DataFrame:
    if observed_at is None:
        blame_lag = parent_lag = F.lit(None).cast("double")
    else:
        blame_lag = lag_seconds(F.col("blame_latest"), observed_at) / 60
        parent_lag = lag_seconds(F.col("parent_latest"), observed_at) / 60
    nullable = F.col("parent_has_null") if not ignore_null_parents else F.lit(False)
    child_dupes = F.lit(False) if fanout_parent_only else F.col("blame_pk_dupe_count") > 0
    drift = F.when(
        F.col("expected_stddev") > 0,
        F.abs(F.col("blame_mean") - F.col("expected_mean")) / F.col("expected_stddev"),
    )
    derived = {
        "blame_lag_ratio": blame_lag / F.col("sla_minutes"),
        "blame_dtype_mismatch": norm_dtype(F.col("actual_dtype"))
        != norm_dtype(F.col("expected_dtype")),
        "blame_join_fanout_risk": F.coalesce(child_dupes, F.lit(False))
        | F.coalesce(F.col("parent_pk_dupe_count") > 0, F.lit(False)),
        "blame_value_drift_z": drift,
        "blame_stale_dimension": (parent_lag > STALE_PARENT_MINUTES)
        & (F.coalesce(blame_lag, F.lit(0.0)) < FRESH_CHILD_MINUTES),
        "blame_anomaly_score": F.col("blame_anomaly_score") if use_skew else F.lit(0.0),
        "orphan_fk_count": F.when(~F.coalesce(nullable, F.lit(False)), F.col("orphan_rows")),
        "parent_row_count": F.when(F.col("is_relationship"), F.col("parent_row_count")),
    }
    rows = rows.withColumns(derived)
    neutral = {
        name: F.coalesce(F.col(name), F.lit(value)).alias(name)
        for name, value in EVIDENCE_DEFAULTS.items()
    }
    return rows.select(*by, "target", *[neutral.get(n, F.col(n)) for n in EVIDENCE_FIELDS])


def schema_mismatch(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Type differences between two (table_name, column_name, dtype) frames."""
    on = ["table_name", "column_name"]
    both = actual.join(expected.withColumnRenamed("dtype", "expected_dtype"), on)
    return both.withColumn(
        "dtype_mismatch", norm_dtype(F.col("dtype")) != norm_dtype(F.col("expected_dtype"))
    )


def fingerprint(extra: Column | None = None) -> Column:
    """Stable hash of an evidence row, nulls included."""
    names = sorted(EVIDENCE_FIELDS)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    if extra is not None:
        body = F.concat(body, extra)
    return F.sha2(body, 256)
