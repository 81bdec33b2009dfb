"""Tests and evidence of many runs, from the clean tables and what each run changes.

A run's change of a table is a set of signed rows: those it adds (`sign` 1) and those it
takes away (-1), told apart by `by`.  Facts of the clean tables are counted once, whatever
the number of runs.  A run's facts are these plus what its changed rows contribute; where a
fact depends on how often a key occurs, only the keys that a run touches are looked up.  The
cost follows the tables and the changes, not their product.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.dtypes import first_temporal, is_numeric, is_text
from culprit.functions.keys import text_key
from culprit.operators.datatests import DataTest, run_tests
from culprit.operators.evidence import PARTIALS, Target
from culprit.operators.probes import FACTS, FLOAT_TEXT, INTEGER_TEXT

SIGN = "sign"

# A variance this much smaller than the values' own is what rounding leaves of none.
NO_SPREAD = 1e-12


def to_groups(df: DataFrame, by: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """The few rows of a clean result for every run."""
    return df.withColumn(by[0], F.explode(F.array(*[F.lit(g) for g in groups])))


def counted(df: DataFrame, column: str) -> DataFrame:
    """(key, n) of the clean rows.  Keys are wrapped, so that null is one like any other."""
    return df.groupBy(F.struct(F.col(column).alias("v")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def touched(change: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, key, d): keys whose number of rows a run changes, and by how much."""
    moved = change.groupBy(*by, F.struct(F.col(column).alias("v")).alias("key")).agg(F.sum(SIGN).alias("d"))
    return moved.filter(F.col("d") != 0)


def met_counts(clean: DataFrame, change: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by, key, n, d): touched keys with their clean number of rows, 0 if they are new."""
    met = touched(change, column, by).join(counted(clean, column), "key", "left")
    return met.withColumn("n", F.coalesce("n", F.lit(0)))


def _more(after: Column, before: Column) -> Column:
    """Sum of what a number per key gains."""
    return F.coalesce(F.sum(after.cast("bigint") - before.cast("bigint")), F.lit(0))


def link_counts(
    child: DataFrame,
    fk: str,
    parent: DataFrame,
    pk: str,
    child_change: DataFrame | None,
    parent_change: DataFrame | None,
    by: Sequence[str],
) -> DataFrame:
    """(by, key, dc, dp, nc, np): touched keys of either side with the rows of both."""
    sides = []
    for change, column, own in ((child_change, fk, "dc"), (parent_change, pk, "dp")):
        if change is not None:
            moved = touched(change, column, by).filter(F.col("key.v").isNotNull())
            both = [F.col("d").alias(n) if n == own else F.lit(0).cast("bigint").alias(n) for n in ("dc", "dp")]
            sides.append(moved.select(*by, "key", *both))
    moved = reduce(DataFrame.unionByName, sides)
    if len(sides) > 1:
        moved = moved.groupBy(*by, "key").agg(F.sum("dc").alias("dc"), F.sum("dp").alias("dp"))
    met = moved.join(counted(child, fk).withColumnRenamed("n", "nc"), "key", "left")
    met = met.join(counted(parent, pk).withColumnRenamed("n", "np"), "key", "left")
    return met.fillna(0, ["nc", "np"])


def _orphan_gain() -> Column:
    before = F.when(F.col("np") == 0, F.col("nc")).otherwise(0)
    after = F.when(F.col("np") + F.col("dp") <= 0, F.col("nc") + F.col("dc")).otherwise(0)
    return _more(after, before)


def test_changes(
    models: Mapping[str, DataFrame],
    changes: Mapping[str, DataFrame],
    tests: Sequence[DataTest],
    by: Sequence[str],
) -> DataFrame | None:
    """(by, test_name, gain): how many failures more, or less, a run has than the clean one."""
    n, now = F.col("n"), F.col("n") + F.col("d")
    parts = []

    def keep(rows: DataFrame, test: DataTest, gain: Column) -> None:
        parts.append(rows.groupBy(*by).agg(gain.alias("gain")).select(*by, F.lit(test.name).alias("test_name"), "gain"))

    for t in tests:
        change, parent_change = changes.get(t.model), changes.get(t.parent_model)
        if t.kind == "relationships" and not (change is None and parent_change is None):
            met = link_counts(
                models[t.model], t.column, models[t.parent_model], t.parent_column, change, parent_change, by
            )
            keep(met, t, _orphan_gain())
        elif change is None:
            continue
        elif t.kind == "not_null":
            keep(change.filter(F.col(t.column).isNull()), t, F.sum(SIGN))
        elif t.kind == "unique":
            met = met_counts(models[t.model], change, t.column, by).filter(F.col("key.v").isNotNull())
            keep(met, t, _more(now > 1, n > 1))
        elif t.kind == "accepted_values":
            met = met_counts(models[t.model], change, t.column, by).filter(~F.col("key.v").isin(*t.accepted))
            keep(met, t, _more(now > 0, n > 0))
    return reduce(DataFrame.unionByName, parts) if parts else None


def run_tests_changed(
    models: Mapping[str, DataFrame],
    changes: Mapping[str, DataFrame],
    tests: Sequence[DataTest],
    *,
    by: Sequence[str],
    groups: Sequence[str],
) -> DataFrame:
    """Status and failure count of every test in every run."""
    clean = to_groups(run_tests(models, tests).select("test_name", "failures"), by, groups)
    gains = test_changes(models, changes, tests, by)
    if gains is not None:
        clean = clean.join(gains, [*by, "test_name"], "left").withColumn(
            "failures", F.col("failures") + F.coalesce("gain", F.lit(0))
        )
    status = F.when(F.col("failures") > 0, "fail").otherwise("pass")
    return clean.select(*by, "test_name", "failures", status.alias("status"))


# --- evidence ---------------------------------------------------------------------------


def _sum(part: Column) -> Column:
    return F.coalesce(F.sum(part), F.lit(0))


def _after(clean: DataFrame, change: DataFrame, by: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One row of clean facts for every run, beside what the run changes (null if nothing)."""
    return to_groups(clean, by, groups).join(change, list(by), "left")


def latest_after(
    clean: DataFrame, change: DataFrame, by: Sequence[str], groups: Sequence[str], loses: bool
) -> DataFrame | None:
    """(by, latest): the newest value of the first temporal column in every run.

    Added rows can only raise it.  Where rows go for good (`loses`), the clean table's
    distinct values meet what each run has lost of them.
    """
    ts = first_temporal(clean.schema)
    if ts is None:
        return None
    own = change.filter(F.col(SIGN) > 0).groupBy(*by).agg(F.max(ts).alias("own"))
    if loses:
        gone = met_counts(clean, change, ts, by).filter(F.col("n") + F.col("d") <= 0).select(*by, "key")
        kept = to_groups(counted(clean, ts), by, groups).join(gone, [*by, "key"], "left_anti")
        base = kept.groupBy(*by).agg(F.max("key.v").alias("base"))
    else:
        base = to_groups(clean.agg(F.max(ts).alias("base")), by, groups)
    told = base.join(own, list(by), "left")
    return told.select(*by, F.greatest("base", "own").cast("timestamp_ntz").alias("latest"))


def extra_after(
    clean: DataFrame, change: DataFrame, pk: str, by: Sequence[str], groups: Sequence[str]
) -> DataFrame:
    """(by, extra): rows beyond the first of each key, null being one like any other."""
    n, now = F.col("n"), F.col("n") + F.col("d")
    base = counted(clean, pk).agg(_sum(F.col("n") - 1).alias("base"))
    gain = met_counts(clean, change, pk, by).groupBy(*by).agg(
        _more(F.greatest(now - 1, F.lit(0)), F.greatest(n - 1, F.lit(0))).alias("gain")
    )
    told = _after(base, gain, by, groups)
    return told.select(*by, (F.col("base") + F.coalesce("gain", F.lit(0))).alias("extra"))


def column_after(
    clean: DataFrame,
    change: DataFrame,
    column: str,
    by: Sequence[str],
    groups: Sequence[str],
    wanted: Sequence[str] = FACTS,
) -> DataFrame:
    """(by, rows, nulls, distinct, ints, floats, mean, skew) of one column in every run.

    Moments of a run are sums of powers around the clean mean, which changed rows add to
    and take from; a column that is no number has none, as elsewhere.
    """
    dtype, col = clean.schema[column].dataType, F.col(column)
    zero = F.lit(0.0)
    number = col.cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
    text = is_text(dtype)
    flags = {
        "rows": F.lit(1),
        "nulls": col.isNull().cast("int"),
        "ints": col.rlike(INTEGER_TEXT).cast("int") if text else F.lit(0),
        "floats": col.rlike(FLOAT_TEXT).cast("int") if text else F.lit(0),
    }
    aggs = {f"{name}_0": _sum(flag.cast("bigint")) for name, flag in flags.items()}
    if is_numeric(dtype):
        n, spread = F.count(number), F.var_pop(number)
        aggs |= {
            "mean_0": F.avg(number),
            "two_0": spread * n,
            # Without spread there is no skewness, and no third moment either.
            "three_0": F.when(spread > 0, F.skewness(number) * spread * F.sqrt(spread) * n),
        }
    base = clean.agg(*[agg.alias(name) for name, agg in aggs.items()])
    gains = {f"{name}_d": _sum(F.col(SIGN) * flag) for name, flag in flags.items()}
    if is_numeric(dtype):
        off = number - clean.agg(F.coalesce(F.avg(number), zero)).scalar()
        for name, power in (("one", off), ("two", off * off), ("three", off * off * off)):
            gains[f"{name}_d"] = _sum(F.col(SIGN) * power)
    gain = change.groupBy(*by).agg(*[agg.alias(name) for name, agg in gains.items()])
    told = _after(base, gain, by, groups).fillna(0)

    def total(name: str) -> Column:
        return F.col(f"{name}_0") + F.col(f"{name}_d")

    filled = total("rows") - total("nulls")
    mean = skew = zero
    if is_numeric(dtype):
        shift = F.col("one_d") / filled
        two = total("two") / filled - shift * shift
        three = total("three") / filled - 3 * shift * total("two") / filled + 2 * shift * shift * shift
        flat = two <= NO_SPREAD * (F.col("mean_0") + shift) * (F.col("mean_0") + shift)
        factor = F.sqrt(filled * (filled - 1)) / (filled - 2)
        mean = F.when(filled > 0, F.col("mean_0") + shift).otherwise(zero)
        skew = F.when((filled > 2) & ~flat, three / (two * F.sqrt(two)) * factor).otherwise(zero)

    def part(name: str) -> Column:
        return F.when(filled > 0, total(name) / filled).otherwise(zero)

    out = told.select(
        *by,
        total("rows").alias("rows"),
        F.when(total("rows") > 0, total("nulls") / total("rows")).otherwise(zero).alias("null_rate"),
        filled.alias("filled"),
        part("ints").alias("int_ratio"),
        part("floats").alias("float_ratio"),
        mean.alias("mean"),
        F.abs(skew).alias("skew"),
    )
    if "distinct_count" in wanted:
        n, now = F.col("n"), F.col("n") + F.col("d")
        met = met_counts(clean, change, column, by).filter(F.col("key.v").isNotNull())
        gain = met.groupBy(*by).agg(_more(now > 0, n > 0).alias("gain"))
        base = clean.agg(F.count_distinct(col).alias("base"))
        keys = _after(base, gain, by, groups).select(*by, (F.col("base") + F.coalesce("gain", F.lit(0))).alias("keys"))
        out = out.join(keys, list(by)).withColumn(
            "cardinality", F.when(F.col("filled") > 0, F.col("keys") / F.col("filled")).otherwise(zero)
        )
    return out


def parent_after(
    clean: DataFrame, change: DataFrame, pk: str | None, by: Sequence[str], groups: Sequence[str]
) -> DataFrame:
    """(by, rows, has_null) of a parent table in every run."""
    null = F.col(pk).isNull() if pk in clean.columns else F.lit(False)
    base = clean.agg(F.count(F.lit(1)).alias("rows_0"), F.count_if(null).alias("nulls_0"))
    gain = change.groupBy(*by).agg(
        F.sum(SIGN).alias("rows_d"), _sum(F.when(null, F.col(SIGN))).alias("nulls_d")
    )
    told = _after(base, gain, by, groups).fillna(0)
    return told.select(
        *by,
        (F.col("rows_0") + F.col("rows_d")).alias("rows"),
        (F.col("nulls_0") + F.col("nulls_d") > 0).alias("has_null"),
    )


def orphans_after(
    child: DataFrame,
    fk: str,
    parent: DataFrame,
    pk: str,
    child_change: DataFrame | None,
    parent_change: DataFrame | None,
    by: Sequence[str],
    groups: Sequence[str],
) -> DataFrame:
    """(by, orphans): child rows without a parent in every run."""
    some = counted(child, fk).filter(F.col("key.v").isNotNull())
    alone = some.join(counted(parent, pk).select("key"), "key", "left_anti").agg(_sum(F.col("n")).alias("base"))
    if child_change is None and parent_change is None:
        return to_groups(alone, by, groups).select(*by, F.col("base").alias("orphans"))
    gain = link_counts(child, fk, parent, pk, child_change, parent_change, by).groupBy(*by).agg(
        _orphan_gain().alias("gain")
    )
    told = _after(alone, gain, by, groups)
    return told.select(*by, (F.col("base") + F.coalesce("gain", F.lit(0))).alias("orphans"))


def facts_changed(
    targets: Sequence[Target],
    tables: Mapping[str, DataFrame],
    changes: Mapping[str, DataFrame],
    *,
    by: Sequence[str],
    groups: Sequence[str],
    losing: Sequence[str] = (),
    wanted: Sequence[str] = FACTS,
) -> DataFrame:
    """(by, target, the facts of PARTIALS) for every target in every run.

    `losing` names the tables of which runs take rows for good.
    """
    spark = next(iter(tables.values())).sparkSession

    def change_of(name: str) -> DataFrame:
        found = changes.get(name)
        if found is not None:
            return found
        rows = tables[name].filter(F.lit(False)).withColumns({c: F.lit("") for c in by})
        return rows.withColumn(SIGN, F.lit(1))

    def every() -> DataFrame:
        return to_groups(spark.range(1).select(), by, groups)

    rows = []
    for t in targets:
        told = every().withColumn("target", F.lit(t.key))
        facts: dict[str, Column] = {}

        def add(frame: DataFrame | None, told: DataFrame, **named: str) -> DataFrame:
            if frame is None:
                return told
            facts.update({fact: F.col(f"{fact}_") for fact in named})
            return told.join(frame.select(*by, *[F.col(c).alias(f"{f}_") for f, c in named.items()]), list(by), "left")

        if t.blame_model in tables:
            clean, change = tables[t.blame_model], change_of(t.blame_model)
            told = add(latest_after(clean, change, by, groups, t.blame_model in losing), told, blame_latest="latest")
            if t.blame_pk_column in clean.columns:
                told = add(extra_after(clean, change, t.blame_pk_column, by, groups), told, blame_pk_dupe_count="extra")
            if t.blame_column in clean.columns:
                named = {
                    "blame_row_count": "rows",
                    "blame_null_rate": "null_rate",
                    "blame_integer_compatible_ratio": "int_ratio",
                    "blame_float_compatible_ratio": "float_ratio",
                    "blame_mean": "mean",
                    "blame_anomaly_score": "skew",
                }
                if "distinct_count" in wanted:
                    named["blame_cardinality_ratio"] = "cardinality"
                told = add(column_after(clean, change, t.blame_column, by, groups, wanted), told, **named)
            else:
                told = add(parent_after(clean, change, None, by, groups), told, blame_row_count="rows")
        if t.parent_table in tables:
            clean, change = tables[t.parent_table], change_of(t.parent_table)
            told = add(latest_after(clean, change, by, groups, t.parent_table in losing), told, parent_latest="latest")
            named = {"parent_row_count": "rows"}
            if t.parent_pk_column in clean.columns:
                named["parent_has_null"] = "has_null"
                told = add(extra_after(clean, change, t.parent_pk_column, by, groups), told, parent_pk_dupe_count="extra")
            told = add(parent_after(clean, change, t.parent_pk_column, by, groups), told, **named)
        if t.is_relationship and t.blame_model in tables and t.parent_table in tables:
            child, parent = tables[t.blame_model], tables[t.parent_table]
            if t.blame_column in child.columns and t.parent_pk_column in parent.columns:
                found = orphans_after(
                    child, t.blame_column, parent, t.parent_pk_column,
                    changes.get(t.blame_model), changes.get(t.parent_table), by, groups,
                )
                told = add(found, told, orphan_rows="orphans")
        nothing = F.lit(None)
        rows.append(told.select(*by, "target", *[facts.get(n, nothing).cast(d).alias(n) for n, d in PARTIALS.items()]))
    return reduce(DataFrame.unionByName, rows)


# --- failing rows -----------------------------------------------------------------------


def failing_keys_changed(
    models: Mapping[str, DataFrame],
    changes: Mapping[str, DataFrame],
    test: DataTest,
    pk: str,
    *,
    by: Sequence[str],
    groups: Sequence[str],
) -> DataFrame:
    """(by, test_name, pk): primary keys (text) of the rows that fail in each run, once each.

    Rows that fail in the clean tables fail in every run that leaves them alone.
    """
    model, change = models[test.model], changes.get(test.model)
    name = F.lit(test.name).alias("test_name")
    signed: list[DataFrame] = []

    def put(rows: DataFrame, sign: Column) -> None:
        signed.append(rows.select(*by, text_key(pk).alias("pk"), sign.cast("bigint").alias(SIGN)))

    if test.kind == "not_null":
        null = F.col(test.column).isNull()
        put(to_groups(model.filter(null).select(pk), by, groups), F.lit(1))
        if change is not None:
            put(change.filter(null), F.col(SIGN))
    elif test.kind == "unique":
        repeated = counted(model, test.column).filter(F.col("key.v").isNotNull() & (F.col("n") > 1))
        clean = to_groups(repeated.select("key"), by, groups)
        if change is not None:
            met = met_counts(model, change, test.column, by).filter(F.col("key.v").isNotNull())
            now = met.filter(F.col("n") + F.col("d") > 1).select(*by, "key")
            clean = clean.join(met.select(*by, "key"), [*by, "key"], "left_anti").unionByName(now)
        return clean.select(*by, name, text_key("key.v").alias("pk"))
    elif test.kind == "relationships":
        parent, parent_change = models[test.parent_model], changes.get(test.parent_model)
        key = F.struct(F.col(test.column).alias("v"))
        some = model.filter(F.col(test.column).isNotNull()).withColumn("key", key)
        there = counted(parent, test.parent_column).select("key")
        lost = to_groups(some.join(there, "key", "left_anti"), by, groups)
        moved = None
        if parent_change is not None:
            met = met_counts(parent, parent_change, test.parent_column, by).filter(F.col("key.v").isNotNull())
            moved = met.select(*by, "key", (F.col("n") + F.col("d") <= 0).alias("absent"))
            lost = lost.join(moved, [*by, "key"], "left_anti")
            gone = moved.filter("absent").select(*by, "key")
            put(some.join(gone, "key"), F.lit(1))
        put(lost, F.lit(1))
        if change is not None:
            own = change.filter(F.col(test.column).isNotNull()).withColumn("key", key)
            own = own.join(there.withColumn("there", F.lit(True)), "key", "left")
            absent = F.col("there").isNull()
            if moved is not None:
                own = own.join(moved, [*by, "key"], "left")
                absent = F.coalesce("absent", absent)
            put(own.filter(absent), F.col(SIGN))
    if not signed:
        return model.filter(F.lit(False)).select(*[F.lit("").alias(c) for c in by], name, text_key(pk).alias("pk"))
    rows = reduce(DataFrame.unionByName, signed).filter(F.col("pk").isNotNull())
    left = rows.groupBy(*by, "pk").agg(F.sum(SIGN).alias("n")).filter(F.col("n") > 0)
    return left.select(*by, name, "pk")
