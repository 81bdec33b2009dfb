"""The four generic data tests, their failure rows and a fused suite run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions.keys import text_key
from culprit.operators.probes import orphan_keys


@dataclass(frozen=True)
class DataTest:
    """One declared test: `kind` on model.column, with its parent or its value list."""

    kind: str
    model: str
    column: str
    parent_model: str | None = None
    parent_column: str | None = None
    accepted: tuple = ()

    @property
    def name(self) -> str:
        stem = f"{self.kind}_{self.model}_{self.column}"
        if self.kind == "relationships":
            return f"{stem}__{self.parent_column}__ref_{self.parent_model}_"
        if self.kind == "accepted_values":
            return f"{stem}__{'__'.join(str(v) for v in self.accepted)}"
        return stem


# --- single tests: one failures table each ----------------------------------------


def not_null_failures(model: DataFrame, column: str) -> DataFrame:
    """The whole failing rows."""
    return model.filter(F.col(column).isNull())


def unique_failures(model: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Repeated values; nulls do not count."""
    counted = (
        model.filter(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).alias("unique_field"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    return counted.filter(F.col("n_records") > 1)


def relationship_failures(
    child: DataFrame, fk: str, parent: DataFrame, field: str
) -> DataFrame:
    """One row per child row whose key has no parent; null keys do not count."""
    return rows_without_parent(child, fk, parent, field).select(F.col(fk).alias("from_field"))


def rows_without_parent(
    child: DataFrame, fk: str, parent: DataFrame, field: str, by: Sequence[str] = ()
) -> DataFrame:
    """Whole child rows without a parent; AQE may split a hot key on the child side."""
    present = parent.filter(F.col(field).isNotNull()).select(*by, F.col(field).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(present.distinct(), [*by, fk], "left_anti")


def accepted_values_failures(
    model: DataFrame, column: str, accepted: Sequence, by: Sequence[str] = ()
) -> DataFrame:
    """Values outside the list with their counts; nulls do not count."""
    return (
        model.filter(~F.col(column).isin(*accepted))
        .groupBy(*by, F.col(column).alias("value_field"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


# --- a whole suite ----------------------------------------------------------------


def _spread(df: DataFrame, by: Sequence[str], groups: Sequence[str] | None) -> DataFrame:
    """Repeat a few rows for every group where the source table is not split itself."""
    if not by or all(c in df.columns for c in by):
        return df
    if groups is None:
        raise ValueError("groups are needed for a model that is not split by " + by[0])
    return df.withColumn(by[0], F.explode(F.array(*[F.lit(g) for g in groups])))


def _split(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in by if c in df.columns]


# Types whose text is equal exactly where the values are.
_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_TOLD_BY_TEXT = _WHOLE | {"string", "boolean", "date", "timestamp", "timestamp_ntz"}


def _same_text(models: Mapping[str, DataFrame], test: DataTest) -> bool:
    """Whether a relationship's keys may be compared as text."""
    one = models[test.model].schema[test.column].dataType.simpleString()
    two = models[test.parent_model].schema[test.parent_column].dataType.simpleString()
    return {one, two} <= _WHOLE or (one == two and (one in _TOLD_BY_TEXT or one.startswith("decimal")))


@dataclass(frozen=True)
class Space:
    """Keys that are counted together: those of a child column, a parent column, or both."""

    child: tuple[str, str] | None = None
    parent: tuple[str, str] | None = None
    only: DataTest | None = None  # keys of nulls, or of values outside the list, of one test


# What a test reads off the counts of its space.
ORPHANS, CHILD_REPEATED, PARENT_REPEATED, ROWS, KEYS = "orphans", "child_repeated", "parent_repeated", "n_rows", "n_keys"


def key_spaces(tests: Sequence[DataTest]) -> tuple[list[Space], list[tuple[int, str]]]:
    """The fewest spaces that answer all tests, and for each test its space and measure.

    A unique test reads the side of a relationship that counts its column anyway.
    """
    spaces: list[Space] = []
    answers: dict[int, tuple[int, str]] = {}

    def add(space: Space) -> int:
        if space not in spaces:
            spaces.append(space)
        return spaces.index(space)

    for i, t in enumerate(tests):
        if t.kind == "relationships":
            answers[i] = add(Space((t.model, t.column), (t.parent_model, t.parent_column))), ORPHANS
    for i, t in enumerate(tests):
        spot = (t.model, t.column)
        if t.kind == "unique":
            as_parent = [n for n, s in enumerate(spaces) if s.parent == spot]
            as_child = [n for n, s in enumerate(spaces) if s.child == spot]
            if as_child and not as_parent:
                answers[i] = as_child[0], CHILD_REPEATED
            else:
                answers[i] = as_parent[0] if as_parent else add(Space(parent=spot)), PARENT_REPEATED
        elif t.kind != "relationships":
            answers[i] = add(Space(only=t)), ROWS if t.kind == "not_null" else KEYS
    return spaces, [answers[i] for i in range(len(tests))]


def _entries(model: DataFrame, name: str, spaces: Sequence[Space], by: Sequence[str]) -> Column:
    """What a row of a model adds to the spaces: (space, num, key, c, p), null for nothing.

    A whole number is kept as one, every other key as text: a space has one kind of keys.
    """
    types = dict(model.dtypes)
    nullable = {f.name for f in model.schema if f.nullable}

    def entry(space: int, column: str | None, child: bool, when: Column, key: Column | None = None) -> Column:
        c, p = (F.lit(int(x)).cast("bigint") for x in (child, not child))
        whole = column is not None and types[column] in _WHOLE
        num = F.col(column) if whole else F.lit(None)
        if key is None:
            key = F.lit(None) if whole or column is None else F.col(column)
        fields = {"space": F.lit(space), "num": num.cast("bigint"), "key": key.cast("string"), "c": c, "p": p}
        return F.when(when, F.struct(*[f.alias(n) for n, f in fields.items()]))

    made = []
    for i, s in enumerate(spaces):
        for side, child in ((s.child, True), (s.parent, False)):
            if side is not None and side[0] == name:
                made.append(entry(i, side[1], child, F.col(side[1]).isNotNull()))
        if s.only is not None and s.only.model == name:
            col = F.col(s.only.column)
            if s.only.kind == "not_null":
                # Nothing is read for a column that cannot be null, nor joined to make it.
                made.append(entry(i, None, False, col.isNull() if s.only.column in nullable else F.lit(False)))
            else:
                made.append(entry(i, s.only.column, False, ~col.isin(*s.only.accepted)))
    if by:  # a run of which a model has rows has results of its tests
        made.append(entry(-1, None, False, F.lit(True), F.lit(name)))
    return F.array(*made)


def space_counts(
    models: Mapping[str, DataFrame], spaces: Sequence[Space], names: Sequence[str], by: Sequence[str]
) -> DataFrame:
    """(by, space, num, key, c, p): rows of child and parent that hold each key of a space.

    Every model is read once.  Both sides of a relationship meet in one aggregation instead
    of a join, and what a task holds of a key, a hot one too, is one row of the shuffle.
    Empty entries go after the explode: to filter the array would run outside generated code.
    """
    parts = []
    for name in names:
        entries = F.explode(_entries(models[name], name, spaces, by)).alias("e")
        some = models[name].select(*by, entries).filter(F.col("e").isNotNull())
        parts.append(some.select(*by, "e.*"))
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*by, "space", "num", "key").agg(F.sum("c").alias("c"), F.sum("p").alias("p"))


def _fused(models: Mapping[str, DataFrame], tests: Sequence[DataTest], by: Sequence[str]) -> DataFrame:
    """(by, test_name, failures) of tests whose models are all split alike."""
    spaces, answers = key_spaces(tests)
    names = dict.fromkeys(n for t in tests for n in (t.model, t.parent_model) if n)
    counts = space_counts(models, spaces, list(names), by)
    measures = {
        ORPHANS: F.sum(F.when(F.col("p") == 0, F.col("c"))),
        CHILD_REPEATED: F.count_if(F.col("c") > 1),
        PARENT_REPEATED: F.count_if(F.col("p") > 1),
        ROWS: F.sum("p"),
        KEYS: F.count_if(F.col("p") > 0),
    }
    owner = [F.when(F.col("space") < 0, F.col("key")).alias("owner")] if by else []
    told = counts.groupBy(*by, "space", *owner).agg(*[m.alias(n) for n, m in measures.items()])
    slots = []
    for t, (space, measure) in zip(tests, answers, strict=True):
        hit = F.col(measure) if not by else F.when(F.col("space") == space, F.col(measure))
        slots.append((t, space, F.coalesce(hit, F.lit(0)).cast("bigint")))
    if not by:
        # One row for each test, whatever rows there are.
        sums = [F.sum(F.when(F.col("space") == space, f)) for _, space, f in slots]
        wide = told.agg(*[F.coalesce(s, F.lit(0)).alias(f"n{i}") for i, s in enumerate(sums)])
        cells = [F.struct(F.lit(t.name).alias("test_name"), F.col(f"n{i}").alias("failures")) for i, (t, _, _) in enumerate(slots)]
        return wide.select(F.inline(F.array(*cells)))
    rows = []
    for t, space, failures in slots:
        here = (F.col("space") == space) | ((F.col("space") < 0) & (F.col("owner") == t.model))
        rows.append(F.when(here, F.struct(F.lit(t.name).alias("test_name"), failures.alias("failures"))))
    cells = F.filter(F.array(*rows), lambda e: e.isNotNull())
    long = told.select(*by, F.explode(cells).alias("e")).select(*by, "e.*")
    return long.groupBy(*by, "test_name").agg(F.sum("failures").alias("failures"))


def run_tests(
    models: Mapping[str, DataFrame],
    tests: Sequence[DataTest],
    *,
    by: Sequence[str] = (),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Status and failure count of every test (for every group).

    Tests whose models are split alike share one scan of each model and one shuffle of
    keys.  A relationship between models that are not, or whose keys have types that text
    does not tell apart, is joined on its own.
    """
    fused: dict[tuple, list[DataTest]] = {}
    apart = []
    for t in tests:
        own = tuple(_split(models[t.model], by))
        if t.kind == "relationships" and (
            own != tuple(_split(models[t.parent_model], by)) or not _same_text(models, t)
        ):
            apart.append(t)
        else:
            fused.setdefault(own, []).append(t)
    parts = [_spread(_fused(models, own, list(split)), by, groups) for split, own in fused.items()]
    for t in apart:
        model = models[t.model]
        found = orphan_keys(
            model, t.column, models[t.parent_model], t.parent_column, by=by, groups=groups
        )
        counted = found.groupBy(*_split(found, by)).agg(F.sum("child_rows").alias("failures"))
        parts.append(_spread(counted, by, groups).select(*by, F.lit(t.name).alias("test_name"), "failures"))
        # No orphans are no rows: the groups are those of the failing model.
        own = _split(model, by)
        some = model.groupBy(*own).agg(F.lit(0).cast("bigint").alias("failures"))
        parts.append(_spread(some, by, groups).select(*by, F.lit(t.name).alias("test_name"), "failures"))
    long = reduce(DataFrame.unionByName, [p.select(*by, "test_name", "failures") for p in parts])
    totals = long.groupBy(*by, "test_name").agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"))
    return totals.withColumn("status", F.when(F.col("failures") > 0, "fail").otherwise("pass"))


def failing_keys(
    models: Mapping[str, DataFrame],
    test: DataTest,
    pk: str,
    *,
    by: Sequence[str] = (),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Primary keys (text) of the failing rows of one test.

    The shape of the failures table decides how keys are found: the key itself, the
    repeated value, or a look-up of the foreign key in the failing model.  Keys stay
    in a long table.
    """
    model = models[test.model]
    own_by = _split(model, by)
    if test.kind == "not_null":
        keys = not_null_failures(model, test.column).select(*own_by, text_key(pk).alias("pk"))
    elif test.kind == "unique":
        found = unique_failures(model, test.column, own_by)
        keys = found.select(*own_by, text_key("unique_field").alias("pk"))
    elif test.kind == "relationships":
        parent, field = models[test.parent_model], test.parent_column
        parent_by = _split(parent, by)
        if set(parent_by) <= set(own_by):
            found = rows_without_parent(model, test.column, parent, field, parent_by)
        else:
            # Only the parent is split: find the orphan keys per group on distinct keys,
            # then give each its child rows back.
            orphans = orphan_keys(model, test.column, parent, field, by=by, groups=groups)
            orphans = orphans.select(*parent_by, F.col("fk").alias(test.column))
            found = model.join(orphans, test.column)
        keys = found.select(*_split(found, by), text_key(pk).alias("pk"))
    else:
        keys = model.filter(F.lit(False)).select(*own_by, text_key(pk).alias("pk"))
    keys = keys.filter(F.col("pk").isNotNull())
    keys = _spread(keys, by, groups)
    return keys.select(*by, F.lit(test.name).alias("test_name"), "pk")


def keys_from_failures(
    failures: DataFrame, model: DataFrame, pk: str, column: str | None
) -> DataFrame:
    """Primary keys (text) behind a stored failures table of any shape.

    The first that fits: the key itself, a repeated value, a foreign key or the tested
    column, the last two looked up in the model.  Other shapes name no rows.
    """
    if pk in failures.columns:
        keys = failures.select(text_key(pk).alias("pk"))
    elif "unique_field" in failures.columns:
        keys = failures.select(text_key("unique_field").alias("pk"))
    else:
        field = "from_field" if "from_field" in failures.columns else column
        if not column or field not in failures.columns:
            return model.select(text_key(pk).alias("pk")).filter(F.lit(False))
        values = failures.select(F.col(field).alias(column)).distinct()
        keys = model.join(values, column, "left_semi").select(text_key(pk).alias("pk"))
    return keys.filter(F.col("pk").isNotNull())


def failures_table(models: Mapping[str, DataFrame], test: DataTest) -> DataFrame:
    """The failures of one test in the shape its kind stores."""
    model = models[test.model]
    if test.kind == "not_null":
        return not_null_failures(model, test.column)
    if test.kind == "unique":
        return unique_failures(model, test.column)
    if test.kind == "accepted_values":
        return accepted_values_failures(model, test.column, test.accepted)
    parent = models[test.parent_model]
    return relationship_failures(model, test.column, parent, test.parent_column)


def store_failures(
    models: Mapping[str, DataFrame], tests: Sequence[DataTest], path: str
) -> dict[str, str]:
    """Write a failures table per test; the suite's length bounds the number of writes."""
    places = {t.name: f"{path.rstrip('/')}/{t.name}" for t in tests}
    for t in tests:
        failures_table(models, t).write.mode("overwrite").parquet(places[t.name])
    return places
