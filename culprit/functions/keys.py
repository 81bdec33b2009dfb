"""Key expressions: text keys, sampling order and stable incident ids."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(col: Column | str) -> Column:
    """Row keys are compared as text everywhere."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def joined_text(columns: list[str]) -> Column:
    """Key columns as one text; null if any part is null (shown as 'None')."""
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i:
            parts.append(F.lit("|"))
        parts.append(text_key(name))
    return F.coalesce(F.concat(*parts), F.lit("None"))


def sample_hash(pk: Column, seed: Column) -> Column:
    """The order in which a seeded sample draws keys; equal on every engine with md5."""
    return F.md5(F.concat(text_key(pk), F.lit("#"), seed.cast("string")))


def incident_key(dataset: Column, pattern: Column, seed: Column) -> Column:
    joined = F.concat_ws("|", dataset, pattern, seed.cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 16)


def incident_id(*parts: Column) -> Column:
    """Deterministic, so that a retried task or a replayed batch writes the same id."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("inc_"), F.substring(F.md5(joined), 1, 12))


def length_then_text(col: Column) -> Column:
    """The display order of row keys."""
    return F.struct(F.length(col), col)


def ntz(moment: datetime | str) -> Column:
    """A UTC wall-clock literal."""
    if isinstance(moment, datetime):
        if moment.tzinfo is not None:
            moment = moment.astimezone(UTC).replace(tzinfo=None)
        moment = moment.isoformat(sep=" ")
    return F.lit(moment).cast("timestamp_ntz")
