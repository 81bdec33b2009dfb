"""Simple predictors to compare with; each works on a table of failing tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------
CAUSE_OF_KIND = {
    "not_null": "upstream_null_spike",
    "unique": "duplicate_ingestion",
    "relationships": "broken_join_dropout",
}
RANDOM_CAUSES = ("upstream_null_spike", "duplicate_ingestion", "broken_join_dropout")
NAME_CONFIDENCE, RANDOM_CONFIDENCE, GUESS_CONFIDENCE = 1.0, 0.33, 0.8
# -------------------------------------------------------------------------------------


def cause_of_kind(kind: Column) -> Column:
    cause: Column = F.lit("unknown")
    for name, known in CAUSE_OF_KIND.items():
        cause = F.when(kind == name, known).otherwise(cause)
    return cause


def baseline_key(pattern: Column, seed: Column) -> Column:
    return F.concat_ws("_", pattern, seed.cast("string"))


def _prediction(
    failing: DataFrame, table: Column, column: Column, cause: Column, confidence: float
) -> DataFrame:
    return failing.select(
        "incident_key",
        F.array(table).alias("candidate_tables"),
        column.alias("blame_column"),
        cause.alias("cause_class"),
        F.lit(confidence).alias("confidence"),
        F.lit(0.0).alias("latency_seconds"),
    )


def by_test_name(failing: DataFrame) -> DataFrame:
    """Blames the tested model itself."""
    cause = cause_of_kind(F.col("kind"))
    return _prediction(failing, F.col("model"), F.col("column"), cause, NAME_CONFIDENCE)


def _draw(options: Sequence[str], salt: str) -> Column:
    """A pick fixed by key and salt, so a retry draws the same (first md5 digits mod n)."""
    digest = F.md5(F.concat_ws("#", F.col("incident_key"), F.lit(salt)))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    position = F.pmod(number, F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), position)


def by_chance(failing: DataFrame, source_tables: Sequence[str]) -> DataFrame:
    return _prediction(
        failing,
        _draw(source_tables, "table"),
        F.col("column"),
        _draw(RANDOM_CAUSES, "cause"),
        RANDOM_CONFIDENCE,
    )


def by_name_heuristic(failing: DataFrame, word: str, then: str, otherwise: str) -> DataFrame:
    """Table by a word in the test name, cause by its kind."""
    table = F.when(F.contains(F.col("test_name"), F.lit(word)), then).otherwise(otherwise)
    cause = cause_of_kind(F.col("kind"))
    return _prediction(failing, table, F.col("column"), cause, GUESS_CONFIDENCE)


def by_walk_only(failing: DataFrame, walks: DataFrame) -> DataFrame:
    """Where from the lineage walk, what from the test kind."""
    met = failing.join(walks.select("model", "column", "blame_model", "blame_column"),
                       ["model", "column"])
    cause = cause_of_kind(F.col("kind"))
    return _prediction(
        met, F.col("blame_model"), F.col("blame_column"), cause, GUESS_CONFIDENCE
    )
