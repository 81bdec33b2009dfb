"""Labels as JSON lines: a header file and a long file of offending keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.schemas import GROUND_TRUTH, TRUTH_ROW


def write_truths(truths: DataFrame, rows: DataFrame, path: str) -> int:
    """Writes both files and returns the number of labels.

    The count comes with the write itself, so the labels are not computed twice.
    """
    rows.select(*TRUTH_ROW.names).write.mode("overwrite").json(f"{path}/rows")
    truths.select(*GROUND_TRUTH.names).write.mode("overwrite").json(f"{path}/labels")
    return truths.sparkSession.read.text(f"{path}/labels").count()


def read_truths(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labels and keys; blank lines are skipped."""
    labels = spark.read.schema(GROUND_TRUTH).json(f"{path}/labels")
    rows = spark.read.schema(TRUTH_ROW).json(f"{path}/rows")
    return (
        labels.filter(F.col("incident_key").isNotNull()),
        rows.filter(F.col("incident_key").isNotNull()),
    )
