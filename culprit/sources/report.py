"""Where a suite's scores go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from culprit.operators.metrics import report_line


def write_report(
    report: DataFrame, per_class: DataFrame, counters: DataFrame, path: str, system: str
) -> None:
    """Scores with their table line, class accuracies and run counters, one folder each."""
    lined = report.withColumn("line", report_line(system))
    for name, df in (("scores", lined), ("classes", per_class), ("counters", counters)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
