"""Triage on arrival: run artifacts come in as files, incidents go out to the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from culprit.schemas import TEXT, record
from culprit.sources.artifacts import documents_of, failing_tests
from culprit.sources.store import IncidentStore

ARTIFACT = record(run_id=TEXT, run_results=TEXT, manifest=TEXT)

# Failing tests of a batch of runs in, incident records out.
Responder = Callable[[DataFrame], DataFrame]


def write_artifacts(runs: DataFrame, manifests: DataFrame, path: str) -> None:
    """Both documents of each run as one JSON line."""
    documents_of(runs, manifests).select(*ARTIFACT.names).write.mode("append").json(path)


def start_triage_stream(
    spark: SparkSession,
    artifacts_path: str,
    respond: Responder,
    store: IncidentStore,
    checkpoint: str,
    *,
    max_files_per_trigger: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Triage every new artifact once.

    The checkpoint remembers which files are done.  A batch is named by the query's own
    id, which the checkpoint keeps, and its number: replayed after a failure it is the
    same batch to the store, and one of a new checkpoint never is.
    """
    reader = spark.readStream.schema(ARTIFACT)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    arriving = reader.json(artifacts_path)

    def triage_batch(batch: DataFrame, batch_id: int) -> None:
        failing = failing_tests(batch)
        query_id = spark.read.text(f"{checkpoint}/metadata").first()["value"]
        store.save(respond(failing), batch=f"{query_id}#{batch_id}")

    writer = arriving.writeStream.foreachBatch(triage_batch).option(
        "checkpointLocation", checkpoint
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def triage_stream(
    spark: SparkSession,
    artifacts_path: str,
    respond: Responder,
    store: IncidentStore,
    checkpoint: str,
    **options: object,
) -> IncidentStore:
    """Work off everything that has arrived and return the store."""
    start_triage_stream(
        spark, artifacts_path, respond, store, checkpoint, **options
    ).awaitTermination()
    return store
