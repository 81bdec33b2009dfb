"""Incident and label tables as append-only parquet, read as their latest state.

A save commits a batch and never rewrites what readers may be reading.  The current
state is the last change per key.  Saving the same named batch twice (a replayed
micro-batch, a retried job) changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.operators.incidents import incident_rows
from culprit.schemas import CAUSE_CLASSES, INCIDENT, TEXT, record
from culprit.sources.commits import Once, write_sized
from culprit.sources.constants import constant_frame

PUT, DROP = "put", "drop"
BOOKKEEPING = ("_version", "_change")

# Keys in one bucket of a snapshot.
BUCKET_ROWS = 200_000


def latest(df: DataFrame, key: str, version: str | Column) -> DataFrame:
    """The last version of each key (max over structs, combined map-side)."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(version, *rest)
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(key, "r.*")


def upsert(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates replace rows with the same key and add the others."""
    both = current.withColumn("_version", F.lit(0)).unionByName(
        updates.withColumn("_version", F.lit(1))
    )
    return latest(both, key, "_version").drop("_version").select(*current.columns)


def by_id(df: DataFrame, key: str, value: str | Column) -> DataFrame:
    return df.filter(F.col(key) == value)


def delete(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti").select(*current.columns)


def listing(
    incidents: DataFrame,
    *,
    failing_model: str | None = None,
    cause_class: str | None = None,
    verdict_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Newest first; filters apply before a limit, if one is asked for.  Ids break ties."""
    wanted = {
        "failing_model": failing_model,
        "final_cause_class": cause_class,
        "verdict_type": verdict_type,
    }
    for column, value in wanted.items():
        if value is not None:
            incidents = incidents.filter(F.col(column) == value)
    ordered = incidents.orderBy(F.desc("created_at"), "incident_id")
    return ordered if limit is None else ordered.limit(limit)


def set_labels(current: DataFrame, labels: DataFrame) -> DataFrame:
    """Human labels onto rows and payload; a null label clears, unknown ids change nothing.

    `labels` holds one (incident_id, human_label) row per changed incident.
    """
    given = labels.select(
        "incident_id", F.col("human_label").alias("_label"), F.lit(True).alias("_given")
    )
    met = current.join(given, "incident_id", "left")
    record = F.from_json("payload", INCIDENT).withField("human_label", F.col("_label"))
    changed = {
        "human_label": F.col("_label"),
        "payload": F.to_json(record, {"ignoreNullFields": "false"}),
    }
    met = met.withColumns(
        {n: F.when(F.col("_given"), c).otherwise(F.col(n)) for n, c in changed.items()}
    )
    return met.select(*current.columns)


class IncidentStore:
    """Incidents (or ground truths) below `path`: numbered changes and snapshots of them.

    A change is written first and then committed by creating the file of the next number,
    which only one writer can; whoever finds it taken goes on to the one after.  So every
    change is whole or not there, and the last change of a key wins, in the order of the
    numbers, whoever makes it.  A named batch that has been committed is not committed
    again: replayed after a failure it adds what was lost and overrides nothing newer.

    Methods that write say so; the others are lazy.
    """

    def __init__(self, spark: SparkSession, path: str, table: str = "incidents") -> None:
        self.spark = spark
        self.path = f"{path.rstrip('/')}/{table}"
        self.key = "incident_id" if table == "incidents" else "incident_key"
        self.commits = Once(spark, f"{self.path}/commits")
        self.snapshots = Once(spark, f"{self.path}/snapshots")
        self.batches = Once(spark, f"{self.path}/batches")

    def _since(self) -> tuple[dict | None, int, dict[int, dict]]:
        """The last snapshot, the number it goes up to, and the changes after it."""
        last = self.snapshots.names()[-1:]
        told = self.snapshots.read(last)
        upto = int(last[0]) if told else -1
        names = [n for n in self.commits.names() if int(n) > upto]
        found = {int(n): c for n, c in self.commits.read(names).items()}
        return (told[last[0]] if told else None), upto, dict(sorted(found.items()))

    def _log(self, key: str | None = None) -> DataFrame | None:
        """The last snapshot and all changes since, of all keys or of one.

        With a key only its bucket of the snapshot is opened.
        """
        kept, _, changes = self._since()
        parts = []
        if kept is not None:
            base = self.spark.read.parquet(f"{self.path}/data/{kept['data']}")
            if key is not None:
                bucket = F.pmod(F.xxhash64(F.lit(key)), F.lit(kept["buckets"])).cast("int")
                base = base.filter(F.col("_bucket") == bucket)
            parts.append(base.drop("_bucket"))
        if changes:
            frame = self.spark.read.parquet(*[f"{self.path}/data/{c['data']}" for c in changes.values()])
            # One entry per change since the snapshot.
            number = F.create_map(*[x for n, c in changes.items() for x in (F.lit(c["data"]), F.lit(n))])
            change = F.create_map(*[x for c in changes.values() for x in (F.lit(c["data"]), F.lit(c["change"]))])
            parts.append(
                frame.withColumns(
                    {"_version": number[F.col("_data")].cast("bigint"), "_change": change[F.col("_data")]}
                ).drop("_data")
            )
        if not parts:
            return None
        log = reduce(DataFrame.unionByName, parts)
        return log if key is None else by_id(log, self.key, key)

    def _committed(self, batch: str, changes: dict[int, dict]) -> bool:
        mark = hashlib.sha256(batch.encode()).hexdigest()
        return any(c["batch"] == batch for c in changes.values()) or mark in self.batches.names()

    def _append(self, rows: DataFrame, change: str, batch: str | None = None) -> None:
        _, upto, changes = self._since()
        if batch is not None and self._committed(batch, changes):
            return
        data = uuid.uuid4().hex
        write_sized(rows.withColumn("_data", F.lit(data)), f"{self.path}/data/{data}", self.key)
        entry = {"data": data, "change": change, "batch": batch}
        number = max([upto, *changes]) + 1
        while not self.commits.make(f"{number:012d}", entry):
            number += 1

    def _state(self, log: DataFrame | None) -> DataFrame:
        if log is None:
            raise LookupError(f"nothing stored at {self.path}")
        return latest(log, self.key, "_version")

    def save_rows(self, rows: DataFrame, batch: str | None = None) -> None:
        """Writes: upsert by key."""
        self._append(rows, PUT, batch)

    def save(self, incidents: DataFrame, batch: str | None = None) -> None:
        """Writes: upsert by incident id."""
        self.save_rows(incident_rows(incidents), batch)

    def current(self) -> DataFrame:
        return self._live(self._state(self._log()))

    @staticmethod
    def _live(state: DataFrame) -> DataFrame:
        return state.filter(F.col("_change") == PUT).drop(*BOOKKEEPING)

    def load(self, key: str) -> DataFrame:
        """Key filters reach the scan, as they hold for every version of a row."""
        return self._live(self._state(self._log(key)))

    def list(self, **filters: object) -> DataFrame:
        return listing(self.current(), **filters)

    def delete(self, keys: Sequence[str]) -> bool:
        """Writes; False if none of the keys is stored."""
        hit = self.current().filter(F.col(self.key).isin(list(keys)))
        if hit.isEmpty():
            return False
        self._append(hit, DROP)
        return True

    def delete_rows(self, ids: DataFrame) -> None:
        """Writes: all rows whose key is among `ids` go."""
        self._append(self.current().join(ids.select(self.key), self.key, "left_semi"), DROP)

    def label(self, incident_id: str, label: str | None) -> bool:
        """Writes; False if there is no such incident."""
        if label is not None and label not in CAUSE_CLASSES:
            raise ValueError(f"unknown cause class: {label}")
        row = self.load(incident_id)
        if row.isEmpty():
            return False
        change = constant_frame(
            self.spark, [(incident_id, label)], record(incident_id=TEXT, human_label=TEXT)
        )
        self._append(set_labels(row, change), PUT)
        return True

    def label_rows(self, labels: DataFrame) -> None:
        """Writes: one label for each (incident_id, human_label)."""
        hit = self.current().join(labels.select("incident_id"), "incident_id", "left_semi")
        self._append(set_labels(hit, labels), PUT)

    def compact(self) -> None:
        """Writes a snapshot of the state, in buckets of keys; readers then start from it.

        Older snapshots and changes stay for those who are reading them, until `prune`.
        """
        _, upto, changes = self._since()
        state = self._state(self._log())
        last = max([upto, *changes])
        # What a replay asks for must be known before the changes are out of its sight.
        for c in changes.values():
            if c["batch"] is not None:
                self.batches.make(hashlib.sha256(c["batch"].encode()).hexdigest(), {"batch": c["batch"]})
        buckets = max(1, -(-state.count() // BUCKET_ROWS))
        data = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        state.withColumn("_bucket", bucket).repartition(buckets, "_bucket").sortWithinPartitions(
            self.key
        ).write.partitionBy("_bucket").parquet(f"{self.path}/data/{data}")
        self.snapshots.make(f"{last:012d}", {"data": data, "buckets": buckets})

    def prune(self) -> int:
        """Deletes the files of changes and snapshots that the last snapshot replaces.

        For times when nobody reads an older state; returns how many went.
        """
        _, upto, _ = self._since()
        data = Once(self.spark, f"{self.path}/data")
        gone = 0
        for log, names in (
            (self.commits, [n for n in self.commits.names() if int(n) <= upto]),
            (self.snapshots, self.snapshots.names()[:-1]),
        ):
            for name, entry in log.read(names).items():
                data.remove(entry["data"])
                log.remove(name)
                gone += 1
        return gone
