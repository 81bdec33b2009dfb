"""Facts of feeds that grow with what arrives, without reading earlier deliveries again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TOTALS = ("n_rows", "n_keyed", "n_null", "n_orphans", "latest")
# Rows without reference have no parent to meet; the join deals them into so many parts.
NULL_PARTS = 256


def _judged(
    rows: DataFrame, by: Sequence[str], key: str, reference: str, parent: DataFrame, parent_key: str,
    moment: str,
) -> DataFrame:
    """Each row with what it adds: rows, keyed rows, null references, orphans, its moment."""
    known = parent.select(F.col(parent_key).alias("_ref")).dropna().distinct().select(
        "_ref", F.lit(0).alias("_salt"), F.lit(True).alias("_known")
    )
    none = F.col(reference).isNull()
    asked = rows.select(
        *by,
        F.col(key).alias("_key"),
        F.col(reference).alias("_ref"),
        F.col(moment).cast("timestamp_ntz").alias("_at"),
        F.when(none, F.pmod(F.xxhash64(*by, key), F.lit(NULL_PARTS)) + 1).otherwise(0).cast("int").alias("_salt"),
    )
    met = asked.join(known, ["_ref", "_salt"], "left")
    return met.select(
        *by,
        "_key",
        "_at",
        F.col("_key").isNotNull().cast("bigint").alias("_keyed"),
        F.col("_ref").isNull().cast("bigint").alias("_null"),
        (F.col("_ref").isNotNull() & F.col("_known").isNull()).cast("bigint").alias("_orphan"),
    )


def _partials(batch: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per feed of the batch: its totals so far, and the keys never seen before."""
    whole = ~F.col("_of_key")
    new: Column = F.col("_of_key") & (F.col("first") == F.col("last"))
    return batch.groupBy(*by).agg(
        *[F.max(F.when(whole, F.col(n))).alias(n) for n in TOTALS],
        F.count_if(new).alias("new_keys"),
    )


def start_fact_stream(
    arriving: DataFrame,
    folder: str,
    *,
    by: Sequence[str],
    key: str,
    reference: str,
    parent: DataFrame,
    parent_key: str,
    moment: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep facts of the feeds (`by`) in a streaming table up to date.

    State is a row per feed and one per (feed, key): counts and the batches' times at which a
    key came first and last.  A key is new if both are this batch, so a repeated key is known
    by its state alone, whichever delivery it first came with.  Only feeds and keys of a batch
    are touched; the keys' state grows with the distinct keys, as any exact count of repeats
    must, so use the RocksDB state store on large feeds.  A feed's rows are summed within
    tasks before they move.  The parent is read as it is when rows arrive, and an orphan stays
    one if its parent comes later.

    Partials of a batch are written as one table below `folder`, beside the stream's progress.
    A batch that is replayed has the same time and number and replaces its own partials.
    """
    judged = _judged(arriving, by, key, reference, parent, parent_key, moment)
    sides = F.explode(
        F.array(
            F.struct(F.lit(False).alias("_of_key"), F.lit(None).cast(judged.schema["_key"].dataType).alias("_key")),
            F.struct(F.lit(True).alias("_of_key"), F.col("_key")),
        )
    )
    both = judged.select(*by, "_at", "_keyed", "_null", "_orphan", sides.alias("_side")).select(
        "*", "_side.*"
    ).filter(~F.col("_of_key") | F.col("_key").isNotNull())
    # The same moment for all rows of a batch, kept by the stream's log.
    now = F.current_timestamp()
    state = both.withColumn("_now", now).groupBy(*by, "_of_key", "_key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_keyed").alias("n_keyed"),
        F.sum("_null").alias("n_null"),
        F.sum("_orphan").alias("n_orphans"),
        F.max("_at").alias("latest"),
        F.min("_now").alias("first"),
        F.max("_now").alias("last"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        _partials(batch, by).write.mode("overwrite").parquet(f"{folder}/facts/batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(keep)
    writer = writer.option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def feed_facts(spark: SparkSession, folder: str, by: Sequence[str]) -> DataFrame:
    """The facts so far: totals, repeated rows, deliveries, and how the feed stands.

    `n_repeated` are rows whose key came before; rows without key repeat none.  `status` goes
    by orphans: `open` if the feed's latest delivery brought its first ones, `repeated` if it
    brought more, `resolved` if it brought none after earlier ones, else `clean`.
    """
    parts = spark.read.parquet(f"{folder}/facts")
    order = Window.partitionBy(*by).orderBy("batch")
    grown = parts.withColumn("before", F.coalesce(F.lag("n_orphans").over(order), F.lit(0)))
    last = grown.groupBy(*by).agg(
        F.max_by(F.struct(*TOTALS, "before"), "batch").alias("t"),
        F.sum("new_keys").alias("n_keys"),
        F.count(F.lit(1)).alias("n_deliveries"),
    )
    now, before = F.col("t.n_orphans"), F.col("t.before")
    status = (
        F.when(now == 0, "clean")
        .when(now == before, "resolved")
        .when(before > 0, "repeated")
        .otherwise("open")
    )
    return last.select(
        *by,
        "t.n_rows",
        "t.n_null",
        "t.n_orphans",
        (F.col("t.n_keyed") - F.col("n_keys")).alias("n_repeated"),
        "t.latest",
        "n_deliveries",
        status.alias("status"),
    )
