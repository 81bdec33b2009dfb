"""Facts that grow by deliveries, against the same facts counted at once."""

from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from culprit.streaming.fact_stream import feed_facts, start_fact_stream

# feed, key, reference, moment; parents 1 and 2 exist.
DELIVERIES = [
    [("a", 1, 1, 5), ("a", 1, 2, 6), ("a", None, 9, 7), ("b", 1, None, 1), ("c", 4, 1, 1)],
    [("a", 1, 1, 8), ("a", 2, 8, 2), ("b", 2, 7, None), (None, 1, 1, 3), ("c", 4, None, 2)],
    [("a", 3, 1, 4), ("a", None, 1, 9), ("b", 2, 7, 2), ("d", 5, 6, 1)],
]
SCHEMA = "feed string, key bigint, ref bigint, at int"


def plain(deliveries):
    """(rows, nulls, orphans, repeated, deliveries, status) by feed."""
    out = {}
    for feed in {r[0] for d in deliveries for r in d}:
        own = [[r for r in d if r[0] == feed] for d in deliveries]
        own = [d for d in own if d]
        lost = [sum(r[2] not in (None, 1, 2) for r in d) for d in own]
        every = [r for d in own for r in d]
        keys = Counter(r[1] for r in every if r[1] is not None)
        if not sum(lost):
            status = "clean"
        elif not lost[-1]:
            status = "resolved"
        else:
            status = "repeated" if sum(lost[:-1]) else "open"
        out[feed] = (
            len(every), sum(r[2] is None for r in every), sum(lost),
            sum(n - 1 for n in keys.values()), len(own), status,
        )
    return out


def streamed(spark, folder, deliveries):
    parent = spark.sql("SELECT * FROM VALUES (1L), (2L), (NULL) t(k)")
    moment = F.timestamp_seconds("at").alias("at")

    def run():
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        start_fact_stream(
            arriving.select("feed", "key", "ref", moment), folder, by=["feed"], key="key",
            reference="ref", parent=parent, parent_key="k", moment="at",
        ).awaitTermination()

    for d in deliveries:
        spark.createDataFrame(d, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        run()
    run()  # nothing new
    return feed_facts(spark, folder, ["feed"])


def told(df):
    names = ("n_rows", "n_null", "n_orphans", "n_repeated", "n_deliveries", "status")
    return {r.feed: tuple(r[n] for n in names) for r in df.collect()}


def test_deliveries_add_up(spark, tmp_path):
    parted = streamed(spark, str(tmp_path / "three"), DELIVERIES)
    assert told(parted) == plain(DELIVERIES)
    assert {s[-1] for s in told(parted).values()} == {"clean", "open", "repeated", "resolved"}
    whole = [[r for d in DELIVERIES for r in d]]
    at_once = streamed(spark, str(tmp_path / "one"), whole)
    assert told(at_once) == plain(whole)
    same = ("feed", "n_rows", "n_null", "n_orphans", "n_repeated", "latest")
    assert rows(parted, *same) == rows(at_once, *same)


def test_a_batch_reads_its_own_files(spark, tmp_path):
    """No delivery reads the rows of an earlier one."""
    read = []
    for d in DELIVERIES:
        spark.createDataFrame(d, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = start_fact_stream(
            arriving.withColumn("at", F.timestamp_seconds("at")), str(tmp_path), by=["feed"],
            key="key", reference="ref", parent=spark.sql("SELECT 1L AS k"), parent_key="k", moment="at",
        )
        query.awaitTermination()
        read.append(sum(p["sources"][0]["numInputRows"] for p in query.recentProgress))
    assert read == [len(d) for d in DELIVERIES]
