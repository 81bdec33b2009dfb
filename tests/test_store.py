from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows
from pyspark.sql import functions as F

from culprit.catalog import fixtures as fx
from culprit.operators.incidents import from_payload, incident_rows, narrate
from culprit.sources import jsonl, store
from culprit.sources.report import write_report
from culprit.sources.tables import materialise, seed_csv


@pytest.fixture(scope="module")
def incidents(spark, folder):
    return fx.line_incidents(spark, folder).persist()


def test_payload_is_lossless(incidents):
    back = from_payload(incident_rows(incidents))
    assert back.schema.simpleString() == incidents.schema.simpleString()
    assert back.exceptAll(incidents).count() == 0 and incidents.exceptAll(back).count() == 0


def test_no_verdict_means_no_final_class(incidents):
    got = incident_rows(incidents)
    wrong = (F.col("verdict_type") == "triage_only") != F.col("final_cause_class").isNull()
    assert got.filter(wrong).count() == 0


def test_lifecycle(spark, incidents, tmp_path):
    kept = store.IncidentStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        kept.current()
    kept.save(incidents)
    total = incidents.count()
    assert kept.current().count() == total
    kept.save(incidents)
    assert kept.current().count() == total
    first = kept.current().orderBy("incident_id").first().incident_id
    assert kept.label(first, "late_arriving") and not kept.label("inc_none", None)
    row = kept.load(first).first()
    assert row.human_label == "late_arriving" and '"human_label":"late_arriving"' in row.payload
    assert kept.label(first, None) and kept.load(first).first().human_label is None
    with pytest.raises(ValueError):
        kept.label(first, "nonsense")
    assert kept.delete([first]) and not kept.delete([first])
    assert kept.load(first).isEmpty() and kept.current().count() == total - 1
    kept.save(incidents.filter(F.col("incident_id") == first))
    assert kept.current().count() == total


def test_replayed_batch_changes_nothing(spark, incidents, tmp_path):
    kept = store.IncidentStore(spark, str(tmp_path))
    kept.save(incidents, batch="b0")
    before = rows(kept.current())
    kept.save(incidents, batch="b0")
    assert rows(kept.current()) == before


def test_last_write_wins_whoever_writes(spark, incidents, tmp_path):
    kept = store.IncidentStore(spark, str(tmp_path))
    kept.save(incidents, batch="s#0")
    one = kept.current().orderBy("incident_id").first().incident_id
    assert kept.label(one, "unknown") and kept.label(one, "late_arriving")
    kept.compact()
    kept.save(incidents, batch="s#0")
    assert kept.load(one).first().human_label == "late_arriving"
    kept.save(incidents, batch="s#1")
    assert kept.load(one).first().human_label is None
    assert kept.label(one, "unknown")
    kept.save(incidents, batch="t#0")
    kept.compact()
    assert kept.load(one).first().human_label is None
    assert kept.current().count() == incidents.count()


def few(spark, *names, label="x"):
    return spark.createDataFrame([(n, label) for n in names], "incident_key string, notes string")


def test_writers_at_once_are_both_kept_in_order(spark, tmp_path):
    """Whoever finds a number taken goes on to the next; no change is lost or numbered twice."""
    stores = [store.IncidentStore(spark, str(tmp_path), "ground_truths") for _ in range(6)]

    def write(i):
        stores[i].save_rows(few(spark, "same", f"own{i}", label=f"by {i}"), batch=f"writer {i}")

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    names = stores[0].commits.names()
    assert names == [f"{i:012d}" for i in range(6)]
    last = stores[0].commits.read(names[-1:])[names[-1]]["batch"].split()[1]
    found = dict(rows(stores[0].current()))
    assert found == {"same": f"by {last}", **{f"own{i}": f"by {i}" for i in range(6)}}


def test_a_taken_number_is_passed_by(spark, tmp_path, monkeypatch):
    one, two = (store.IncidentStore(spark, str(tmp_path), "ground_truths") for _ in range(2))
    stale = one._since()
    monkeypatch.setattr(one, "_since", lambda: stale)
    two.save_rows(few(spark, "a", label="two"))
    one.save_rows(few(spark, "a", label="one"))
    assert rows(two.current()) == [("a", "one")]


def test_half_a_batch_is_not_there_and_its_replay_is_whole(spark, tmp_path, monkeypatch):
    kept = store.IncidentStore(spark, str(tmp_path), "ground_truths")
    kept.save_rows(few(spark, "old"))
    with monkeypatch.context() as m:
        # The writer dies after its files are written and before they are committed.
        m.setattr(kept.commits, "make", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.save_rows(few(spark, "a", "b"), batch="b#0")
    assert rows(kept.current()) == [("old", "x")]
    kept.compact()
    kept.save_rows(few(spark, "a", "b"), batch="b#0")
    assert kept.current().count() == 3
    kept.compact()
    kept.save_rows(few(spark, "a", label="newer"))
    kept.save_rows(few(spark, "a", "b"), batch="b#0")
    assert dict(rows(kept.current()))["a"] == "newer"


def test_snapshots_open_one_bucket_and_no_old_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 25)
    kept = store.IncidentStore(spark, str(tmp_path), "ground_truths")
    for i in range(3):
        kept.save_rows(few(spark, *[f"k{j}" for j in range(100)], label=f"round {i}"))
    old = set(kept.current().inputFiles())
    kept.compact()
    files = kept.current().inputFiles()
    assert not old & set(files) and len(files) == 4
    assert kept.load("k7").first().notes == "round 2"
    scan = next(x for x in kept.load("k7")._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "_bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(list((tmp_path / "ground_truths" / "data").iterdir())) == 4
    assert kept.prune() == 3 and kept.current().count() == 100
    assert len(list((tmp_path / "ground_truths" / "data").iterdir())) == 1
    kept.save_rows(few(spark, "k7", label="after"))
    assert kept.load("k7").first().notes == "after" and kept.current().count() == 100


def test_few_rows_are_one_file(spark, incidents, tmp_path):
    kept = store.IncidentStore(spark, str(tmp_path))
    kept.save(incidents.repartition(8))
    assert len(kept.current().inputFiles()) == 1


def test_unreadable_files_are_no_empty_store(spark, tmp_path):
    kept = store.IncidentStore(spark, str(tmp_path), "ground_truths")
    kept.save_rows(few(spark, "a"))
    for file in (tmp_path / "ground_truths" / "data").rglob("*.parquet"):
        file.write_bytes(b"damaged")
    with pytest.raises(Exception, match="(?i)parquet|footer|CANNOT_READ"):
        kept.current().collect()


def test_listing(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('a',1,'m1','x','auto'),('b',3,'m1','y','auto'),('c',2,'m2','x','auto')
        t(incident_id, created_at, failing_model, final_cause_class, verdict_type)"""
    )
    assert [r.incident_id for r in store.listing(df).collect()] == ["b", "c", "a"]
    assert [r.incident_id for r in store.listing(df, cause_class="x", limit=1).collect()] == ["c"]
    assert store.listing(df, failing_model="m1", verdict_type="auto").count() == 2


def test_upsert_and_delete(spark):
    old = spark.sql("SELECT * FROM VALUES ('a',1),('b',2) t(incident_id, n)")
    new = spark.sql("SELECT * FROM VALUES ('b',9),('c',3) t(incident_id, n)")
    assert rows(store.upsert(old, new, "incident_id")) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(store.delete(old, new, "incident_id")) == [("a", 1)]


def test_messages(incidents):
    told = narrate(incidents).first()
    assert told.headline.endswith(told.failing_test_name)
    assert told.chat_blocks.count('"type":"divider"') == 2
    assert f"feedback|{told.incident_id}|accept" in told.chat_blocks
    assert told.one_line_fix in told.review_body


def test_truth_files(spark, tmp_path):
    truths = spark.sql(
        "SELECT 'k' AS incident_key, 'unknown' AS cause_class, 't' AS source_table, "
        "CAST(NULL AS STRING) AS source_column, TIMESTAMP '2026-01-01' AS injected_at, "
        "'p' AS fault_pattern, '' AS notes"
    )
    keys = spark.sql("SELECT * FROM VALUES ('k','1'),('k','2') t(incident_key, pk)")
    assert jsonl.write_truths(truths, keys, str(tmp_path)) == 1
    (tmp_path / "labels" / "blank.json").write_text("\n\n")
    labels, back = jsonl.read_truths(spark, str(tmp_path))
    assert rows(labels) == rows(truths) and rows(back) == rows(keys)
    kept = store.IncidentStore(spark, str(tmp_path), "ground_truths")
    kept.save_rows(truths)
    kept.save_rows(truths.withColumn("notes", F.lit("seen")))
    assert [r.notes for r in kept.current().collect()] == ["seen"]


def test_report_and_seed_files(spark, tmp_path):
    scores = spark.sql("SELECT 1D top1_table_acc, 1D top3_table_acc, 1D column_acc_given_table, "
                       "1D row_recall, 1D row_f1, 1D macro_class_f1, 1D median_latency_s, 0D ece")
    write_report(scores, spark.range(1), spark.range(1), str(tmp_path / "r"), "me")
    assert spark.read.parquet(str(tmp_path / "r/scores")).first().line.startswith("| me |")
    (tmp_path / "seed.csv").write_text("id,name\n1,a\n2,b\n")
    seed = seed_csv(spark, str(tmp_path / "seed.csv"), "id int, name string")
    assert rows(seed) == [(1, "a"), (2, "b")]
    materialise(seed, "staging", "seed_view")
    assert spark.table("seed_view").count() == 2
