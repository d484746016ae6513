import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, loading, tickets
from tidewatch.sources import readers
from tidewatch.sources.warehouse import Warehouse
from tidewatch.streaming import ingest as streams

AS_OF = "2024-01-20 00:00:00"
COLUMNS = ["ticket_id", "created_at", "resolved_at", "category", "priority", "status"]
HEADER = ",".join(COLUMNS) + "\n"


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()

    def put(name, *rows):
        (folder / name).write_text(HEADER + "".join(",".join(r) + "\n" for r in rows))

    put.folder = str(folder)
    return put


def ticket(number, day="2024-01-15", status="open", resolved=""):
    return (f"T{number}", f"{day} 09:00:00" if day != "bad" else "bad", resolved, "c", "low", status)


def run(spark, landing, store, tmp_path):
    stream = streams.landing_stream(spark, landing.folder, COLUMNS, files_per_batch=1)
    streams.start_feed_stream(stream, store, "tickets", AS_OF, str(tmp_path / "state")).awaitTermination()


def test_stream_gives_what_a_batch_gives(spark, landing, tmp_path):
    landing("a.csv", ticket(1), ticket(2, "bad"), ticket(3, resolved="2024-01-19 09:00:00"))
    landing("b.csv", ticket(4), ticket(5, status="closed"))
    store = Warehouse(spark, str(tmp_path / "w"))
    run(spark, landing, store, tmp_path)
    batch = cleaning.clean_tickets(readers.read_csv_feed(spark, landing.folder), AS_OF)
    expected = loading.ticket_facts(batch.clean, "x").drop("source_file")
    found = store.read("fact_ticket").select(*expected.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert store.read("staging_error").count() == 1
    audit = store.read("ingestion_run").agg(
        F.count("*"), F.sum("raw_rows"), F.sum("error_count")).first()
    assert tuple(audit) == (2, 5, 1)


def test_repeats_across_batches_and_restarts(spark, landing, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    landing("a.csv", ticket(1), ticket(1, status="closed"), ticket(2))
    run(spark, landing, store, tmp_path)
    landing("b.csv", ticket(2, status="closed"), ticket(3))
    run(spark, landing, store, tmp_path)  # the checkpoint remembers a.csv
    run(spark, landing, store, tmp_path)  # nothing new
    found = {r.ticket_id: r.status for r in store.read("fact_ticket").collect()}
    assert found == {"T1": "open", "T2": "open", "T3": "open"}
    assert store.read("ingestion_run").count() == 2


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    rows = spark.sql("select 'T1' as ticket_id, date'2024-01-15' as created_date")
    assert [store.append("fact_ticket", rows, "stream-3") for _ in range(2)] == [1, 1]
    assert store.append("fact_ticket", rows.limit(0), "stream-4") == 0
    assert store.append("fact_ticket", rows, "stream-4") == 0  # this commit is known to have no rows
    assert store.read("fact_ticket").count() == 1


def test_a_batch_that_failed_half_way_is_completed(spark, landing, tmp_path, monkeypatch):
    landing("a.csv", ticket(1), ticket(2, "bad"))
    store = Warehouse(spark, str(tmp_path / "w"))
    with monkeypatch.context() as patch:
        def lost(*args):
            raise RuntimeError("lost")

        patch.setattr(streams.ingest.loading, "load_errors", lost)
        with pytest.raises(Exception, match="lost"):
            run(spark, landing, store, tmp_path)
    assert store.read("fact_ticket").count() == 1 and store.read("staging_error") is None
    run(spark, landing, store, tmp_path)
    assert store.read("fact_ticket").count() == 1 and store.read("staging_error").count() == 1
    (audit,) = store.read("ingestion_run").collect()
    assert (audit.run_id, audit.raw_rows, audit.loaded_rows, audit.error_count) == ("stream-0", 2, 1, 1)


def test_batch_stream_batch_share_one_layout(spark, landing, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))

    def batch(name, *rows):
        feed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                     "row_index long, " + ", ".join(f"{c} string" for c in COLUMNS))
        streams.ingest.ingest_feed(store, feed, "tickets", name, AS_OF, AS_OF)

    batch("one", ticket(1), ticket(2, "2024-02-03"), ticket(3, "bad"))
    landing("a.csv", ticket(2, status="closed"), ticket(4, "2024-02-05"), ticket(5, "bad"))
    run(spark, landing, store, tmp_path)
    batch("two", ticket(4, status="closed"), ticket(6, "2024-02-05"))
    found = {r.ticket_id: r.status for r in store.read("fact_ticket").collect()}
    assert found == {"T1": "open", "T2": "open", "T4": "open", "T6": "open"}
    assert store.read_between("fact_ticket", "2024-02-01", "2024-02-28").count() == 3
    assert sorted(r.source_file for r in store.read("staging_error").collect()) == ["a.csv", "one"]
    assert {str(r.date) for r in store.read("dim_date").collect()} == {"2024-01-15", "2024-02-03", "2024-02-05"}


def test_records_are_validated_on_the_stream(spark, landing, tmp_path):
    names = ["ticket_number", *COLUMNS[1:]]
    for name, rows in (("a.csv", [ticket(1), ("T2", "2024-01-15", "", "c", "none", "open")]),
                       ("b.csv", [("T3", "2024-01-15", "", "c", "none", "open")]),
                       ("c.csv", [ticket(1, status="closed"), ticket(4, "2024-02-01")])):
        text = ",".join(names) + "\n" + "".join(",".join(r) + "\n" for r in rows)
        (tmp_path / "landing" / name).write_text(text)
    store = Warehouse(spark, str(tmp_path / "w"))
    times = iter(f"2024-01-20 00:00:{s:02d}" for s in range(60))
    stream = streams.landing_stream(spark, landing.folder, names, files_per_batch=1)
    streams.start_record_stream(
        stream, store, "ticket", str(tmp_path / "state"), clock=lambda: next(times)).awaitTermination()
    facts = {r.ticket_number: r.status for r in store.read("fact_ticket_record").collect()}
    assert facts == {"T1": "closed", "T4": "open"}
    runs = {r.run_id: (r.status, r.rows_read, r.rows_inserted, r.rows_quarantined)
            for r in store.read("ingestion_run").collect()}
    assert runs == {"records-0": ("partial", 2, 1, 1), "records-1": ("failed", 1, 0, 1),
                    "records-2": ("success", 2, 2, 0)}
    assert all(r.completed_at > r.started_at for r in store.read("ingestion_run").collect())
    bad = store.read("quarantined_row").collect()
    assert [(r.run_id, r.source_file, r.error_codes) for r in bad] == [
        ("records-0", "a.csv", ["INVALID_ENUM_PRIORITY"])]


def test_dedup_on_the_stream(spark, landing, tmp_path):
    landing("a.csv", ticket(1), ticket(2), ticket(1))
    stream = streams.landing_stream(spark, landing.folder, COLUMNS)
    out = str(tmp_path / "out")
    streams.first_tickets(stream, "1 day").select("ticket_id").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.ticket_id for r in spark.read.parquet(out).collect()) == ["T1", "T2"]


def test_a_repeat_outside_the_delay_is_left_to_the_load(spark, landing, tmp_path):
    days = {"a": (1, "2024-01-15"), "b": (1, "2024-01-15"), "c": (7, "2024-03-01"), "d": (8, "2024-03-02"),
            "e": (1, "2024-03-03")}
    store, out = Warehouse(spark, str(tmp_path / "w")), str(tmp_path / "out")
    for k, (name, row) in enumerate(days.items()):
        landing(f"{name}.csv", ticket(*row))
        os.utime(f"{landing.folder}/{name}.csv", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in this order
    stream = streams.landing_stream(spark, landing.folder, COLUMNS, files_per_batch=1)
    streams.first_tickets(stream, "1 day").select("ticket_id").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "first")).trigger(availableNow=True).start(out).awaitTermination()
    found = sorted(r.ticket_id for r in spark.read.parquet(out).collect())
    assert found == ["T1", "T1", "T7", "T8"]  # the state has forgotten T1 by then
    run(spark, landing, store, tmp_path)
    facts = {r.ticket_id: str(r.created_date) for r in store.read("fact_ticket").collect()}
    assert facts == {"T1": "2024-01-15", "T7": "2024-03-01", "T8": "2024-03-02"}


def test_daily_volume_emits_closed_days(spark, tmp_path):
    source = str(tmp_path / "facts")
    rows = [(f"2024-01-{d:02d} 12:00:00", p) for d in range(1, 8) for p in ("low", "critical")]
    df = spark.createDataFrame(rows, "t string, priority string").select(
        F.col("t").cast("timestamp").alias("created_at"), "priority")
    df.write.parquet(source)
    out = str(tmp_path / "out")
    streams.daily_ticket_volume(spark.readStream.schema(df.schema).parquet(source)).writeStream.format(
        "parquet").option("checkpointLocation", str(tmp_path / "s")).outputMode("append").trigger(
        availableNow=True).start(out).awaitTermination()
    found = {str(r.date): (r.ticket_count, r.critical_count) for r in spark.read.parquet(out).collect()}
    assert found == {f"2024-01-{d:02d}": (2, 1) for d in range(1, 6)}
    batch = tickets.daily_ticket_measures(
        df.select(F.col("created_at").cast("date").alias("created_date"), "priority",
                  F.lit(False).alias("sla_breached"), F.lit(1).alias("resolution_minutes")))
    assert {str(r.date): (r.ticket_count, r.critical_count) for r in batch.collect()
            if str(r.date) in found} == found
