"""Streams: state across batches, and agreement with the batch operators."""

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import tokens
from tallyweave.operators.ledger import bundle_by_contact, upsert_ledger
from tallyweave.streaming import bundles, flows, state

COMMAND = "tenant_id string, command_id string, kind string, statement_id string, tokens bigint, at timestamp, source string"


def commands(batch):
    start = datetime(2024, 1, 1)
    return [("T", c, kind, s, n, start + timedelta(minutes=i), "test") for i, (c, kind, s, n) in enumerate(batch)]


BATCHES = [
    [("g1", "adjust", None, 10), ("r1", "reserve", "A", 4), ("r1", "reserve", "B", 3), ("r2", "reserve", "C", 4), ("r2", "reserve", "D", 1)],
    [("r1", "reserve", "A", 4), ("x1", "release", "A", 0), ("x2", "consume", "A", 0), ("x3", "consume", "B", 0), ("x4", "release", "Z", 0), ("n1", "adjust", None, -8), ("n2", "adjust", None, -7)],
]


@pytest.fixture
def ledger_rows(spark, tmp_path):
    """Ledger rows after each of the batches has arrived as a file of its own."""
    folder = tmp_path / "commands"
    for i, batch in enumerate(BATCHES):
        rows = commands(batch)
        # Lines of one command share its time.
        first = {}
        rows = [(*r[:5], first.setdefault(r[1], r[5]), r[6]) for r in rows]
        spark.createDataFrame(rows, COMMAND).coalesce(1).write.parquet(str(folder / f"b{i}"))
        stream = spark.readStream.schema(COMMAND).option("recursiveFileLookup", True).parquet(str(folder))
        writer = state.token_ledger_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).foreachBatch(flows.append_batch(str(tmp_path / "out"))).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_token_ledger_stream(ledger_rows):
    by_id = {r.entry_id: r for r in ledger_rows if r.entry_type != "ADJUSTMENT"}
    accepted = {k: (r.accepted, r.token_delta) for k, r in by_id.items()}
    assert accepted == {
        "reserve#A": (True, -4),
        "reserve#B": (True, -3),
        # 5 pages against a balance of 3: neither statement of the command is reserved.
        "reserve#C": (False, 0),
        "reserve#D": (False, 0),
        # The first settlement of A counts, the second and that of an unknown statement do not.
        "release#A": (True, 4),
        "consume#B": (True, 0),
    }
    adjusted = {r.entry_id: (r.accepted, r.balance) for r in ledger_rows if r.entry_type == "ADJUSTMENT"}
    assert adjusted == {"g1": (True, 10), "n1": (False, 7), "n2": (True, 0)}
    assert sum(r.token_delta for r in ledger_rows) == 0


def test_streamed_upserts_equal_the_batch_operator(spark, tmp_path):
    schema = "tenant_id string, doc_id string, number string, load_seq bigint"
    parts = [[("T", "a", "1", 1), ("T", "b", "2", 2), ("T", None, "k", 3)], [("T", "b", "3", 1), ("T", "c", "4", 2)], []]
    current = spark.createDataFrame([], schema)
    for i, part in enumerate(parts):
        delta = spark.createDataFrame(part, schema)
        delta.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        current = upsert_ledger(current, delta, "doc_id")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        flows.stream_upsert_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination()
    got = flows.read_current_ledger(spark, str(tmp_path / "ledger"), "doc_id")
    want = sorted(map(str, current.collect()))
    assert sorted(map(str, got.select(current.columns).collect())) == want
    flows.compact_ledger(spark, str(tmp_path / "ledger"), str(tmp_path / "compact"), "doc_id")
    again = flows.read_current_ledger(spark, str(tmp_path / "compact"), "doc_id")
    assert sorted(map(str, again.select(current.columns).collect())) == want


def test_failed_source_fails_the_batch(spark, tmp_path):
    bad = spark.range(1).select(F.raise_error(F.lit("source failed")).cast("string").alias("doc_id"))
    with pytest.raises(Exception, match="source failed"):
        flows.append_batch(str(tmp_path / "ledger"))(bad, 0)


def test_alert_stream_agrees_with_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    logs = [("ERROR" if i % 3 else "INFO", start + timedelta(seconds=25 * i)) for i in range(40)]
    df = spark.createDataFrame(logs, "level string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.error_alert_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True)
    writer.foreachBatch(flows.append_batch(str(tmp_path / "out"))).start().awaitTermination()
    got = {(r.window_start, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = max(ts for level, ts in logs if level == "ERROR") - timedelta(minutes=1)
    want = {(r.window_start, r.errors) for r in tokens.error_rate_alerts(df).collect() if r.window_end <= closed}
    assert got == want and got


def test_stale_sync_stream(spark, tmp_path):
    schema = "tenant_id string, heartbeat_ms bigint, running boolean"
    spark.createDataFrame([("stopped", 1, True), ("done", 1, True), ("done", 2, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = state.stale_sync_stream(stream, 2000)
    query = (
        found.writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "s"))
        .trigger(processingTime="1 second")
        .foreachBatch(flows.append_batch(str(tmp_path / "out")))
        .start()
    )
    try:
        deadline, seen = time.time() + 60, []
        while time.time() < deadline and not seen:
            time.sleep(2)
            if (tmp_path / "out").exists():
                seen = [r.tenant_id for r in spark.read.schema("tenant_id string, heartbeat_ms bigint, batch int").parquet(str(tmp_path / "out")).collect()]
        assert seen == ["stopped"]
    finally:
        query.stop()


def test_an_event_repeated_days_later_is_known_and_a_late_one_is_not_lost(spark, tmp_path):
    kind, folder = "event_id string, received_at timestamp", tmp_path / "events"
    batches = [[("a", 10), ("b", 10)], [("a", 13), ("c", 1), (None, 13)], [("c", 40), ("b", 11), ("d", 2)]]
    for i, batch in enumerate(batches):
        rows = [(e, datetime(2024, 1, 1) + timedelta(days=d)) for e, d in batch]
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(folder / f"b{i}"))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(folder))
        writer = flows.dedupe_event_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).foreachBatch(flows.append_batch(str(tmp_path / "out"))).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((str(r.event_id), r.received_at.day) for r in out) == [("None", 14), ("a", 11), ("b", 11), ("c", 2), ("d", 3)]


DOC = "tenant_id string, contact_id string, doc_kind string, doc_id string, number string, load_seq bigint"
PAYMENT = "tenant_id string, contact_id string, payment_id string, invoice_id string, load_seq bigint"


def listed(bundles):
    return sorted(str(r) for r in bundles.select("tenant_id", "contact_id", "part", "parts", "invoices", "credit_notes", "payments").collect())


def test_bundles_after_every_batch_equal_those_of_the_folded_ledger(spark, tmp_path):
    rng = random.Random(3)
    ledger, payments = spark.createDataFrame([], DOC), spark.createDataFrame([], PAYMENT)
    folder = str(tmp_path / "bundles")
    for n in range(4):
        docs = [("T", rng.choice(["A", "B", "C", None, ""]), rng.choice(["invoice", "credit_note"]), rng.choice([f"d{rng.randint(1, 12)}", None]), f"{n}-{i}", 100 * n + i) for i in range(14 if n < 3 else 1)]
        paid = [("T", rng.choice("ABCD"), f"p{rng.randint(1, 6)}", "d1", 100 * n + i) for i in range(5 if n < 3 else 0)]
        delta, paid = spark.createDataFrame(docs, DOC), spark.createDataFrame(paid, PAYMENT)
        records = bundles.ledger_records(delta, paid)
        records.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(records.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        bundles.stream_contact_bundles(stream, folder, str(tmp_path / "state"), bundle_size=4).awaitTermination()
        ledger, payments = upsert_ledger(ledger, delta, "doc_id").checkpoint(), upsert_ledger(payments, paid, "payment_id").checkpoint()
        want = listed(bundle_by_contact(ledger, payments, 4))
        assert listed(bundles.read_bundles(spark, folder)) == want
        if n == 1:  # the batch again, as after a failure: it starts from the versions before it
            bundles.bundle_batch(folder, bundle_size=4)(records, n)
            assert listed(bundles.read_bundles(spark, folder)) == want
    some = spark.createDataFrame([("T", "B"), ("T", None)], "tenant_id string, contact_id string")
    assert {r.contact_id for r in bundles.read_bundles(spark, folder, some).collect()} == {"B"}
    # One document moved last: only the buckets of its contacts were written.
    last = spark.read.parquet(f"{folder}/bundles").where("batch = 3").select("bucket").distinct().count()
    assert last <= 2 < spark.read.parquet(f"{folder}/bundles").where("batch = 0").select("bucket").distinct().count() + 1


def test_a_version_without_its_file_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "bundles")
    rows = lambda contact: bundles.ledger_records(spark.createDataFrame([("T", contact, "invoice", "d", "1", 1)], DOC), spark.createDataFrame([], PAYMENT))
    bundles.bundle_batch(folder)(rows("A"), 0)
    bundles.bundle_batch(folder)(rows("B"), 1)
    assert [r.contact_id for r in bundles.read_bundles(spark, folder).collect()] == ["B"]
    assert bundles._versions(spark, folder, before=1)["bundles"] and [r.contact_id for r in bundles._buckets(spark, folder, "bundles", bundles._versions(spark, folder, before=1)["bundles"]).collect()] == ["A"]


def test_unique_events_over_a_year_without_state(spark, tmp_path):
    kind, folder, out = "event_id string, received_at timestamp", tmp_path / "in", str(tmp_path / "out")
    rng, known, want, sizes = random.Random(4), [], {}, []
    for n in range(6):  # two months lie between batches
        day = datetime(2024, 1, 1) + timedelta(days=61 * n)
        fresh = [f"e{n}-{i}" for i in range(20)]
        rows = [(e, day + timedelta(minutes=rng.randint(0, 999))) for e in fresh * 2 + rng.sample(known, len(known) // 3)] + [(None, day)]
        for e, at in rows:
            if e and e not in known:
                want[e] = min(want.get(e, at), at)
        known += fresh
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(folder / f"b{n}"))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(folder))
        query = flows.stream_unique_events(stream, out, str(tmp_path / "state"))
        query.awaitTermination()
        sizes.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
        if n == 2:  # the batch again, as after a failure
            flows.unique_batch(out)(spark.createDataFrame(rows, kind), n)
        if n == 3:
            flows.fold_processed(spark, out)
            assert sorted(p.name for p in (tmp_path / "out" / "processed").iterdir() if p.is_dir()) == ["batch=0", "batch=3"]
    rows = spark.read.parquet(f"{out}/events").collect()
    assert {r.event_id: r.received_at for r in rows if r.event_id} == want and len(rows) == len(want) + 6
    assert set(sizes) == {0}


def test_silence_by_event_time_across_batches(spark, tmp_path):
    kind, start = "tenant_id string, at timestamp, running boolean", datetime(2024, 1, 1)
    minute = lambda n: start + timedelta(minutes=n)
    batches = [
        [("a", minute(0), True), ("b", minute(1), True), ("c", minute(2), True), ("a", minute(5), True)],
        [("b", minute(4), False), ("a", minute(40), True), ("d", minute(41), True)],  # a was silent for 35 minutes; b had ended
        [("d", minute(55), True), ("e", minute(90), False)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        stream = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        writer = state.silent_sync_stream(stream, 20 * 60_000, late="10 minutes").writeStream.option("checkpointLocation", str(tmp_path / "s"))
        writer.trigger(availableNow=True).foreachBatch(flows.append_batch(str(tmp_path / "out"))).start().awaitTermination()
    out = spark.read.schema("tenant_id string, heartbeat_ms bigint, batch int").parquet(str(tmp_path / "out")).collect()
    found = sorted((r.tenant_id, (r.heartbeat_ms - int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)) // 60_000) for r in out)
    assert found == [("a", 5), ("a", 40), ("c", 2), ("d", 55)]
