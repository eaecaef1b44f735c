"""The streams, run to the end over the given tables."""

from __future__ import annotations

import itertools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from checks.derive import Tables, with_tables
from checks.queries_rows import FLAGGED
from checks.registry import money, money_sql, query
from tallyweave.session import checkpoint_folder
from tallyweave.sources import byte_ranges, ledger_files, pdf_landing, snapshots
from tallyweave.streaming import bundles, flows, state


def _stream(t: Tables, table: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    schema = t.spark.read.parquet(f"{t.folder}/{table}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


def _derived_stream(t: Tables, table: str, name: str) -> DataFrame:
    _stream(t, table).createOrReplaceTempView(table)
    return t.spark.sql(with_tables((name,), f"SELECT * FROM {name}"))


def _scratch(t: Tables) -> str:
    return f"{checkpoint_folder(t.spark)}/run-{uuid.uuid4().hex}"


def _finished(t: Tables, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Rows a stream gives for all there is to read."""
    folder = _scratch(t)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)
    writer.foreachBatch(flows.append_batch(f"{folder}/rows")).start().awaitTermination()
    return t.spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/rows").drop("batch")


def _commands(events: DataFrame) -> DataFrame:
    """Events as ledger commands: grants, reservations of one to three statements, and settlements of the event before.

    Every seventh command is delivered twice.
    """
    kind = (
        F.when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "click", "consume").when(F.col("event_type") == "error", "release").otherwise("adjust")
    )
    event = F.when(F.col("event_type") == "view", F.col("event_id")).otherwise(F.col("event_id") - F.col("event_id") % 3)
    lines = F.when(F.col("event_type") == "view", 1 + F.col("event_id") % 3).otherwise(1 + F.col("event_id") % 2)
    copies = F.when(F.col("event_id") % 7 == 0, 2).otherwise(1)
    tokens = F.when(F.col("event_type") == "signup", 5).otherwise(1 + F.col("event_id") % 20)
    own = events.withColumn("line", F.explode(F.flatten(F.array_repeat(F.sequence(F.lit(1), lines.cast("int")), copies))))
    own = own.where((kind != "adjust") | (F.col("line") == 1))
    return own.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"),
        kind.alias("kind"),
        F.concat(F.lit("S"), event.cast("string"), F.lit("/"), F.col("line").cast("string")).alias("statement_id"),
        (tokens + F.col("line") - 1).cast("bigint").alias("tokens"),
        F.col("ts").cast("timestamp").alias("at"),
        F.lit("stream").alias("source"),
    )


# The ledger of a tenant command by command: balance and open reservations go from row to row. A reservation
# holds its lines and is accepted with all of them or none; each line of a command gives an entry with the balance after it.
_WALK = """WITH RECURSIVE c AS (
    SELECT concat('T', CAST(user_id AS VARCHAR)) AS tenant_id, concat('c', CAST(event_id AS VARCHAR)) AS command_id,
      CASE event_type WHEN 'view' THEN 'RESERVE' WHEN 'click' THEN 'CONSUME' WHEN 'error' THEN 'RELEASE' ELSE 'ADJUSTMENT' END AS kind,
      list_transform(range(1, CASE WHEN event_type = 'view' THEN 2 + event_id % 3 WHEN event_type IN ('click', 'error') THEN 2 + event_id % 2 ELSE 2 END),
        lambda i: {'s': concat('S', CAST(CASE WHEN event_type = 'view' THEN event_id ELSE event_id - event_id % 3 END AS VARCHAR), '/', CAST(i AS VARCHAR)),
          'n': CAST(CASE WHEN event_type = 'signup' THEN 5 ELSE 1 + event_id % 20 END + i - 1 AS BIGINT)}) AS lines,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, concat('c', CAST(event_id AS VARCHAR))) AS n FROM events),
  walk AS (
    SELECT DISTINCT tenant_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS balance, CAST([] AS STRUCT(s VARCHAR, n BIGINT)[]) AS held,
      CAST(NULL AS VARCHAR) AS command_id, CAST(NULL AS VARCHAR) AS kind, CAST([] AS STRUCT(s VARCHAR, n BIGINT)[]) AS entries, CAST(NULL AS BOOLEAN) AS accepted, CAST(0 AS BIGINT) AS before FROM c
    UNION ALL
    SELECT tenant_id, n, balance + CAST(coalesce(list_sum(list_transform(entries, lambda x: x.n)), 0) AS BIGINT),
      CASE WHEN kind = 'RESERVE' AND ok THEN list_concat(held, lines) WHEN kind IN ('CONSUME', 'RELEASE') THEN list_filter(held, lambda x: NOT list_contains(list_transform(lines, lambda y: y.s), x.s)) ELSE held END,
      command_id, kind, entries, ok, balance
    FROM (SELECT *, CASE kind WHEN 'RESERVE' THEN list_transform(lines, lambda x: {'s': x.s, 'n': CASE WHEN ok THEN -x.n ELSE 0 END})
        WHEN 'CONSUME' THEN list_transform(own, lambda x: {'s': x.s, 'n': CAST(0 AS BIGINT)}) WHEN 'RELEASE' THEN own ELSE [{'s': CAST(NULL AS VARCHAR), 'n': lines[1].n}] END AS entries
      FROM (SELECT c.tenant_id, c.n, c.kind, c.lines, c.command_id, w.balance, w.held, CASE WHEN c.kind = 'RESERVE' THEN w.balance >= list_sum(list_transform(c.lines, lambda x: x.n)) ELSE true END AS ok,
          list_sort(list_filter(w.held, lambda x: list_contains(list_transform(c.lines, lambda y: y.s), x.s))) AS own
        FROM walk w JOIN c ON c.tenant_id = w.tenant_id AND c.n = w.n + 1) judged) moved),
  entry AS (SELECT tenant_id, n, i, CASE WHEN kind = 'ADJUSTMENT' THEN command_id ELSE concat(lower(kind), '#', entries[i].s) END AS entry_id, kind AS entry_type, entries[i].n AS token_delta, accepted,
    CAST(before + list_sum(list_transform(entries[:i], lambda x: x.n)) AS BIGINT) AS balance FROM walk, unnest(range(1, len(entries) + 1)) r(i))"""


@query("streamed_token_ledger", f"SELECT * FROM ({_WALK} SELECT tenant_id, entry_id, entry_type, token_delta, accepted, balance FROM entry) q")
def streamed_token_ledger(t):
    rows = _finished(t, state.token_ledger_stream(_commands(_stream(t, "events"))))
    return rows.select("tenant_id", "entry_id", "entry_type", "token_delta", "accepted", "balance")


@query(
    "streamed_balances_hold",
    f"SELECT * FROM ({_WALK} SELECT tenant_id, min(balance) >= 0 AS never_negative, CAST(arg_max(balance, n * 10 + i) AS BIGINT) AS balance FROM entry GROUP BY tenant_id) q",
)
def streamed_balances_hold(t):
    """The deltas of a tenant add up to the balance that its last command left."""
    rows = _finished(t, state.token_ledger_stream(_commands(_stream(t, "events"))))
    return rows.groupBy("tenant_id").agg((F.min("balance") >= 0).alias("never_negative"), F.sum("token_delta").alias("balance"))


@query(
    "snapshot_rows",
    with_tables(("statements_flat",), "SELECT tenant_id, statement_id, contact_id FROM statements_flat"),
)
def snapshot_rows(t):
    folder = _scratch(t)
    tenants = t.derive("statements_flat").select("tenant_id")
    snapshots.write_snapshot({"statements": t.derive("statements_flat")}, tenants, folder)
    return snapshots.read_snapshot(t.spark, folder, "statements").select("tenant_id", "statement_id", "contact_id")


@query("streamed_unique_events", "SELECT event_id, CAST(user_id AS BIGINT) AS user_id, epoch_us(ts) AS received_at FROM events")
def streamed_unique_events(t):
    """All events, then a third of them again, then a fifth of them a year later."""
    folder = _scratch(t)
    events = t.base("events").select("event_id", F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("received_at"))
    again, later = events.where("event_id % 3 = 0"), events.where("event_id % 5 = 0").withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 365 DAYS"))
    for n, part in enumerate((events.unionByName(again), again, later)):
        part.coalesce(1).write.parquet(f"{folder}/in/part={n}")
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")
    flows.stream_unique_events(stream, f"{folder}/unique", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/unique/events").select("event_id", "user_id", F.unix_micros("received_at").alias("received_at"))


@query(
    "streamed_error_alerts",
    """SELECT CAST(epoch(m) AS BIGINT) AS window_start, count(*) AS errors FROM (SELECT date_trunc('minute', ts) AS m FROM events WHERE event_type = 'error') q
       WHERE m + INTERVAL 1 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE FROM events WHERE event_type = 'error') GROUP BY m""",
)
def streamed_error_alerts(t):
    logs = _stream(t, "events").select(F.upper("event_type").alias("level"), F.col("ts").cast("timestamp").alias("ts"))
    return _finished(t, flows.error_alert_stream(logs)).select(F.unix_seconds("window_start").alias("window_start"), "errors")


@query(
    "streamed_silent_syncs",
    """SELECT tenant_id, heartbeat_ms FROM (SELECT concat('T', CAST(user_id AS VARCHAR)) AS tenant_id, epoch_us(ts) // 1000 AS heartbeat_ms, bool_or(event_type <> 'signup') AS running,
         lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS following FROM events GROUP BY user_id, epoch_us(ts) // 1000) q
       WHERE running AND (following - heartbeat_ms > 7200000 OR following IS NULL AND heartbeat_ms + 7200000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events))""",
)
def streamed_silent_syncs(t):
    """Events as heartbeats; a tenant is silent after two hours without one."""
    beats = _stream(t, "events").select(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("tenant_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "signup").alias("running"))
    return _finished(t, state.silent_sync_stream(beats, 7_200_000))


@query(
    "streamed_progress",
    "SELECT user_id AS tenant_id, event_type AS resource, arg_max(CAST(floor(value) AS BIGINT), ts) AS records_fetched FROM events GROUP BY user_id, event_type",
)
def streamed_progress(t):
    events = _stream(t, "events").select(
        F.col("user_id").alias("tenant_id"), F.col("event_type").alias("resource"), F.floor("value").alias("records_fetched"), F.col("ts").alias("updated_at"), "event_id"
    )
    return _finished(t, flows.latest_state_stream(events, ["tenant_id", "resource"], ["records_fetched"], ["updated_at", "event_id"]), "update")


@query(
    "streamed_flags",
    with_tables(("items_flat",), f"SELECT k, concat_ws(',', i1, i2) AS issues FROM ({FLAGGED}) f"),
)
def streamed_flags(t):
    items = _derived_stream(t, "orders", "items_flat")
    return _finished(t, flows.flag_stream(items)).select("k", F.array_join("issues", ",").alias("issues"))


@query(
    "streamed_ledger",
    with_tables(
        ("ledger_docs",),
        f"SELECT contact_id AS doc_id, max(load_seq) AS load_seq, {money_sql('arg_max(total, load_seq)')} AS total FROM ledger_docs GROUP BY tenant_id, contact_id",
    ),
)
def streamed_ledger(t):
    folder = _scratch(t)
    deltas = _derived_stream(t, "orders", "ledger_docs").withColumn("doc_id", F.col("contact_id"))
    flows.stream_upsert_ledger(deltas, f"{folder}/ledger", f"{folder}/state").awaitTermination()
    current = flows.read_current_ledger(t.spark, f"{folder}/ledger", "doc_id")
    return current.select("doc_id", "load_seq", money("total").alias("total"))


@query(
    "streamed_bundles",
    with_tables(
        ("ledger_docs", "payments"),
        """SELECT CASE WHEN load_seq % 5 = 0 THEN contact_id || 'm' ELSE contact_id END AS contact_id, doc_kind AS kind, doc_id AS record_id FROM ledger_docs WHERE load_seq % 7 <> 0
           UNION ALL SELECT contact_id, 'payment', payment_id FROM payments""",
    ),
)
def streamed_bundles(t):
    """The ledger in three batches: all of it, then some documents move to other contacts, then some leave theirs."""
    folder, docs, paid = _scratch(t), t.derive("ledger_docs"), t.derive("payments")
    parts = [docs, docs.where("load_seq % 5 = 0").withColumn("contact_id", F.concat("contact_id", F.lit("m"))), docs.where("load_seq % 7 = 0").withColumn("contact_id", F.lit(None).cast("string"))]
    for n, part in enumerate(parts):
        records = bundles.ledger_records(part, paid if n == 0 else paid.limit(0))
        # All files that a part has come to are one batch of the stream, which goes on from its checkpoint.
        records.write.parquet(f"{folder}/in/part={n}")
        stream = t.spark.readStream.schema(records.schema).parquet(f"{folder}/in").drop("part")
        bundles.stream_contact_bundles(stream, f"{folder}/bundles", f"{folder}/state").awaitTermination()
    found = bundles.read_bundles(t.spark, f"{folder}/bundles")
    kept = found.select("contact_id", F.explode(F.concat("invoices", "credit_notes")).alias("d")).select("contact_id", F.col("d.doc_kind").alias("kind"), F.col("d.doc_id").alias("record_id"))
    return kept.unionByName(found.select("contact_id", F.explode("payments").alias("p")).select("contact_id", F.lit("payment").alias("kind"), F.col("p.payment_id").alias("record_id")))


def _files(rows: DataFrame) -> int:
    """Write files (path, content) in tasks; how many there are."""

    def write(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                byte_ranges.write_bytes(path, content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]


def _files_of_records(rows: DataFrame) -> int:
    """Write files of rows (path, listed, load_seq, doc_id, text), each a list or a mapping, piece by piece in tasks; how many there are."""

    def write(batches):
        records = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        n = 0
        for (path, listed), own in itertools.groupby(records, lambda r: r[:2]):
            begin, between, end = (b"[\n", b",\n", b"\n]") if listed else (b"{", b", ", b"}")
            with byte_ranges.written(path) as out:
                out.write(begin)
                for i, (_, _, text) in enumerate(r for r in own if r[2] is not None):
                    out.write(between + text if i else text)
                out.write(end)
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    dealt = rows.repartition("path").sortWithinPartitions("path", "load_seq", "doc_id", "text")
    return dealt.select("path", "listed", F.col("text").cast("binary").alias("text")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]


@query(
    "ledger_file_records",
    with_tables(
        ("ledger_docs",),
        """SELECT tenant_id, doc_id, number, reference, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY load_seq) - 1 AS BIGINT) AS load_seq FROM ledger_docs""",
    ),
)
def ledger_file_records(t):
    """Every tenant's documents in a JSON file, a list or a mapping, read back in blocks of 4 KB."""
    folder = _scratch(t)
    record = F.to_json(F.struct("doc_id", "number", F.concat(F.lit('"{'), "reference").alias("note"), F.struct("reference").alias("more")))
    listed = F.coalesce(F.substring("tenant_id", 2, 5).cast("int") % 2 == 0, F.lit(False))
    text = F.when(listed, record).otherwise(F.concat(F.lit('"'), "doc_id", F.lit('": '), record))
    path = F.concat(F.lit(f"{folder}/"), "tenant_id", F.lit("/data/invoices.json"))
    _files_of_records(t.derive("ledger_docs").select(path.alias("path"), listed.alias("listed"), "load_seq", "doc_id", text.alias("text")))
    back = ledger_files.read_ledger(t.spark, folder, "invoices", "doc_id string, number string, note string", block_bytes=4096)
    return back.select("tenant_id", "doc_id", "number", F.substring("note", 3, 100).alias("reference"), "load_seq")


@query(
    "landed_folder",
    """SELECT concat('f', page_id, CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.pdf' END) AS filename, CAST(octet_length(encode(coalesce(html, ''))) + CASE WHEN page_id % 5 = 0 THEN 0 ELSE 9 END + CASE page_id % 3 WHEN 1 THEN 27 WHEN 2 THEN 10 ELSE 0 END AS BIGINT) AS length,
       CASE WHEN page_id % 7 = 0 THEN 'suffix' WHEN page_id % 5 = 0 AND NOT starts_with(coalesce(html, ''), '%PDF-') THEN 'content' END AS reject_reason, CASE page_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 12 END AS page_count FROM pages""",
)
def landed_folder(t):
    """Every page as a file in a landing folder, of which the heads are read, then the contents in pieces."""
    folder = _scratch(t)
    start = F.when(F.col("page_id") % 5 == 0, "").otherwise("%PDF-1.4 ")
    end = F.when(F.col("page_id") % 3 == 1, " /Type /Page /Type /Page \n\n").when(F.col("page_id") % 3 == 2, " /Count 12").otherwise("")
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 7 == 0, ".txt").otherwise(".pdf"))
    content = F.concat(start, F.coalesce("html", F.lit("")), end)
    _files(t.base("pages").select(F.concat(F.lit(f"{folder}/"), (F.col("page_id") % 16).cast("string"), F.lit("/"), name).alias("path"), content.alias("content")))
    files = pdf_landing.count_pdf_pages(pdf_landing.check_pdfs(pdf_landing.scan_pdf_heads(t.spark, folder)), piece=4096)
    return files.select("filename", "length", "reject_reason", "page_count")


@query(
    "ledger_by_contact",
    with_tables(
        ("ledger_docs", "contacts"),
        "SELECT contact_id, count(CASE WHEN doc_kind = 'invoice' THEN 1 END) AS invoices, count(CASE WHEN doc_kind <> 'invoice' THEN 1 END) AS credit_notes FROM ledger_docs WHERE contact_id IN (SELECT contact_id FROM contacts WHERE tenant_id IN ('T3', 'T4')) GROUP BY contact_id",
    ),
)
def ledger_by_contact(t):
    folder = _scratch(t)
    ledger_files.write_ledger_by_contact(t.derive("ledger_docs"), t.derive("payments"), folder)
    wanted = t.derive("contacts").where(F.col("tenant_id").isin("T3", "T4"))
    bundles = ledger_files.read_ledger_for_contacts(t.spark, folder, wanted)
    return bundles.groupBy("contact_id").agg(*[F.sum(F.size(k)).cast("bigint").alias(k) for k in ("invoices", "credit_notes")])


@query(
    "statement_documents",
    with_tables(("items_flat",), "SELECT statement_id, k, date_text AS date, number FROM items_flat"),
)
def statement_documents(t):
    from checks.queries_shaping import assigned_item_ids
    from tallyweave.sources import statement_files

    folder = _scratch(t)
    numbered = assigned_item_ids(t).select("statement_id", "k", "item_seq")
    items = t.items().drop("item_seq").join(numbered, ["statement_id", "k"])
    statement_files.write_statement_json(t.statements(), items, folder, per_document=5)
    _, read = statement_files.read_statements(t.spark, folder)
    back = read.join(numbered, ["statement_id", "item_seq"])
    return back.select("statement_id", "k", "date", "number")


