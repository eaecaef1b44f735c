"""Domain tables derived from the given tables, in SQL that Spark and DuckDB both read.

``DERIVED`` maps a table name to (tables it reads, SQL). Map, array and struct columns are put
together on the Spark side from the flat columns (``items``, ``statements``, ``tenants``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.schemas import RESOURCES
from tallyweave.session import configure

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

NOW_MS = 1_700_000_000_000

DATE_FORMATS = ("DD/MM/YYYY", "YYYY-MM-DD", "D MMM YYYY", "MM/DD/YYYY")

LAYOUTS = (
    (("Date", "date"), ("Invoice No.", "number"), ("Description", "reference"), ("Debit", "Debit"),
     ("Credit", "Credit"), ("Balance", "Balance")),
    (("Date", "date"), ("Reference", "reference"), ("Due Date", "due_date"), ("Total", "Total"), ("Balance", "Balance")),
    (("Txn Date", "date"), ("Doc Number", "number"), ("Amount", "Amount")),
)


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def _day_text(day: str, pick: str) -> str:
    d, m, y = f"day({day})", f"month({day})", f"year({day})"
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    return f"""CASE {pick}
      WHEN 0 THEN concat({_digits(d, 2)}, '/', {_digits(m, 2)}, '/', CAST({y} AS STRING))
      WHEN 1 THEN concat(CAST({y} AS STRING), '-', {_digits(m, 2)}, '-', {_digits(d, 2)})
      WHEN 2 THEN concat(CAST({d} AS STRING), ' ', substr('{months}', CAST({m} * 3 - 2 AS INT), 3), ' ', CAST({y} AS STRING))
      ELSE concat({_digits(m, 2)}, '/', {_digits(d, 2)}, '/', CAST({y} AS STRING)) END"""


def _amount_text(cents: str, style: str) -> str:
    whole = f"CAST(floor({cents} / 100) AS BIGINT)"
    thousands = f"CAST(floor({whole} / 1000) AS BIGINT)"
    rest, pence = _digits(f"{whole} % 1000", 3), _digits(f"{cents} % 100", 2)

    def grouped(mark: str) -> str:
        return f"CASE WHEN {whole} >= 1000 THEN concat(CAST({thousands} AS STRING), '{mark}', {rest}) ELSE CAST({whole} AS STRING) END"

    return f"""CASE {style}
      WHEN 0 THEN concat({grouped(",")}, '.', {pence})
      WHEN 1 THEN concat({grouped(".")}, ',', {pence})
      WHEN 2 THEN concat({grouped(" ")}, ',', {pence})
      WHEN 3 THEN concat('R', {grouped(",")}, '.', {pence})
      ELSE concat('(', {grouped(",")}, '.', {pence}, ')') END"""


def _tenant(key: str) -> str:
    return f"concat('T', CAST({key} % 25 AS STRING))"


_KIND = "CASE WHEN o_orderkey % 13 = 0 THEN 'credit_note' ELSE 'invoice' END"
_NUMBER = f"concat(CASE WHEN o_orderkey % 13 = 0 THEN 'CRN-' ELSE 'INV-' END, {_digits('o_orderkey', 10)})"

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "contacts": (
        ("customer",),
        f"""SELECT {_tenant("c_custkey")} AS tenant_id, concat('C', CAST(c_custkey AS STRING)) AS contact_id,
          CASE WHEN c_custkey % 50 = 0 THEN 'Shared Name' ELSE c_name END AS name,
          CASE WHEN c_custkey % 9 = 0 THEN 'archived' WHEN c_custkey % 2 = 0 THEN 'Active' ELSE 'ACTIVE' END AS contact_status,
          c_custkey AS load_seq FROM customer""",
    ),
    "statements_flat": (
        ("customer",),
        f"""SELECT {_tenant("c_custkey")} AS tenant_id, concat('S', CAST(c_custkey AS STRING)) AS statement_id,
          concat('C', CAST(c_custkey AS STRING)) AS contact_id, c_custkey % 3 AS layout,
          CASE c_custkey % 4 WHEN 0 THEN 'DD/MM/YYYY' WHEN 1 THEN 'YYYY-MM-DD' WHEN 2 THEN 'D MMM YYYY' ELSE 'MM/DD/YYYY' END AS date_format,
          1 + c_custkey % 37 AS pages, c_name AS contact_name, c_custkey AS k FROM customer""",
    ),
    "ledger_docs": (
        ("orders",),
        f"""SELECT {_tenant("o_custkey")} AS tenant_id, {_KIND} AS doc_kind, concat('D', CAST(o_orderkey AS STRING)) AS doc_id,
          {_NUMBER} AS number, CASE WHEN o_orderkey % 13 = 0 THEN 'ACCPAYCREDIT' WHEN o_orderkey % 31 = 0 THEN 'ACCREC' ELSE 'ACCPAY' END AS type,
          CASE WHEN o_orderkey % 29 = 0 THEN 'VOIDED' WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'AUTHORISED' ELSE 'DRAFT' END AS status,
          CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 30 AS due_date,
          concat('PO-', CAST(o_orderkey % 97 AS STRING)) AS reference, CAST(o_totalprice AS DECIMAL(20,4)) AS total,
          concat('C', CAST(o_custkey AS STRING)) AS contact_id, o_orderdate AS updated_at, o_orderkey AS load_seq FROM orders""",
    ),
    "payments": (
        ("orders",),
        f"""SELECT {_tenant("o_custkey")} AS tenant_id, concat('P', CAST(o_orderkey AS STRING)) AS payment_id,
          concat('D', CAST(o_orderkey AS STRING)) AS invoice_id, CAST(o_totalprice AS DECIMAL(20,4)) AS amount,
          CAST(o_orderdate AS DATE) + 14 AS date, concat('C', CAST(o_custkey AS STRING)) AS contact_id, o_orderkey AS load_seq
          FROM orders WHERE o_orderstatus = 'F'""",
    ),
    "order_items": (
        ("orders",),
        f"""SELECT o_orderkey AS k, o_custkey AS ck, o_custkey % 3 AS layout, {_tenant("o_custkey")} AS tenant_id,
          concat('S', CAST(o_custkey AS STRING)) AS statement_id, concat('C', CAST(o_custkey AS STRING)) AS contact_id, o_orderkey AS item_seq,
          concat('S', CAST(o_custkey AS STRING), '#item-', CAST(o_orderkey AS STRING)) AS statement_item_id,
          CASE o_custkey % 4 WHEN 0 THEN 'DD/MM/YYYY' WHEN 1 THEN 'YYYY-MM-DD' WHEN 2 THEN 'D MMM YYYY' ELSE 'MM/DD/YYYY' END AS date_format,
          CAST(o_orderdate AS DATE) AS day, {_day_text("CAST(o_orderdate AS DATE)", "o_custkey % 4")} AS date_text,
          {_day_text("(CAST(o_orderdate AS DATE) + 30)", "o_custkey % 4")} AS due_text,
          CASE WHEN o_orderkey % 10 <= 3 THEN {_NUMBER}
               WHEN o_orderkey % 10 = 4 THEN concat('Invoice # INV', {_digits("o_orderkey", 10)})
               WHEN o_orderkey % 10 = 5 THEN concat('inv ', {_digits("o_orderkey", 10)})
               WHEN o_orderkey % 10 = 6 THEN {_digits("o_orderkey", 10)}
               WHEN o_orderkey % 10 = 7 THEN ''
               WHEN o_orderkey % 10 = 8 THEN concat('Payment received ', {_digits("o_orderkey", 10)})
               ELSE concat('X-', {_digits("o_orderkey", 10)}) END AS number_text,
          CASE WHEN o_orderkey % 17 = 0 THEN 'Balance Brought Forward' WHEN o_orderkey % 19 = 0 THEN 'No match - kept for reference'
               WHEN o_orderkey % 10 = 8 THEN 'Payment received - thank you' WHEN o_orderkey % 13 = 0 THEN 'Credit note - returned goods'
               ELSE concat('Sales ', {_digits("o_orderkey % 1000", 3)}) END AS description,
          CASE WHEN o_orderkey % 10 = 8 OR o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_credit,
          CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 100 ELSE 0 END AS cents, o_orderkey % 5 AS style
          FROM orders WHERE o_orderkey % 7 <> 0""",
    ),
    "items_flat": (
        ("order_items",),
        f"""SELECT k, ck, layout, tenant_id, statement_id, contact_id, item_seq, statement_item_id, date_format, day, date_text, due_text,
          number_text, description, is_credit, cents, style, {_amount_text("cents", "style")} AS amount_text,
          CASE WHEN layout = 1 THEN '' ELSE number_text END AS number,
          CASE WHEN layout = 0 THEN description WHEN layout = 1 THEN number_text ELSE '' END AS reference
          FROM order_items""",
    ),
    "amount_texts": (
        ("order_items",),
        f"""SELECT k AS id, CASE WHEN k % 12 < 5 THEN {_amount_text("cents", "k % 12")}
          WHEN k % 12 = 5 THEN concat(CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), '.', {_digits("cents % 100", 2)}, '-')
          WHEN k % 12 = 6 THEN concat('-', CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING), ',', {_digits("cents % 100", 2)})
          WHEN k % 12 = 7 THEN CAST(cents AS STRING) WHEN k % 12 = 8 THEN concat('n/a ', CAST(k % 10 AS STRING))
          WHEN k % 12 = 9 THEN '' WHEN k % 12 = 10 THEN concat('PO-', CAST(k AS STRING)) ELSE '1.5 USD' END AS text FROM order_items""",
    ),
    "item_status": (
        ("order_items",),
        """SELECT tenant_id, statement_item_id, k % 3 = 0 AS completed FROM order_items WHERE k % 4 <> 0""",
    ),
    "headers": (
        ("customer",),
        f"""SELECT {_tenant("c_custkey")} AS tenant_id, concat('S', CAST(c_custkey AS STRING)) AS statement_id,
          CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'statement_item' ELSE 'statement' END AS record_type,
          c_custkey % 4 = 0 AS completed, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS contact_name,
          concat('C', CAST(c_custkey AS STRING)) AS contact_id,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 700 AS INT) END AS earliest_item_date,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 700 + c_custkey % 3 * 20 AS INT) END AS latest_item_date,
          CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(c_custkey % 365 AS INT) AS TIMESTAMP) END AS uploaded_at,
          1 + c_custkey % 37 AS pdf_page_count, concat('reserve#S', CAST(c_custkey AS STRING)) AS reservation_entry_id,
          CASE c_custkey % 5 WHEN 0 THEN 'reserved' WHEN 1 THEN 'consumed' WHEN 2 THEN 'released' WHEN 3 THEN 'Reserved' ELSE NULL END AS reservation_status,
          CASE c_custkey % 8 WHEN 0 THEN 'extracting' WHEN 1 THEN 'complete' ELSE NULL END AS processing_stage,
          CASE WHEN c_custkey % 8 = 0 THEN '3/10' ELSE NULL END AS processing_progress,
          CASE WHEN c_custkey % 8 = 0 THEN 10 ELSE NULL END AS processing_total_sections, c_custkey AS k FROM customer""",
    ),
    "statement_files": (
        ("customer",),
        f"""SELECT {_tenant("c_custkey")} AS tenant_id, concat('S', CAST(c_custkey AS STRING)) AS statement_id FROM customer WHERE c_custkey % 3 <> 0""",
    ),
    "tenants_flat": (
        ("customer",),
        "SELECT concat('U', CAST(c_custkey AS STRING)) AS tenant_id, c_custkey AS k, "
        + "CASE c_custkey % 7 WHEN 0 THEN 'FREE' WHEN 1 THEN 'SYNCING' WHEN 2 THEN 'LOADING' WHEN 3 THEN 'LOAD_INCOMPLETE' "
        "WHEN 4 THEN 'ERASED' WHEN 5 THEN 'SYNCING' ELSE 'FREE' END AS status, "
        f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {NOW_MS} - c_custkey * 1000 END AS last_sync_ms, "
        f"CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE {NOW_MS} - c_custkey * 2000 END AS reconcile_ready_ms, "
        f"CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE {NOW_MS} - c_custkey * 2000 END AS last_full_load_ms, "
        f"CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE {NOW_MS} - c_custkey * 900 END AS last_heartbeat_ms, "
        f"CASE WHEN c_custkey % 9 < 4 THEN NULL ELSE {NOW_MS} + (c_custkey % 11 - 5) * 3600000 END AS erase_at_ms, "
        + ", ".join(
            f"CASE (c_custkey * {i + 3} + {i}) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'failed' WHEN 3 THEN NULL ELSE 'complete' END AS {r}_status, "
            f"CASE WHEN (c_custkey + {i}) % 4 = 0 THEN NULL ELSE c_custkey % 90 + {i} END AS {r}_fetched, "
            f"CASE WHEN (c_custkey + {i}) % 5 = 0 THEN NULL ELSE c_custkey % 70 * 2 END AS {r}_total"
            for i, r in enumerate(RESOURCES)
        )
        + " FROM customer",
    ),
    "token_ledger": (
        ("events",),
        """SELECT concat('T', CAST(user_id AS STRING)) AS tenant_id, concat('E', CAST(event_id AS STRING)) AS entry_id,
          CASE event_type WHEN 'view' THEN 'RESERVE' WHEN 'error' THEN 'RELEASE' WHEN 'click' THEN 'CONSUME' ELSE 'ADJUSTMENT' END AS entry_type,
          CAST(CASE event_type WHEN 'view' THEN -(1 + event_id % 40) WHEN 'error' THEN 1 + event_id % 8 WHEN 'click' THEN 0
               WHEN 'signup' THEN 5 ELSE 1 + event_id % 20 END AS BIGINT) AS token_delta, ts AS created_at,
          CASE event_type WHEN 'view' THEN 'upload-submit' WHEN 'error' THEN 'upload-failure' WHEN 'click' THEN 'upload-submit'
               WHEN 'signup' THEN 'welcome-grant' ELSE 'checkout' END AS source, event_id FROM events""",
    ),
    "uploads": (
        ("customer",),
        f"""SELECT {_tenant("c_custkey")} AS tenant_id, CASE WHEN c_custkey % 14 = 0 THEN '' ELSE concat('f', CAST(c_custkey AS STRING), '.pdf') END AS filename,
          CASE WHEN c_custkey % 6 = 0 THEN '  ' WHEN c_custkey % 8 = 0 THEN concat('Nobody ', CAST(c_custkey AS STRING))
               WHEN c_custkey % 50 = 0 THEN ' Shared Name' ELSE concat(c_name, ' ') END AS contact_name,
          CASE WHEN c_custkey % 40 = 7 THEN 'Unable to determine page count for this PDF.' END AS file_error,
          CASE WHEN c_custkey % 40 = 7 THEN NULL ELSE 1 + c_custkey % 12 END AS page_count, c_custkey AS k FROM customer""",
    ),
    "billing_events": (
        ("events",),
        """SELECT concat('ev', CAST(event_id AS STRING)) AS event_id, concat('T', CAST(user_id AS STRING)) AS tenant_id,
          CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'updated' WHEN 'error' THEN 'deleted' ELSE 'other' END AS event_type,
          CASE event_id % 3 WHEN 0 THEN 'tier_50' WHEN 1 THEN 'tier_200' ELSE 'tier_500' END AS tier_id,
          concat('in', CAST(event_id % 5000 AS STRING)) AS invoice_id,
          CAST(ts AS DATE) AS period_end, ts AS received_at, event_id AS seq FROM events""",
    ),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in seen:
            return
        for needed in DERIVED[name][0]:
            visit(needed)
        seen.append(name)

    for name in names:
        visit(name)
    return seen


def with_tables(names: tuple[str, ...], body: str, extra: dict[str, str] | None = None) -> str:
    """A query whose derived tables are spelled out as common table expressions."""
    parts = [f"{n} AS ({DERIVED[n][1]})" for n in _closure(names)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


class Tables:
    """The given tables of one folder, and the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = configure(spark), folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derive(self, name: str, dealt: bool = False) -> DataFrame:
        """A derived table; ``dealt`` over tasks first where a row costs much, as a file may be one row group and so one task."""
        sources = {n for d in _closure((name,)) for n in DERIVED[d][0] if n in BASE}
        for source in sources:
            rows = self.base(source)
            (rows.repartition(F.xxhash64(*rows.columns)) if dealt else rows).createOrReplaceTempView(source)
        return self.spark.sql(with_tables((name,), f"SELECT * FROM {name}"))

    def docs(self) -> DataFrame:
        docs = self.derive("ledger_docs")
        return docs.withColumn("updated_at", F.col("updated_at").cast("timestamp"))

    def items(self) -> DataFrame:
        """Statement items with their ``raw`` and ``total`` maps, and ``cells`` in column order."""
        flat = self.derive("items_flat", dealt=True)
        value = {
            "date": "date_text",
            "due_date": "due_text",
            "number": "number",
            "reference": "reference",
            "Debit": F.when(F.col("is_credit") == 0, F.col("amount_text")).otherwise(""),
            "Credit": F.when(F.col("is_credit") == 1, F.col("amount_text")).otherwise(""),
            "Balance": "amount_text",
            "Total": "amount_text",
            "Amount": "amount_text",
        }

        def layout_map(columns: list[str]):
            pairs = [x for c in columns for x in (F.lit(c), F.col(value[c]) if isinstance(value[c], str) else value[c])]
            return F.create_map(*pairs)

        raw, total = None, None
        for i, layout in enumerate(LAYOUTS):
            columns = [c for _, c in layout]
            amounts = [c for c in columns if c[0].isupper()]
            here = F.col("layout") == i
            raw = F.when(here, layout_map(columns)) if raw is None else raw.when(here, layout_map(columns))
            total = F.when(here, layout_map(amounts)) if total is None else total.when(here, layout_map(amounts))
        return flat.withColumn("raw", raw).withColumn("total", total).withColumn("date", F.col("date_text")).withColumn(
            "due_date", F.when(F.col("layout") == 1, F.col("due_text")).otherwise("")
        )

    def statements(self) -> DataFrame:
        flat = self.derive("statements_flat")

        def pick(values):
            out = None
            for i, layout in enumerate(LAYOUTS):
                made = F.array(*[F.lit(v) for v in values(layout)])
                out = F.when(F.col("layout") == i, made) if out is None else out.when(F.col("layout") == i, made)
            return out

        fields = pick(lambda la: [c if c[0].islower() else "total" for _, c in la])
        return (
            flat.withColumn("detected_headers", pick(lambda la: [h for h, _ in la]))
            .withColumn("column_order", pick(lambda la: [c for _, c in la]))
            .withColumn("header_mapping", F.map_from_arrays("detected_headers", fields))
        )

    def chunks(self, size: int = 4, overlap: int = 1) -> DataFrame:
        """The items of each statement as page chunks that share their edge rows."""
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("tenant_id", "statement_id").orderBy("item_seq")) - 1
        total = F.count("*").over(Window.partitionBy("tenant_id", "statement_id"))
        step = size - overlap
        numbered = self.items().withColumn("i", place).withColumn("n", total)
        last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
        spread = numbered.withColumn("last", last).withColumn(
            "chunk_index",
            F.explode(
                F.filter(
                    F.sequence(F.lit(0), F.col("last")),
                    lambda c: (F.col("i") >= c * step) & (F.col("i") < c * step + size),
                )
            ),
        )
        line = F.transform(F.map_keys("raw"), lambda k: F.try_element_at("raw", k))
        return spread.groupBy("tenant_id", "statement_id", "chunk_index").agg(
            F.first("date_format").alias("date_format"),
            F.first(F.map_keys("raw")).alias("column_order"),
            F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda r: r["line"]).alias("rows"),
        )

    def tenants(self) -> DataFrame:
        flat = self.derive("tenants_flat")
        out = flat
        for r in RESOURCES:
            progress = F.struct(
                F.col(f"{r}_status").alias("status"),
                F.col(f"{r}_fetched").cast("bigint").alias("records_fetched"),
                F.col(f"{r}_total").cast("bigint").alias("record_total"),
                F.col("last_sync_ms").cast("bigint").alias("updated_at"),
            )
            out = out.withColumn(r, F.when(F.col(f"{r}_status").isNotNull(), progress)).drop(
                f"{r}_status", f"{r}_fetched", f"{r}_total"
            )
        return out

    def token_ledger(self) -> DataFrame:
        return self.derive("token_ledger").withColumn("created_at", F.col("created_at").cast("timestamp"))

    def headers(self) -> DataFrame:
        return self.derive("headers")
