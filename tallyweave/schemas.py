"""Column layout of the domain tables."""

from __future__ import annotations

# A statement item is identified by the statement and its place in it.
STATEMENT_KEYS = ["tenant_id", "statement_id"]
ITEM_KEYS = ["tenant_id", "statement_id", "item_seq"]
CONTACT_KEYS = ["tenant_id", "contact_id"]

# Fields a statement column can be mapped to, besides 'total'.
STANDARD_FIELDS = ("date", "number", "due_date", "reference")

# What a tenant's sync fetches, in order.
RESOURCES = ("contacts", "invoices", "credit_notes", "payments", "per_contact_index")

STATEMENTS = """
  tenant_id string, statement_id string, contact_id string, date_format string, date_confidence string,
  detected_headers array<string>, column_order array<string>, header_mapping map<string,string>,
  earliest_item_date date, latest_item_date date, input_tokens bigint, output_tokens bigint
"""

STATEMENT_ITEMS = """
  tenant_id string, statement_id string, item_seq int, statement_item_id string, date string, number string,
  due_date string, reference string, total map<string,string>, raw map<string,string>, item_type string,
  flags array<string>,
  flag_details array<struct<field:string,issue:string,keyword:string,value:string>>
"""

CHUNKS = """
  tenant_id string, statement_id string, chunk_index int, start_page int, end_page int,
  detected_headers array<string>, column_order array<string>, rows array<array<string>>, date_format string,
  input_tokens bigint, output_tokens bigint, request_id string
"""

LEDGER_DOCS = """
  tenant_id string, doc_kind string, doc_id string, number string, type string, status string, date date,
  due_date date, reference string, total decimal(20,4), contact_id string, contact_name string,
  amount_credited decimal(20,4), remaining_credit decimal(20,4), updated_at timestamp, load_seq bigint
"""

LEDGER_PAYMENTS = """
  tenant_id string, payment_id string, invoice_id string, reference string, amount decimal(20,4), date date,
  status string, contact_id string, contact_name string
"""

CONTACTS = "tenant_id string, contact_id string, name string, updated_at timestamp, contact_status string"

TOKEN_LEDGER = """
  tenant_id string, entry_id string, entry_type string, token_delta bigint, created_at timestamp, source string,
  statement_id string, settles_entry_id string, price_per_token_pence decimal(10,2)
"""

PROGRESS = "struct<status:string,records_fetched:bigint,record_total:bigint,updated_at:bigint>"

TENANTS = f"""
  tenant_id string, status string, last_sync_ms bigint, reconcile_ready_ms bigint, last_full_load_ms bigint,
  last_heartbeat_ms bigint, erase_at_ms bigint,
  {", ".join(f"{r} {PROGRESS}" for r in RESOURCES)}
"""
