"""Files in and out."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import comparison
from tallyweave.sources import export, json_ranges, ledger_files, pdf_landing, snapshots, statement_files


def test_ledger_files_hold_lists_or_mappings(spark, tmp_path):
    for tenant, content in (("t1", [{"invoice_id": "a", "total": "1"}, {"invoice_id": "b", "total": "2"}]), ("t2", {"x": {"invoice_id": "c", "total": "3"}})):
        path = tmp_path / tenant / "data"
        path.mkdir(parents=True)
        (path / "invoices.json").write_text(json.dumps(content, indent=4))
    out = ledger_files.read_ledger(spark, str(tmp_path), "invoices", "invoice_id string, total string").collect()
    assert sorted((r.tenant_id, r.invoice_id, r.total, r.load_seq) for r in out) == [("t1", "a", "1", 0), ("t1", "b", "2", 1), ("t2", "c", "3", 0)]


def test_bundles_come_back_by_contact(spark, tmp_path):
    docs = spark.createDataFrame([("T", "a", "invoice", "C1"), ("T", "b", "credit_note", "C1"), ("T", "c", "invoice", "C2"), ("T", "d", "invoice", None)], "tenant_id string, doc_id string, doc_kind string, contact_id string")
    payments = spark.createDataFrame([("T", "p", "C1")], "tenant_id string, payment_id string, contact_id string")
    ledger_files.write_ledger_by_contact(docs, payments, str(tmp_path / "out"))
    wanted = spark.createDataFrame([("T", "C1"), ("T", None)], "tenant_id string, contact_id string")
    found = ledger_files.read_ledger_for_contacts(spark, str(tmp_path / "out"), wanted)
    assert [(r.contact_id, len(r.invoices), len(r.credit_notes), len(r.payments)) for r in found.collect()] == [("C1", 1, 1, 1)]
    assert [r.doc_id for r in ledger_files.unbundle(found, "credit_notes").collect()] == ["b"]


def test_statement_documents_round_trip(spark, tmp_path):
    statements = spark.createDataFrame([("T", "S", "DD/MM/YYYY", {"Date": "date"})], "tenant_id string, statement_id string, date_format string, header_mapping map<string,string>")
    items = spark.range(1, 8).select(F.lit("T").alias("tenant_id"), F.lit("S").alias("statement_id"), F.col("id").alias("item_seq"), F.concat(F.lit("n"), "id").alias("number"), F.create_map(F.lit("h"), F.col("id").cast("string")).alias("raw"))
    statement_files.write_statement_json(statements, items, str(tmp_path / "out"), per_document=3)
    back, rows = statement_files.read_statements(spark, str(tmp_path / "out"))
    assert back.count() == 1 and back.first().header_mapping == {"Date": "date"}
    assert [(r.item_seq, r.number, r.raw["h"]) for r in rows.orderBy("item_seq").collect()] == [(i, f"n{i}", str(i)) for i in range(1, 8)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        statement_files.read_statements(spark, str(tmp_path / "missing"))


def test_export_quotes_cells(spark, tmp_path):
    rows = spark.createDataFrame(
        [("T", "S", 1, "S#1", "invoice", True, [("Doc, no", "number", 'A"1', "A1", True)], ("d",))],
        """tenant_id string, statement_id string, item_seq int, statement_item_id string, item_type string, is_completed boolean,
        comparisons array<struct<header:string,canonical_field:string,statement_value:string,ledger_value:string,matches:boolean>>, match struct<doc_id:string>""",
    )
    lines = {r.item_seq: r.line for r in comparison.export_lines(rows).collect()}
    assert lines == {0: ["Type", "Statement Doc, no", "Ledger Doc, no", "Ledger Link", "Status"], 1: ["INV", 'A"1', "A1", "Link", "Completed"]}
    export.export_reconciliation(rows, str(tmp_path / "out"))
    out = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out")).orderBy("item_seq").collect()
    assert [r.value for r in out] == ['Type,"Statement Doc, no","Ledger Doc, no",Ledger Link,Status', 'INV,"A""1",A1,Link,Completed']


def test_pdf_landing(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4 /Type /Page /Type/Pages /Type /Page\n\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Count 3 /Count  12")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "d.pdf").write_bytes(b"PK..")
    (tmp_path / "e.txt").write_bytes(b"%PDF-")
    files = pdf_landing.estimate_pdf_pages(pdf_landing.check_pdfs(pdf_landing.scan_pdf_landing(spark, str(tmp_path))))
    out = {r.filename: (r.reject_reason, r.page_count) for r in files.collect()}
    assert out == {"a.PDF": (None, 2), "b.pdf": (None, 12), "c.pdf": (None, None), "d.pdf": ("content", None), "e.txt": ("suffix", None)}


def test_landing_is_read_in_pieces(spark, tmp_path):
    rng = random.Random(2)
    for n in range(40):
        parts = [rng.choice([b"/Type /Page ", b"/Type\n/Pages ", b"/Type/Page\n", b"/Count  7 ", b"/Count 31 ", b"x" * rng.randint(0, 60), b"/Count 99999999999 "]) for _ in range(rng.randint(0, 12))]
        (tmp_path / f"{n}.pdf").write_bytes(rng.choice([b"%PDF-1.4 ", b"%PDF-1.4 ", b"no"]) + b"".join(parts))
    whole = pdf_landing.estimate_pdf_pages(pdf_landing.check_pdfs(pdf_landing.scan_pdf_landing(spark, str(tmp_path))))
    want = [(r.filename, r.length, r.reject_reason, r.page_count, r.file_error) for r in whole.collect()]
    heads = pdf_landing.check_pdfs(pdf_landing.scan_pdf_heads(spark, str(tmp_path)))
    for piece in (64, 1 << 20):
        out = pdf_landing.count_pdf_pages(heads.drop("content"), piece).collect()
        assert sorted(((r.filename, r.length, r.reject_reason, r.page_count, r.file_error) for r in out), key=str) == sorted(want, key=str)


def test_snapshot_and_restore(spark, tmp_path):
    headers = spark.createDataFrame([("T", "S1", "C", "Name", None, "statement"), ("T", "S2", " ", "Name", None, None), ("U", "S3", "C", "Name", None, None)], "tenant_id string, statement_id string, contact_id string, contact_name string, uploaded_at timestamp, record_type string")
    wanted = spark.createDataFrame([("T",)], "tenant_id string")
    snapshots.write_snapshot({"headers": headers}, wanted, str(tmp_path / "snap"))
    back = snapshots.read_snapshot(spark, str(tmp_path / "snap"), "headers")
    files = spark.createDataFrame([("T", "S1"), ("T", "S2")], "tenant_id string, statement_id string")
    plan = snapshots.restore_plan(snapshots.snapshot_manifest(back, wanted), files, "run")
    out = {r.old_statement_id: (r.restored, r.skip_reason) for r in plan.collect()}
    assert out == {"S1": (True, None), "S2": (False, "missing-file-or-contact")}
    assert snapshots.restored_headers(plan, "2024-01-01").count() == 1


NASTY = ['"', "\\", "\\\\", "{", "}", "[", "]", ",", "é", "日本", " ", "\n", "a", '\\"', "}{"]


def nasty_record(rng, depth=0):
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6)))
    out = {"id": text(), "n": rng.randint(0, 9)}
    if depth < 2 and rng.random() < 0.4:
        out[text()] = [nasty_record(rng, depth + 1) for _ in range(rng.randint(0, 2))]
    if depth < 2 and rng.random() < 0.3:
        out["in"] = nasty_record(rng, depth + 1)
    return out


def test_json_files_are_cut_at_record_borders(spark, tmp_path):
    rng, want = random.Random(6), {}
    for n in range(14):
        records = [nasty_record(rng) for _ in range(rng.randint(0, 12))]
        value = records if n % 2 else {f"k{i}" + rng.choice(NASTY): r for i, r in enumerate(records)}
        (tmp_path / f"f{n}.json").write_text(json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), encoding="utf-8")
        want |= {(f"f{n}", i): r for i, r in enumerate(records)}
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "mixed.json").write_text(' [1, null, {"id": "x"}, "a{", [{"id": "no"}], {"id": "y"}] ')
    want |= {("mixed", 0): {"id": "x"}, ("mixed", 1): {"id": "y"}}
    for size in (1, 2, 7, 64, 1 << 20):
        rows = json_ranges.record_texts(spark, str(tmp_path / "*.json"), size).collect()
        assert {(r.path.rsplit("/", 1)[-1][:-5], r.place): json.loads(r.text) for r in rows} == want and len(rows) == len(want)
    (tmp_path / "broken.json").write_text('[{"id": 1')
    with pytest.raises(Exception, match="ends within a record"):
        json_ranges.record_texts(spark, str(tmp_path / "broken.json"), 4).collect()


def test_states_of_blocks():
    rng = random.Random(7)
    for _ in range(300):
        text = json.dumps([nasty_record(rng) for _ in range(3)]).encode()
        data = np.frombuffer(text, np.uint8)
        place, depth, ends = json_ranges.structure(data, json_ranges.OUTSIDE)
        cut = rng.randint(0, len(data))
        a, b = json_ranges.structure(data[:cut], json_ranges.OUTSIDE), None
        b = json_ranges.structure(data[cut:], a[2])
        assert ends == b[2] == json_ranges.OUTSIDE and np.r_[a[0], b[0] + cut].tolist() == place.tolist()
        assert np.r_[a[1], b[1] + (a[1][-1] if len(a[1]) else 0)].tolist() == depth.tolist()


def test_block_starts_are_found_as_scans_pass_by(spark, tmp_path):
    """F3 of round 4: a file's scans were one group in memory, and its lines one string before it was written."""
    rng = random.Random(11)
    want = {}
    for name in ("a", "b", "c"):
        records = [{"id": i, "note": "".join(rng.choice(['"', "\\", "{", "}", "[", "x", "é"]) for _ in range(rng.randint(0, 9))), "more": [{"x": []}]} for i in range(rng.randint(1, 30))]
        content = records if name != "b" else {f"k{r['id']}": r for r in records}
        (tmp_path / f"{name}.json").write_text(json.dumps(content, indent=rng.choice([None, 2]), ensure_ascii=False))
        want |= {(name, i): r for i, r in enumerate(records)}
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "4")  # what a block begins with is carried from batch to batch
    try:
        texts = json_ranges.record_texts(spark, f"{tmp_path}/*.json", 23)
        assert "FlatMapGroups" not in texts._jdf.queryExecution().optimizedPlan().toString()
        rows = texts.collect()
    finally:
        spark.conf.set(setting, usual)
    assert len(rows) == len(want) and {(r.path[-6], r.place): json.loads(r.text) for r in rows} == want


def test_files_of_records_are_written_piece_by_piece(spark, tmp_path):
    from checks.queries_streams import _files_of_records

    lines = [(p, p == "l", seq, doc, None if text is None else f'{{"{text}": 1}}' if p == "l" else f'"{doc}": {{"{text}": 1}}') for p in ("l", "m") for seq, doc, text in ((2, "b", "y"), (1, "c", "x"), (None, "a", "w"), (2, "a", "z"), (2, "b", "y"), (3, None, None if p == "m" else "v"))]
    rows = spark.createDataFrame([(f"{tmp_path}/{p}/data/f.json", *rest) for p, *rest in lines] + [(f"{tmp_path}/n/data/f.json", False, 1, None, None)], "path string, listed boolean, load_seq bigint, doc_id string, text string")
    assert _files_of_records(rows) == 3
    read = {p: (tmp_path / p / "data" / "f.json").read_text() for p in ("l", "m", "n")}
    assert read["l"] == "[\n" + ",\n".join(f'{{"{x}": 1}}' for x in "wxzyyv") + "\n]" and read["n"] == "{}"
    assert read["m"] == "{" + ", ".join(f'"{doc}": {{"{x}": 1}}' for doc, x in zip("acabb", "wxzyy")) + "}"
    assert not list(tmp_path.glob("*/data/*.part"))
