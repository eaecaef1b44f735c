"""Matching against a brute-force reading of the rules."""

import random

from pyspark.sql import functions as F

from tallyweave.operators import matching

PAYMENT = ("payment", "paid", "remittance", "receipt")


def norm(text):
    return "".join(c for c in text.upper() if c.isalnum())


def brute_force(rows, docs):
    """Matches of one statement: {key: (doc id, type)}."""
    last = {}
    for seq, key in rows:
        if key:
            last[key] = seq
    found, used = {}, set()
    for doc_id, number, _ in docs:
        if number in last and number not in found:
            found[number] = (doc_id, "exact")
            used.add(number)
    # Keys left over are taken from the rows, repeats included.
    open_keys = [key for _, key in rows if key and key not in found]
    for key in open_keys:
        if any(word in key.lower() for word in PAYMENT):
            continue
        best = None
        for doc_id, number, _ in docs:
            a, b = norm(key), norm(number)
            if number in used or not a or not b or not (a in b or b in a):
                continue
            if best is None or len(b) > best[0]:
                best = (len(b), doc_id, number)
        if best:
            found[key] = (best[1], "exact" if best[2] == key else "substring")
            used.add(best[2])
    return found


def frames(spark, statements, contact_docs):
    items = [("T", s, contact, seq, key) for (s, contact), rows in statements.items() for seq, key in rows]
    docs = [
        ("T", contact, doc_id, number, kind, seq)
        for contact, listed in contact_docs.items()
        for seq, (doc_id, number, kind) in enumerate(listed)
    ]
    item_df = spark.createDataFrame(items, "tenant_id string, statement_id string, contact_id string, item_seq bigint, row_key string")
    doc_df = spark.createDataFrame(docs, "tenant_id string, contact_id string, doc_id string, number string, doc_kind string, load_seq bigint")
    doc_df = doc_df.withColumns({"type": F.lit("ACCPAY"), "date": F.current_date(), "due_date": F.current_date(), "reference": F.lit(""), "total": F.lit(1).cast("decimal(20,4)")})
    ordered = matching.matchable_docs(doc_df.where("doc_kind = 'invoice'"), doc_df.where("doc_kind = 'credit_note'"))
    return item_df, ordered


def random_case(seed):
    rng = random.Random(seed)
    contact_docs, statements = {}, {}
    for c in range(4):
        numbers = [f"{rng.choice(['INV', 'A', 'CN'])}-{rng.randint(1, 120)}" for _ in range(rng.randint(3, 25))]
        listed = [(f"c{c}d{i}", n, rng.choice(["invoice", "invoice", "credit_note"])) for i, n in enumerate(numbers)]
        # Invoices come before credit notes in the list.
        contact_docs[f"C{c}"] = sorted(listed, key=lambda d: d[2] == "credit_note")
        for s in range(3):
            keys = [
                rng.choice([rng.choice(numbers), rng.choice(numbers).replace("-", " "), f"ref {rng.choice(numbers)}", "INV", "1", str(rng.randint(1, 20)), "", "Payment 1", "zzz"])
                for _ in range(rng.randint(5, 30))
            ]
            statements[(f"S{c}{s}", f"C{c}")] = list(enumerate(keys, start=1))
    return statements, contact_docs


def as_dict(df):
    return {(r.statement_id, r.row_key): (r.doc_id, r.match_type) for r in df.collect()}


def expected(statements, contact_docs):
    return {(s, key): m for (s, contact), rows in statements.items() for key, m in brute_force(rows, contact_docs[contact]).items()}


def test_named_vectors(spark):
    statements = {("S", "C"): [(1, "INV-001"), (2, "Payment received"), (3, "INV-999")], ("R", "C"): [(1, "Invoice # INV001")]}
    items, docs = frames(spark, statements, {"C": [("d1", "INV-001", "invoice")]})
    assert as_dict(matching.match_statements(items, docs)) == {("S", "INV-001"): ("d1", "exact"), ("R", "Invoice # INV001"): ("d1", "substring")}


def test_matches_equal_brute_force(spark):
    for seed in (1, 2):
        statements, contact_docs = random_case(seed)
        items, docs = frames(spark, statements, contact_docs)
        want = expected(statements, contact_docs)
        assert as_dict(matching.match_statements(items, docs)) == want


def test_many_copies_of_one_key_take_documents_in_order(spark):
    rows = [(i, "INV") for i in range(1, 31)] + [(31, "V-7"), (32, "INV-3")]
    docs = [(f"d{i}", f"INV-{i}", "invoice") for i in range(1, 26)]
    items, ordered = frames(spark, {("S", "C"): rows}, {"C": docs})
    want = expected({("S", "C"): rows}, {"C": docs})
    assert as_dict(matching.match_statements(items, ordered)) == want


def test_a_document_is_used_once_per_statement(spark):
    statements, contact_docs = random_case(3)
    items, docs = frames(spark, statements, contact_docs)
    # The last row of a key names its document, so distinct keys have distinct documents.
    pairs = [(s, doc) for (s, _), (doc, _) in as_dict(matching.match_statements(items, docs)).items()]
    assert len(pairs) == len(set(pairs))


def test_contained_keys_are_joined_on_pieces(spark):
    short = spark.createDataFrame([("T", "C", k) for k in ("1", "12", "ABC", "x")], "tenant_id string, contact_id string, short_key string")
    long = spark.createDataFrame([("T", "C", k) for k in ("A12", "ABC", "11")], "tenant_id string, contact_id string, long_key string")
    got = {(r.short_key, r.long_key) for r in matching.contained_keys(short, long).collect()}
    assert got == {("1", "A12"), ("12", "A12"), ("ABC", "ABC"), ("1", "11")}


def crowded_case(seed, copies):
    """Statements whose short ids want the same documents over and over."""
    rng = random.Random(seed)
    contact_docs = {"C": [(f"d{i}", f"{rng.choice(['A', 'B', ''])}{rng.randint(1, 400)}", rng.choice(["invoice", "invoice", "credit_note"])) for i in range(150)]}
    contact_docs["C"].sort(key=lambda d: d[2] == "credit_note")
    keys = ["1", "2", "12", "A", "B1", "21", "3", "A 1", "b-2", "11"]
    statements = {(f"S{s}", "C"): list(enumerate([rng.choice(keys) + " " * rng.randint(0, 2) for _ in range(copies)], start=1)) for s in range(4)}
    return {k: [(i, key.strip()) for i, key in rows] for k, rows in statements.items()}, contact_docs


def test_blocks_give_what_taking_turns_gives(spark, monkeypatch):
    for seed, limit in ((5, 4), (6, 400)):  # blocks of two rows and more
        monkeypatch.setattr(matching, "ENTRIES_AT_ONCE", limit)
        statements, contact_docs = crowded_case(seed, 15 * seed)
        items, docs = frames(spark, statements, contact_docs)
        assert as_dict(matching.match_statements(items, docs)) == expected(statements, contact_docs)


def test_groups_stay_small_whatever_the_statement(spark, monkeypatch):
    monkeypatch.setattr(matching, "ENTRIES_AT_ONCE", 1 << 8)
    rng = random.Random(9)
    names = ["tenant_id", "statement_id", "row_id", "matched_number", "place"]
    hot = [("T", "S", i, f"n{d}", d) for i in ("1", "2") for d in range(1, 301)]
    many = [("T", "R", f"i{i}", f"n{rng.randint(1, 400)}", 1) for i in range(700)]
    marks = matching._marked_ids(spark.createDataFrame(hot + many, names)).collect()
    rows = {r.statement_id: r.block_rows for r in marks if r.kind == matching.BY_BLOCKS}
    assert rows["S"] == 128 and rows["R"] == 256  # two lists of 128 entries, 256 of one
    assert {r.length for r in marks if r.statement_id == "S"} == {300}


def test_statements_are_settled_many_to_a_batch(spark):
    """F1 of round 4: each statement was a group of its own for pandas, at 8 ms apiece, and each number was cut in all its pieces."""
    statements, contact_docs = random_case(4)
    items, docs = frames(spark, statements, contact_docs)
    exact = matching.exact_matches(items, docs)
    rows = matching.open_rows(items, exact)
    narrow = matching.id_candidates(rows, docs, exact, ())
    assert "Generate" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    asked = []
    real = matching._settled
    matching._settled = lambda *a: asked.append(real(*a)) or asked[-1]
    try:
        resolved = matching.resolve_matches(rows, narrow, docs)
    finally:
        matching._settled = real
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and "MapInArrow" in plan and "CoGroups" not in plan
    as_before = matching.resolve_matches(rows, matching.id_candidates(rows, docs, exact))
    assert resolved.columns == as_before.columns and sorted(resolved.collect()) == sorted(as_before.collect())
    want = {k: v[0] for k, v in expected(statements, contact_docs).items()}
    assert {(r.statement_id, r.row_key): r.doc_id for r in exact.select("statement_id", "row_key", "doc_id").unionByName(resolved.select("statement_id", "row_key", "doc_id")).collect()} == want


def test_pieces_give_what_comparing_all_gives(spark, monkeypatch):
    """Contacts that ask for many ids are matched piece by piece, the others beside them are not."""
    monkeypatch.setattr(matching, "IDS_COMPARED", 20)
    statements, contact_docs = random_case(5)
    statements |= {("few", "C0"): [], ("one", "D"): [(1, "2"), (2, "INV 4")]}
    contact_docs["D"] = [("dd1", "INV-412", "invoice"), ("dd2", "CN-4", "credit_note")]
    items, docs = frames(spark, statements, contact_docs)
    assert as_dict(matching.match_statements(items, docs)) == expected(statements, contact_docs)


def test_a_large_statement_beside_small_ones(spark, monkeypatch):
    """Only the statement whose lists are too long for one group is settled by marks and blocks."""
    monkeypatch.setattr(matching, "ENTRIES_AT_ONCE", 300)
    statements, contact_docs = crowded_case(7, 60)
    statements = {("S0", "C"): statements[("S0", "C")], ("S1", "C"): [(1, "1"), (2, "1"), (3, "12")]}
    items, docs = frames(spark, statements, contact_docs)
    assert as_dict(matching.match_statements(items, docs)) == expected(statements, contact_docs)
