"""Matching statement rows to ledger documents: exact numbers first, then containment.

Rows carry ``row_key`` (see ``shaping.statement_cells``) and ``contact_id``. Documents carry
``doc_ord``, their place in the contact's list (see ``matchable_docs``). A statement is matched
against all documents of its contact, independently of other statements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.arrays import unfold
from tallyweave.functions.text import id_key, is_payment_reference, stripped
from tallyweave.schemas import CONTACT_KEYS, STATEMENT_KEYS
from tallyweave.session import checkpoint_folder, stored

_DOC_FIELDS = ["doc_id", "doc_kind", "type", "date", "due_date", "reference", "total"]

# How row ids are settled, and how many entries of the lists of a statement's rivals a group may hold.
ALONE, AT_ONCE, BY_BLOCKS = "alone", "at once", "by blocks"
ENTRIES_AT_ONCE = 1 << 18
# A contact whose statements ask for no more ids than this has each of its numbers compared with all of them.
IDS_COMPARED = 256
# Rows that have taken a number of ``doc_contact``; a statement that is too large for one group has one row without a number.
_TAKEN = "tenant_id string, statement_id string, contact_id string, item_seq bigint, row_key string, row_id string, doc_contact string, matched_number string"
_TAKEN_ARROW = pa.schema([(x.split(" ")[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in _TAKEN.split(", ")])


def matchable_docs(invoices: DataFrame, credit_notes: DataFrame) -> DataFrame:
    """Invoices, then credit notes, with ``doc_ord`` ordering them in that way."""
    both = invoices.unionByName(credit_notes, allowMissingColumns=True)
    kind = F.when(F.col("doc_kind") == "credit_note", 1).otherwise(0)
    return both.withColumn("doc_ord", F.struct(kind.alias("kind"), F.col("load_seq").cast("bigint").alias("seq")))


def _numbered_docs(docs: DataFrame) -> DataFrame:
    """The first document of each number of a contact."""
    numbered = docs.withColumn("number", stripped("number")).where((F.col("number") != "") & F.col("contact_id").isNotNull())
    return (
        numbered.groupBy(*CONTACT_KEYS, "number")
        .agg(F.min_by(F.struct(*_DOC_FIELDS, "doc_ord"), "doc_ord").alias("doc"))
        .select(*CONTACT_KEYS, "number", "doc.*")
    )


def _keyed_items(items: DataFrame) -> DataFrame:
    """The last row of each row key of a statement."""
    return (
        items.where(F.col("row_key") != "")
        .groupBy(*STATEMENT_KEYS, "contact_id", "row_key")
        .agg(F.max("item_seq").alias("item_seq"))
    )


def exact_matches(items: DataFrame, docs: DataFrame) -> DataFrame:
    """One match per row key that equals a document number of the contact, case-sensitively.

    Of rows that repeat a key the last one is meant, of documents that repeat a number the first.
    Both are found by partial aggregation, so a repeated value does not pile up in one task.
    """
    joined = _keyed_items(items).join(
        _numbered_docs(docs).withColumnRenamed("number", "row_key"), [*CONTACT_KEYS, "row_key"]
    )
    return joined.select(
        *STATEMENT_KEYS,
        "contact_id",
        "row_key",
        "item_seq",
        F.col("row_key").alias("matched_number"),
        *_DOC_FIELDS,
        "doc_ord",
        F.lit("exact").alias("match_type"),
        F.lit(1.0).alias("match_score"),
    )


def unmatched_numbers(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows whose key has no match; repeated keys stay repeated."""
    keyed = items.where(F.col("row_key") != "")
    return keyed.join(matches.select(*STATEMENT_KEYS, "row_key").distinct(), [*STATEMENT_KEYS, "row_key"], "left_anti")


def unused_docs(docs: DataFrame, matches: DataFrame, statements: DataFrame) -> DataFrame:
    """The documents still free for each of the ``statements``: the numbered ones of its contact that its own matches use neither by id nor by number.

    One row per statement and document. Another statement of the contact may have used the document; see
    ``ledger_only_documents`` for those that none has.
    """
    numbered = docs.withColumn("number", stripped("number")).where((F.col("number") != "") & F.col("contact_id").isNotNull())
    scope = statements.where(F.col("contact_id").isNotNull()).select(*STATEMENT_KEYS, "contact_id").distinct()
    offered = scope.join(numbered, CONTACT_KEYS).withColumn("invoice_id", F.when(F.col("doc_kind") != "credit_note", F.col("doc_id")))
    used_ids, used_numbers = _used(matches)
    free = offered.join(used_numbers, [*STATEMENT_KEYS, "number"], "left_anti")
    return free.join(used_ids, [*STATEMENT_KEYS, "invoice_id"], "left_anti").drop("invoice_id")


def _used(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invoice ids and numbers that each statement's matches use. Credit notes carry no invoice id, so they are used by number only."""
    invoices = matches.where((F.col("doc_kind") == "invoice") & F.col("doc_id").isNotNull())
    ids = invoices.select(*STATEMENT_KEYS, F.col("doc_id").alias("invoice_id")).distinct()
    return ids, matches.select(*STATEMENT_KEYS, F.col("matched_number").alias("number")).distinct()


def ledger_only_documents(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Numbered documents that no statement of their contact matched, by id or by number."""
    numbered = docs.withColumn("number", stripped("number")).where(F.col("number") != "")
    by_id = matches.where((F.col("doc_kind") == "invoice") & F.col("doc_id").isNotNull()).select(*CONTACT_KEYS, "doc_id").distinct()
    by_number = matches.select(*CONTACT_KEYS, F.col("matched_number").alias("number")).distinct()
    credit_notes = numbered.where(F.col("doc_kind") == "credit_note")
    bills = numbered.where(F.col("doc_kind") != "credit_note").join(by_id, [*CONTACT_KEYS, "doc_id"], "left_anti")
    return bills.unionByName(credit_notes).join(by_number, [*CONTACT_KEYS, "number"], "left_anti")


def contained_keys(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of distinct keys of a contact where ``short_key`` lies inside ``long_key``.

    Each long key is cut into pieces of the lengths that short keys of its contact really have, and
    the pieces are joined on equality. Work grows with text length and true hits; two keys that
    share only the contact are never paired. A piece is longer than zero and may be the whole key.
    """
    lengths = short.groupBy(*CONTACT_KEYS).agg(F.collect_set(F.length("short_key")).alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("long_key"))
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                fitting,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length("long_key") - n + 1), lambda i: F.substring(F.col("long_key"), i, n)
                ),
            )
        )
    )
    cut = unfold(long.join(lengths, CONTACT_KEYS), [*CONTACT_KEYS, "long_key"], pieces, "short_key").drop("place")
    return cut.join(short, [*CONTACT_KEYS, "short_key"])


def open_rows(items: DataFrame, exact: DataFrame) -> DataFrame:
    """Rows still to be matched by containment, with their normalised ``row_id``.

    Rows that speak of a payment, and those without a letter or digit, are left out.
    """
    return (
        unmatched_numbers(items, exact)
        .where(~is_payment_reference("row_key"))
        .select(*STATEMENT_KEYS, "contact_id", "item_seq", "row_key", id_key("row_key").alias("row_id"))
        .where(F.col("row_id") != "")
    )


def id_candidates(rows: DataFrame, docs: DataFrame, exact: DataFrame, fields: Sequence[str] = _DOC_FIELDS) -> DataFrame:
    """Free documents whose normalised number contains a row id of the statement, or lies inside it.

    A document is free for a statement unless an exact match of that statement used its id or its
    number. There is one pair per statement, row id and document number, however many rows repeat
    the id. ``fields`` are the columns of the document that pairs carry.
    """
    wanted = rows.select(*STATEMENT_KEYS, "contact_id", "row_id").distinct()
    asked = wanted.groupBy(*CONTACT_KEYS).agg(F.count("*").alias("asked"))
    columns = [*CONTACT_KEYS, "number", *dict.fromkeys(["doc_id", "doc_kind", *fields]), "doc_ord"]
    numbered = _numbered_docs(docs).select(*columns).withColumn("number_id", id_key("number")).where(F.col("number_id") != "")
    many = asked.where(F.col("asked") > IDS_COMPARED)
    few = wanted.join(asked.where(F.col("asked") <= IDS_COMPARED), CONTACT_KEYS, "left_semi")
    either = F.col("number_id").contains(F.col("row_id")) | F.col("row_id").contains(F.col("number_id"))
    pairs = numbered.join(few, CONTACT_KEYS).where(either)
    if not many.isEmpty():
        pairs = pairs.unionByName(_pairs_by_pieces(wanted.join(many, CONTACT_KEYS, "left_semi"), numbered))
    used_ids, used_numbers = _used(exact)
    free = pairs.join(used_numbers, [*STATEMENT_KEYS, "number"], "left_anti")
    free = free.withColumn("invoice_id", F.when(F.col("doc_kind") != "credit_note", F.col("doc_id")))
    free = free.join(used_ids, [*STATEMENT_KEYS, "invoice_id"], "left_anti")
    return free.select(
        *STATEMENT_KEYS,
        "contact_id",
        "row_id",
        F.col("number").alias("matched_number"),
        F.length("number_id").alias("id_length"),
        *fields,
        "doc_ord",
    )


def _pairs_by_pieces(wanted: DataFrame, numbered: DataFrame) -> DataFrame:
    """The ids a statement asks for beside the numbers that contain them or lie inside them, found piece by piece."""
    row_ids = wanted.select(*CONTACT_KEYS, "row_id").distinct()
    numbered = numbered.join(row_ids.select(*CONTACT_KEYS).distinct(), CONTACT_KEYS, "left_semi")
    number_ids = numbered.select(*CONTACT_KEYS, "number_id").distinct()
    inside_row = contained_keys(
        number_ids.withColumnRenamed("number_id", "short_key"), row_ids.withColumnRenamed("row_id", "long_key")
    ).select(*CONTACT_KEYS, F.col("long_key").alias("row_id"), F.col("short_key").alias("number_id"))
    around_row = contained_keys(
        row_ids.withColumnRenamed("row_id", "short_key"), number_ids.withColumnRenamed("number_id", "long_key")
    ).select(*CONTACT_KEYS, F.col("short_key").alias("row_id"), F.col("long_key").alias("number_id"))
    # Equal ids are found from both sides.
    id_pairs = inside_row.unionByName(around_row.where(F.col("row_id") != F.col("number_id")))
    return id_pairs.join(numbered, [*CONTACT_KEYS, "number_id"]).join(wanted, [*CONTACT_KEYS, "row_id"])


def substring_candidates(items: DataFrame, docs: DataFrame, exact: DataFrame) -> DataFrame:
    """The candidate documents of every open row, one pair per row and document number."""
    rows = open_rows(items, exact)
    found = id_candidates(rows, docs, exact)
    return rows.join(found.drop("contact_id"), [*STATEMENT_KEYS, "row_id"]).drop("row_id")


def _preference() -> Column:
    """Sort key of a candidate: longest id first, then list order."""
    return F.struct((-F.col("id_length")).alias("length"), F.col("doc_ord"), F.col("matched_number"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The best document of each row by itself, without one row taking it from another."""
    return (
        candidates.groupBy(*STATEMENT_KEYS, "item_seq", "row_key")
        .agg(F.min_by(F.struct("matched_number", "id_length", *_DOC_FIELDS, "doc_ord"), _preference()).alias("best"))
        .select(*STATEMENT_KEYS, "item_seq", "row_key", "best.*")
    )


def resolve_matches(rows: DataFrame, candidates: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Assign documents to rows: rows in statement order, each takes its best document still free.

    ``rows`` come from ``open_rows`` and ``candidates`` from ``id_candidates``; these need no fields of the document where the
    ``docs`` are given as well. Returns one row per
    matched key. Rows that repeat an id share one list of candidates, of which they need as many as
    there are rows. A statement is settled in row order, in one group if its lists are short. Of others, an id that shares no
    document with another of its statement is settled by itself: its k-th row takes its k-th best document. Where ids
    compete, the rivals are settled in one group if their lists are short, else in blocks of rows with as many entries at once.
    """
    checkpoint_folder(candidates.sparkSession)
    if docs is None:
        candidates = stored(candidates)
    pairs = candidates.select(*STATEMENT_KEYS, "contact_id", "row_id", "matched_number", _preference().alias("place"))
    settled = stored(_settled(pairs, rows, ENTRIES_AT_ONCE))
    taken = settled.where(F.col("matched_number").isNotNull())
    large = settled.where(F.col("matched_number").isNull()).select(*STATEMENT_KEYS)
    if not large.isEmpty():
        taken = taken.unionByName(_large(rows.join(large, STATEMENT_KEYS, "left_semi"), pairs.join(large, STATEMENT_KEYS, "left_semi")))
    # A key that occurs in several rows keeps the document of its last row; all rows have used one.
    last = taken.groupBy(*STATEMENT_KEYS, "contact_id", "row_key", "row_id").agg(
        F.max("item_seq").alias("item_seq"), F.max_by(F.struct("doc_contact", "matched_number"), "item_seq").alias("best")
    )
    last = last.select("*", "best.*").drop("best")
    if docs is None:
        details = candidates.select(*STATEMENT_KEYS, "row_id", F.col("contact_id").alias("doc_contact"), "matched_number", *_DOC_FIELDS, "doc_ord")
        last = last.join(details, [*STATEMENT_KEYS, "row_id", "doc_contact", "matched_number"])
    else:
        details = _numbered_docs(docs).withColumnsRenamed({"contact_id": "doc_contact", "number": "matched_number"})
        last = last.join(details, ["tenant_id", "doc_contact", "matched_number"])
    return last.select(
        *STATEMENT_KEYS,
        "contact_id",
        "row_key",
        "item_seq",
        "matched_number",
        *_DOC_FIELDS,
        "doc_ord",
        F.when(F.col("matched_number") == F.col("row_key"), "exact").otherwise("substring").alias("match_type"),
        F.lit(1.0).alias("match_score"),
    )


def _large(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """What the rows of statements whose lists are too long for one group take, as ``_TAKEN``."""
    row_id = [*STATEMENT_KEYS, "row_id"]
    place = F.row_number().over(Window.partitionBy(*row_id).orderBy("place"))
    lists = pairs.withColumn("place", place).checkpoint()
    marks = _marked_ids(lists.select(*row_id, "matched_number", "place")).checkpoint()
    turn = F.row_number().over(Window.partitionBy(*row_id).orderBy("item_seq"))
    # Rows beyond the length of their list find nothing left.
    turns = rows.withColumn("place", turn).join(marks, row_id).where(F.col("place") <= F.col("length")).drop("length")
    listed = lists.join(marks.drop("length"), row_id)

    def of(df: DataFrame, kind: str) -> DataFrame:
        # Both sides of a join come from one table here; names of their own keep them apart.
        return df.where(F.col("kind") == kind).select(*[F.col(c).alias(c) for c in df.columns if c != "kind"])

    alone = of(listed, ALONE).select(*row_id, "place", F.col("contact_id").alias("doc_contact"), "matched_number")
    taken = of(turns, ALONE).join(alone, [*row_id, "place"]).select(*_TAKEN_ARROW.names)
    taken = taken.unionByName(_settled(of(listed, AT_ONCE), of(turns, AT_ONCE)))
    if not marks.where(F.col("kind") == BY_BLOCKS).isEmpty():
        taken = taken.unionByName(_by_blocks(of(listed, BY_BLOCKS), of(turns, BY_BLOCKS)))
    return taken


def _marked_ids(lists: DataFrame) -> DataFrame:
    """Row ids with the ``length`` of their list, how they are settled (``kind``) and, for rivals, the rows of a block."""
    row_id, number = [*STATEMENT_KEYS, "row_id"], [*STATEMENT_KEYS, "matched_number"]
    wanted = lists.join(lists.groupBy(*number).agg(F.count("*").alias("ids")), number)
    lengths = wanted.groupBy(*row_id).agg(F.count("*").alias("length"), (F.max("ids") > 1).alias("rivalled"))
    # A block of n rows has n ids at most and needs no more than n entries of each list: the most rows that stay within bounds.
    longest = F.row_number().over(Window.partitionBy(*STATEMENT_KEYS).orderBy(F.col("length").desc()))
    ranked = lengths.where("rivalled").withColumn("nth", longest)
    sizes = [1 << n for n in range(int(math.log2(ENTRIES_AT_ONCE)) // 2, 31)]
    entries = [F.sum(F.when(F.col("nth") <= n, F.least("length", F.lit(n)))) for n in sizes]
    fitting = F.array_max(F.array(*[F.when(e <= ENTRIES_AT_ONCE, n) for n, e in zip(sizes, entries, strict=True)]))
    blocks = ranked.groupBy(*STATEMENT_KEYS).agg(F.coalesce(fitting, F.lit(sizes[0])).alias("block_rows"), F.sum("length").alias("entries"))
    kind = F.when(~F.col("rivalled"), ALONE).when(F.col("entries") <= ENTRIES_AT_ONCE, AT_ONCE).otherwise(BY_BLOCKS)
    return lengths.join(blocks, STATEMENT_KEYS, "left").select(*row_id, "length", kind.alias("kind"), "block_rows")


def _settled(lists: DataFrame, asking: DataFrame, limit: int | None = None) -> DataFrame:
    """What the rows of each statement take, in order, as ``_TAKEN``; what is taken stays taken, so no list is read twice.

    ``lists`` are in the order of their ``place``. Rows come to a task sorted, so that it holds one statement's lists at a time; of a
    statement whose lists have more than ``limit`` entries it keeps none and says so.
    """
    entry = lists.select(*STATEMENT_KEYS, "contact_id", F.lit(None).cast("bigint").alias("item_seq"), F.lit(None).cast("string").alias("row_key"), "row_id", "matched_number", "place", F.lit(False).alias("asks"))
    nothing = {"matched_number": F.lit(None).cast("string"), "place": F.lit(None).cast(lists.schema["place"].dataType), "asks": F.lit(True)}
    turn = asking.select(*STATEMENT_KEYS, "contact_id", F.col("item_seq").cast("bigint").alias("item_seq"), "row_key", "row_id").withColumns(nothing)
    dealt = entry.unionByName(turn).repartition(*STATEMENT_KEYS).sortWithinPartitions(*STATEMENT_KEYS, "asks", "place", "item_seq", "row_key")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, used, entries = None, {}, set(), 0
        for batch in batches:
            taken = []
            for tenant, statement, contact, item, key, row_id, number, asks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (tenant, statement):
                    now, waiting, used, entries = (tenant, statement), {}, set(), 0
                if not asks:
                    entries += 1
                    if limit is None or entries <= limit:
                        waiting.setdefault(row_id, []).append((contact, number))
                    elif entries == limit + 1:
                        waiting = {}
                        taken.append((tenant, statement, None, None, None, None, None, None))
                    continue
                choices = waiting.get(row_id)
                if choices is None:
                    continue
                if type(choices) is list:
                    choices = waiting[row_id] = iter(choices)
                for best in choices:
                    if best[1] not in used:
                        used.add(best[1])
                        taken.append((tenant, statement, contact, item, key, row_id, *best))
                        break
            if taken:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*taken, strict=True), _TAKEN_ARROW, strict=True)], schema=_TAKEN_ARROW)

    return dealt.drop("place").mapInArrow(settle, _TAKEN)


def _by_blocks(lists: DataFrame, turns: DataFrame) -> DataFrame:
    """What ``_settled`` gives, block by block of each statement's rows.

    A block of n rows needs the n best documents still free of each of its ids, no more; these are settled
    in one group of bounded size. All statements advance side by side. What a block takes is gone from the lists of the next.
    """
    row_id, number = [*STATEMENT_KEYS, "row_id"], [*STATEMENT_KEYS, "matched_number"]
    nth = F.row_number().over(Window.partitionBy(*STATEMENT_KEYS).orderBy("item_seq"))
    turns = turns.withColumn("block", F.floor((nth - 1) / F.col("block_rows"))).checkpoint()
    lists = lists.checkpoint()
    best = F.row_number().over(Window.partitionBy(*row_id).orderBy("place"))
    taken = lists.sparkSession.createDataFrame([], _TAKEN)
    for block in range((turns.agg(F.max("block")).first()[0] or 0) + 1):
        now = turns.where(F.col("block") == block)
        gone = taken.select(*[F.col(c).alias(c) for c in number])
        free = lists.join(now.select(*row_id).distinct(), row_id, "left_semi").join(gone, number, "left_anti")
        near = free.withColumn("place", best).where(F.col("place") <= F.col("block_rows"))
        taken = taken.unionByName(_settled(near, now).checkpoint())
    return taken


def row_keys(items: DataFrame) -> DataFrame:
    """What matching and evidence read of the items, narrow and written to the checkpoint folder once."""
    return stored(items.select(*STATEMENT_KEYS, "contact_id", "item_seq", "row_key"))


def match_statements(items: DataFrame, docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """All matches: exact ones, then documents assigned by containment.

    The rows' keys and the exact matches are read several times on the way; both are narrow and are
    written to the checkpoint folder once. ``keys`` are the ``row_keys`` of the items, where they are at hand.
    """
    keys = row_keys(items) if keys is None else keys
    exact = stored(exact_matches(keys, docs))
    rows = stored(open_rows(keys, exact))
    fuzzy = resolve_matches(rows, id_candidates(rows, docs, exact, ()), docs)
    # The key's last row stands for it, also where the document came from an earlier one.
    last_rows = _keyed_items(keys).select(*STATEMENT_KEYS, "row_key", "item_seq")
    fuzzy = fuzzy.drop("item_seq").join(last_rows, [*STATEMENT_KEYS, "row_key"])
    return exact.unionByName(fuzzy)


def doc_type_of_match(matches: DataFrame) -> DataFrame:
    """Add ``doc_type``: credit notes, and types that end in CREDIT, are credit notes."""
    credit = (F.col("doc_kind") == "credit_note") | F.upper(F.coalesce("type", F.lit(""))).endswith("CREDIT")
    return matches.withColumn("doc_type", F.when(credit, "credit_note").otherwise("invoice"))


def payments_by_invoice_number(docs: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments with the number of the invoice they point at; those of unknown invoices are dropped."""
    invoices = (
        docs.where(F.col("doc_kind") == "invoice")
        .withColumn("number", stripped("number"))
        .where(F.col("doc_id").isNotNull() & (F.col("number") != ""))
        .groupBy("tenant_id", F.col("doc_id").alias("invoice_id"))
        .agg(F.max_by("number", "load_seq").alias("invoice_number"))
    )
    return payments.where(F.col("invoice_id").isNotNull()).join(invoices, ["tenant_id", "invoice_id"])


def contact_rows(docs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Documents of the wanted contacts; rows without a contact are never reachable."""
    return docs.where(F.col("contact_id").isNotNull()).join(
        contacts.where(F.col("contact_id").isNotNull()).select(*CONTACT_KEYS).distinct(), CONTACT_KEYS, "left_semi"
    )
