"""The mix draws documents of a good label more readily: op9 and the pipeline's stage against a plain version with labels."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from test_brute_force import FOLDER, SPACED

import corpus_pipeline
from tallyweave.llm import mixing, queries


def plain(docs, best, targets):
    """Words taken of each document, from all of a source's documents in one order."""
    groups, taken = defaultdict(list), {}
    for d in docs:
        u = (int(hashlib.md5(f"mix{d['doc_id']}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
        size = len(re.findall(SPACED, d["text"] or ""))
        groups[d["source"]].append((-math.log(u) / (2 if best.get(d["doc_id"]) == 1 else 1), d["doc_id"], size))
    for source, rows in groups.items():
        total, goal = sum(r[2] for r in rows), math.floor(targets[source] + 0.5)
        epochs = goal // total
        left = goal - epochs * total
        for _, doc_id, size in sorted(rows):
            given = min(size, left)
            left -= given
            taken[doc_id] = (epochs * size + given, epochs + (given > 0 and given * 2 >= size))
    return taken


def labelled():
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    best = {}
    for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist():
        best[r["doc_id"]] = max(best.get(r["doc_id"], 0), r["quality"])
    return docs, best


def test_op9_weighs_by_labels(spark):
    docs, best = labelled()
    rows = queries.QUERIES["op9_mixed_sources"](spark, FOLDER).collect()
    want = plain(docs, best, {r.source: r.target for r in rows})
    assert {r.doc_id: (r.taken, r.copies) for r in rows} == want
    assert want != plain(docs, {}, {r.source: r.target for r in rows})


def test_stage_copies_what_op9_takes(spark):
    docs, best = labelled()
    rows = queries.QUERIES["op9_mixed_sources"](spark, FOLDER).collect()
    want = plain(docs, best, {r.source: r.target for r in rows})
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.mix(spark, given, FOLDER)
    assert out.columns == given.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, (_, n) in want.items() if n})


def test_rows_settled_in_place_are_those_of_one_join(spark):
    docs = spark.createDataFrame([(i if i % 7 else None, "w " * (i % 5), ("a", "b", None)[i % 3]) for i in range(600)], "doc_id bigint, text string, source string")
    qualities = spark.createDataFrame([(i, (0.1, 2.0, 9.0, None, -1.0)[i % 5]) for i in range(0, 600, 2)], "doc_id bigint, _quality double")
    joined = mixing.mixed(docs.join(qualities, "doc_id", "left"), mixing.F.col("_quality"))
    columns = ["doc_id", "source", "size", "target", "taken", "copies"]
    for with_rows in (True, False):
        out = mixing.mixed_by_labels(docs, qualities, with_rows)
        assert Counter(map(str, out.select(columns).collect())) == Counter(map(str, joined.select(columns).collect()))
    assert mixing.mixed_by_labels(docs.limit(0), qualities).count() == 0
