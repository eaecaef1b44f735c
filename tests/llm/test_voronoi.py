"""Exact neighbours against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import voronoi

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, `query_id` bigint, cell int, `row` string"


def whole(vector, scale=64):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def plain(rows, k=20):
    """(query_id, rank, vec_id, score) of all pairs."""
    kept = [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(kept):
        if q is None or q % 20:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for m, (i, b) in enumerate(kept) if m != n]
        for rank, (less, nameless, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if nameless else i, -less))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "s", 7, 9, 3, "r") for i, v in rows], SCHEMA).repartition(3)
    out = voronoi.nearest(df, F.col("vec_id") % 20 == 0, **options)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def clustered(n, dims, seed=1):
    rand = np.random.default_rng(seed)
    centres = rand.normal(size=(8, dims))
    return [(i, (centres[i % 8] + 0.01 * rand.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_ties_and_copies(spark):
    rows = clustered(400, 8)
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(20, [0.5] * 8), (20, [0.5] * 8), (None, [0.5] * 8), (40, rows[40][1])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, pivots=3, k=5) == plain(rows, 5)


def test_what_takes_no_part(spark):
    rows = [(0, None), (20, [None, 1.0]), (40, [float("nan"), 1.0]), (60, [float("inf"), 0.0]), (80, [1.0, 2.0]), (100, []), (3, [3.0]), (-20, [-1.0, -0.01]), (5, [0.0, 0.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(3, [1.0])]) == [] and found(spark, [(20, [1.0])]) == []


def test_wide_numbers(spark):
    rand = random.Random(2)
    for scale in (3.0, 1e3, 1e6):
        rows = [(i, [rand.uniform(-scale, scale) for _ in range(5)]) for i in range(60)]
        assert found(spark, rows) == plain(rows)
    assert len(found(spark, [(i, [1e38, -1e38 * (i % 3)]) for i in range(30)])) == 40


def test_small_blocks_slices_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 7), ("GROUP", 5), ("SLICE", 64)):
        monkeypatch.setattr(voronoi, name, value)
    rows = clustered(600, 4, 3)
    assert found(spark, rows, pivots=16) == plain(rows)


def test_blocks_are_sent_only_where_needed(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 16)
    monkeypatch.setattr(voronoi, "GROUP", 8)
    tables = {}
    keep = voronoi.written
    monkeypatch.setattr(voronoi, "written", lambda df, name: tables.setdefault(name, keep(df, name)))
    rows = clustered(800, 8, 4)
    assert found(spark, rows, pivots=64) == plain(rows)
    pairs, all_pairs = tables["pairs"].count(), tables["blocks"].count() * tables["groups"].count()
    assert pairs < 0.5 * all_pairs


@pytest.mark.parametrize("square", [100.0, 2.0**60])
def test_best_breaks_ties_by_place(square):
    rand = np.random.default_rng(5)
    scores = rand.integers(0, 4, (6, 40)).astype(float)
    for row, chosen in zip(scores, voronoi.best(scores, 7, square), strict=True):
        assert sorted(chosen) == sorted(np.argsort(-row, kind="stable")[:7])
