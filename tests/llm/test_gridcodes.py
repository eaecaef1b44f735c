"""Grid codes against plain quantisation."""

import hashlib
import math

import numpy as np

from tallyweave.llm import gridcodes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string, part int, of string, label_error int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    points = np.array([v + [0] * (parts * width - len(v)) for _, _, v in kept], np.int64).reshape(len(kept), parts, width)
    books = points[:entries].transpose(1, 0, 2).copy()

    def assign():
        apart = ((points[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return apart.argmin(axis=2), apart.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = points[code[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(x) // len(own) for x in own.sum(axis=0)]
    code, error = assign()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    totals = {}
    for (_, label, _), e in zip(kept, error.tolist(), strict=True):
        totals[label] = totals.get(label, 0) + e
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, totals[label], digest) for (i, label, _), c, e in zip(kept, code.tolist(), error.tolist(), strict=True)), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "c", "e", 1, "o", 5) for i, v, label in rows], SCHEMA).repartition(3)
    out = gridcodes.compressed(df, **options)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.drop("label").collect()), key=str)


def vectors(n, dims, seed=1):
    rand = np.random.default_rng(seed)
    return [(int(i), (rand.normal(size=dims) / math.sqrt(dims)).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rand.permutation(n)]


def test_codes(spark):
    rows = vectors(500, 64)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, parts=8, entries=9, rounds=3, step=5) == plain(rows, 8, 9, 3)


def test_ties_copies_and_few_rows(spark):
    same = [(i, [0.25] * 16 + [0.0] * 16, 1) for i in range(90)]  # all entries are one: the lowest index wins
    assert found(spark, same) == plain(same) and {r[1] for r in found(spark, same)} == {"00" * 16}
    few = vectors(5, 32) + [(None, [0.1] * 32, None), (3, [0.1] * 32, 2), (3, [0.2] * 32, 2), (3, [0.2] * 32, 2)]
    assert found(spark, few) == plain(few)


def test_what_takes_no_part(spark):
    rows = vectors(40, 16) + [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [float("nan")] * 16, 1), (903, [float("-inf")] * 16, 1), (904, [0.5], 1), (905, [], 2), (906, [0.1] * 17, 2)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    assert len(found(spark, [(1, [1e38] * 16, 1), (2, [-1e38] * 16, 1)])) == 2


def test_cells_keep_every_nearest_entry(monkeypatch):
    rand = np.random.default_rng(6)
    entries = rand.integers(-60, 60, (64, 3))
    entries[10] = entries[50]
    points = rand.integers(-300, 300, (4000, 3))
    apart = ((points[:, None] - entries) ** 2).sum(axis=2)
    for kept in (1 << 15, 20):
        monkeypatch.setattr(gridcodes, "CELLS_KEPT", kept)
        grid = gridcodes.Grid(entries, 32)
        for a in range(0, 4000, 500):  # cells are met again
            best, far = grid.nearest(points[a : a + 500])
            assert (best == apart[a : a + 500].argmin(axis=1)).all() and (far == apart[a : a + 500].min(axis=1)).all()
        assert len(grid.cells) <= kept and np.mean([len(x) for x in grid.cells.values()]) < 40
