"""Runs against a search of every period, and the parts it is made of."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_brute_force import FOLDER, SPACED

from tallyweave.llm import periodic, queries


def plain(values, least=12):
    """(start, length, period) of all runs, by start and period."""
    values, out = np.asarray(values), {}
    for q in range(1, len(values) // 2 + 1):
        step = np.diff(np.r_[False, values[:-q] == values[q:], False].astype(int))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e - s + q >= max(least, 2 * q):
                out.setdefault((s, e - s + q), q)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def sequence(rand):
    n, kind, p = int(rand.integers(0, 200)), rand.integers(0, 6), int(rand.integers(1, 40))
    if kind == 0:
        return rand.integers(0, 2, n)
    if kind == 1:
        return np.zeros(n, np.int64)
    if kind == 2:
        out = np.resize(rand.integers(0, 5, p), n)
        out[rand.integers(0, n, int(rand.integers(0, 4))) if n else []] = 9
        return out
    if kind == 3:  # periods within periods
        return np.resize(np.r_[np.resize(rand.integers(0, 3, int(rand.integers(1, 5))), int(rand.integers(1, 25))), rand.integers(0, 4, int(rand.integers(0, 3)))], n)
    if kind == 4:  # a square around a break, of many periods
        part = np.resize([0, 1], p)
        return np.r_[part, part, rand.integers(0, 3, 3), part, part[: p // 2]]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return np.array(b[:n])


def test_runs_of_many_sequences():
    rand = np.random.default_rng(4)
    for _ in range(300):
        parts = [sequence(rand).astype(np.int64) for _ in range(rand.integers(1, 6))]
        found = periodic.runs(np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])])
        assert [tuple(r) for r in found.tolist()] == [(n, *r) for n, x in enumerate(parts) for r in plain(x)]


def test_range_successor():
    rand = np.random.default_rng(5)
    for n in (1, 2, 50, 64, 127):
        values = rand.permutation(n)
        index = periodic.WaveletMatrix(values)
        low, high = np.sort(rand.integers(0, n + 1, (2, 300)), axis=0)
        least = rand.integers(0, n + 2, 300)
        for a, b, x, got in zip(low, high, least, index.successor(low, high, least), strict=True):
            assert got == min([v for v in values[a:b] if v >= x], default=n)


def test_no_fewer_words():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(30, np.int64), np.array([0, 30]), 6)


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text):
    words = re.findall(SPACED, text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain([words.index(w) for w in words] if len(words) < 500 else np.unique(words, return_inverse=True)[1])
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    text = collapsed(words, runs)
    row = {"doc_id": doc_id, "n_runs": len(runs), **dict.fromkeys(("start", "length", "period", "exponent_milli"))}
    if best:
        row |= {"start": best[1], "length": -best[0], "period": best[2], "exponent_milli": 1000 * -best[0] // best[2]}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return row | {"runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text.encode()).hexdigest()}


def test_query(spark):
    got = {r.doc_id: r.asDict() for r in queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    assert len(got) == len(docs) and sum(r["n_runs"] > 0 for r in got.values()) > 10
    for d in docs:
        assert got[d["doc_id"]] == expected(d["doc_id"], d["text"])


def test_edges(spark, tmp_path, monkeypatch):
    long = " ".join(f"w{i % 977}" if i % 3000 else "x" for i in range(60_000))
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a " * 3000, "a b " * 500 + "c " + "a b " * 400, "é x y　 " * 9, "A a " * 20, long, "one two three four five six " * 2]
    rows = [(None if n % 4 == 3 else n, t, "k", 1, 2) for n, t in enumerate(texts)] + [(2, texts[6], "k", 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int, start int")
    for chunk in (1, 2 << 20):
        monkeypatch.setattr(periodic, "CHUNK", chunk)
        out = periodic.repeated_runs(df).collect()
        assert len(out) == len(rows)
        left = sorted(((r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in out), key=str)
        want = []
        for i, t, *_ in rows:
            words = re.findall(SPACED, t or "")
            runs = plain(np.unique(words, return_inverse=True)[1] if words else []) if t is not long else [(s, m, q) for s, m, q in next(x for x in left if x[1] == 60_000)[2]]
            want.append((i, len(words), runs, collapsed(words, runs)))
        assert left == sorted(want, key=str)
    hidden = next(x for x in left if x[1] == 60_000)[2]
    assert len(hidden) >= 20 and all(q == 977 and m >= 2 * q for _, m, q in hidden)
    assert periodic.repeated_runs(df.limit(0)).count() == 0
    spark.createDataFrame(rows, df.schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == len(rows)
    for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect():
        same = [expected(i, t) for i, t, *_ in rows if i == r.doc_id and t is not long]
        assert r.asDict() in same or any(t is long and i == r.doc_id for i, t, *_ in rows)
