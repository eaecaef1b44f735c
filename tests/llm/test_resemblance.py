"""The near-duplicate stage of the pipeline against all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_brute_force import FOLDER, SPACED, lowered

import corpus_pipeline
from tallyweave.llm import resemblance


def shingles(text):
    words = re.findall(SPACED, lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def smallest(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for a, b in combinations(sorted(docs), 2):
        if near(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return set(root.values())


def test_stage_keeps_one_of_each_component(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    out = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    assert sorted(r.doc_id for r in out.collect()) == sorted(smallest(docs))


def test_edited_copies_chains_and_short_texts(spark):
    rand = random.Random(3)
    base = ["".join(rand.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, chain = [None, "", "  ", "One two", "one  TWO", "one", " ".join(base)], list(base)
    for n in range(40):  # each a few words from the one before, the last far from the first
        chain[7 * n % 300] = f"x{n}"
        texts.append(" ".join(chain))
    for n in range(30):
        words = list(base)
        for place in rand.sample(range(300), rand.randint(1, 12)):
            words[place] = f"y{n}.{place}"
        texts.append(" ".join(words))
    docs = dict(enumerate(texts))
    rows = [(i, t, "k") for i, t in docs.items()]
    out = resemblance.deduplicated(spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, kind string"))
    assert out.columns == ["doc_id", "text", "kind"] and sorted(r.doc_id for r in out.collect()) == sorted(smallest(docs))
    assert resemblance.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_similarity_is_exact(spark):
    texts = [d["text"] for d in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()[:40]]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts, [t + " and a little more" for t in texts], strict=True))] + [(99, None, ""), (98, None, "a")]
    out = spark.createDataFrame(pairs, "i int, a string, b string").select("i", resemblance.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    want = {i: near(shingles(a), shingles(b)) for i, a, b in pairs}
    assert {r.i: r.s for r in out} == pytest.approx(want)


def edited(rand, words, share):
    return [f"e{rand.random()}" if rand.random() < share else w for w in words]


def linked(docs):
    """Smallest ids of components, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs.items()}
    where, root = {}, {i: i for i in docs}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in sorted(docs):
        shared = Counter(j for s in sets[i] for j in where.get(s, ()))
        for j, both in shared.items():
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                low, high = sorted((top(i), top(j)))
                root[high] = low
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return {top(i) for i in docs}


def test_recall_on_edited_copies(spark):
    rand = random.Random(11)
    vocabulary = ["".join(rand.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    texts = []
    for _ in range(400):
        base = [rand.choice(vocabulary) for _ in range(rand.randint(60, 400))]
        texts += [" ".join(edited(rand, base, rand.uniform(0, 0.05))) for _ in range(rand.randint(1, 5))]
    docs = dict(enumerate(texts))
    out = {r.doc_id for r in resemblance.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    want = linked(docs)
    assert 400 < len(want) < len(docs) and len(out ^ want) <= 1  # 1,400 copies at 0.8 or a little more or less


def test_large_group_of_texts_that_are_mostly_not_near(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "HEAVY", 16)
    joined = []
    keep = resemblance.written
    monkeypatch.setattr(resemblance, "written", lambda df, name: joined.append((name, keep(df, name))) or joined[-1][1])
    rand = random.Random(12)
    base = [f"w{n}" for n in range(300)]
    docs = {n: " ".join(edited(rand, base, rand.uniform(0.01, 0.12))) for n in range(300)}
    out = resemblance.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    assert {r.doc_id for r in out.collect()} == linked(docs)
    assert sum(df.count() for name, df in joined if name in ("stars", "rest")) < 300 * 299 // 2 // 4


def test_fingerprints_find_pairs_that_no_band_does(spark):
    rand, texts = random.Random(13), []
    for g in range(60):  # one shingle is most of a text, so both fingerprints are that of it; of sets at 0.64 the bands miss one in nine
        base = [f"u{g}.{rand.random()}" for _ in range(90)]
        near_copy = [f"v{g}.{n}" if n % 20 == 10 and n < 80 else w for n, w in enumerate(base)]
        texts += [" ".join([f"z{g}"] * 300 + words) for words in (base, near_copy)]
    docs = dict(enumerate(texts))
    sets = {i: shingles(t) for i, t in docs.items()}
    assert all(0.6 <= near(sets[i], sets[i + 1]) < 0.7 for i in range(0, 120, 2))
    out = resemblance.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), least=0.6)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 120, 2))
