"""The pipeline's stages, each against a plain version over its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from test_brute_force import ALNUM, FOLDER, SPACED, lowered
from test_resemblance import smallest

import corpus_pipeline
from tallyweave.llm import queries


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append(docs.collect())
    given = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    told, unique, clean, mixed, tokens = results
    assert len(told) >= 0.99 * sum(bool(re.search(r"[^\W\d_]", r.text)) for r in given) and set(told) <= set(given)

    assert {r.doc_id for r in unique} == smallest({r.doc_id: r.text for r in told}) and set(unique) <= set(told)

    windows = set()
    for item in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist():
        words = re.findall(ALNUM, lowered(item["text"]))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9) if words else 0)}
    sizes = {len(w) for w in windows}

    def hit(text):
        words = re.findall(ALNUM, lowered(text))
        return any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    assert {r.doc_id for r in clean} == {r.doc_id for r in unique if not hit(r.text)} and set(clean) <= set(unique)

    words = {r.doc_id: len(re.findall(SPACED, r.text)) for r in clean}
    copies = Counter(r.doc_id for r in mixed)
    assert set(mixed) <= set(clean) and max(copies.values()) <= 2
    total, taken, largest = Counter(), Counter(), Counter()
    for r in clean:
        total[r.source] += words[r.doc_id]
        taken[r.source] += words[r.doc_id] * copies[r.doc_id]
        largest[r.source] = max(largest[r.source], words[r.doc_id])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level at which capped targets add up to the share
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in total) < 1.5 * sum(total.values()) else (low, level)
    for s in total:
        assert abs(taken[s] - min(2 * total[s], low * weight[s])) <= largest[s] / 2 + 1

    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(queries.vocabulary()), 0
    rows = sorted(tokens, key=lambda r: r.start)
    for r, doc in zip(rows, sorted(mixed, key=lambda r: (r.doc_id, r.text)), strict=True):
        ids = [*library.encode(doc.text, add_special_tokens=False).ids, queries.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
