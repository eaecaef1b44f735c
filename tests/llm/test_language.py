"""Language codes: samples that repeat, many languages, answers that are not sure."""

import random

import pyarrow.parquet as pq
from test_brute_force import FOLDER

from tallyweave.llm import language

KIND = "doc_id bigint, text string, lang string"


def spoken(rand, n_languages, n):
    """Texts of made-up languages, each with words of its own letters."""
    alphabets = ["".join(rand.sample("abcdefghijklmnopqrstuvwxyz", 12)) for _ in range(n_languages)]
    words = [["".join(rand.choice(a) for _ in range(rand.randint(2, 7))) for _ in range(400)] for a in alphabets]
    return [(i, " ".join(rand.choice(words[i % n_languages]) for _ in range(60)), f"l{i % n_languages:02}") for i in range(n)]


def test_every_language_has_its_sample_however_rows_repeat(spark):
    rand = random.Random(1)
    rows = spoken(rand, 3, 300) + [(None, "zu zwo zeh " * 20, "z")] * 900 + [(7, "one and only", "rare")]
    model = language.fit(spark.createDataFrame(rows, KIND), 50)
    assert model.languages == ["l00", "l01", "l02", "rare", "z"]
    out = language.tagged(spark.createDataFrame(rows, KIND), model)
    assert out.filter("lang_pred = lang").count() >= 0.97 * len(rows)
    assert {r.lang_pred for r in out.filter("lang in ('z', 'rare')").collect()} == {"z", "rare"}


def test_more_languages_than_exhaustive_codes(spark):
    rand = random.Random(2)
    for n in (8, 12):
        rows = spoken(rand, n, 60 * n)
        model = language.fit(spark.createDataFrame(rows[: 40 * n], KIND))
        assert model.code.shape[0] == n > language.EXHAUSTIVE
        out = language.tagged(spark.createDataFrame(rows[40 * n :], KIND), model)
        assert out.filter("lang_pred = lang").count() >= 0.95 * 20 * n


def test_noise_and_mixtures_are_ambiguous_and_plain_texts_are_not(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    docs = [d for d in pq.read_table(f"{folder}/documents.parquet").to_pylist() if d["lang"] and len((d["text"] or "").split()) >= 30]
    model = language.fit(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in docs if d["doc_id"] % 3], KIND))
    rand, by = random.Random(3), {}
    for d in docs:
        by.setdefault(d["lang"], []).append(d["text"].split())
    halves = []
    for _ in range(200):
        a, b = (rand.choice(by[x]) for x in rand.sample(sorted(by), 2))
        n = min(len(a), len(b))
        halves.append(" ".join(a[:n] + b[:n]))
    noise = [" ".join("".join(rand.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rand.randint(2, 9))) for _ in range(50)) for _ in range(200)]

    def flagged(texts):
        return language.tagged(spark.createDataFrame([(t,) for t in texts], "text string"), model).filter("ambiguous").count() / len(texts)

    assert flagged([d["text"] for d in docs if d["doc_id"] % 3 == 0]) <= 0.01
    assert flagged(noise) >= 0.95 and flagged(halves) >= 0.2
