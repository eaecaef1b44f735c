"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweave.llm import decontamination, language, mixing, neardup, queries, scoring, sharding, stores, substrings, syncmers, textkit, token_files, warc

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdeilnorstué") for _ in range(RANDOM.randint(2, 7))) for _ in range(3000)]
LONG = " ".join(RANDOM.choice(VOCABULARY) for _ in range(120_000))
PASSAGE = " ".join(RANDOM.choice(VOCABULARY) for _ in range(60))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, size int, fp int, part int, place int, start int, `a.b` int, target string, copies int"
ROWS = [
    (1, None), (2, ""), (3, "   \n"), (4, "One two"), (5, "?! 12 .."), (6, LONG), (7, PASSAGE), (7, PASSAGE), (None, PASSAGE), (None, None), (8, "x " + PASSAGE + " y"),
    (9, "One two"), (10, "one  TWO"), (11, "a"), (-4, "Ünïcode ça <|endoftext|> 'll don't  日本"), (12, "A " * 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[n % 3], ("s", None)[n % 5 == 0], len(t or ""), "k", n, n, n, n, n, n, "t", 9) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    short = " ".join(PASSAGE.split()[20:35])
    return spark.createDataFrame([(1, short), (10, short), (2, None), (3, ""), (None, short), (4, "ONE two")], "item_id bigint, text string")


def rows_of(df):
    return sorted((r.asDict(True) for r in df.collect()), key=str)


def test_language(spark, docs):
    model = language.fit(docs, 10)
    assert model.languages == ["en", "fr"]
    out = rows_of(language.tagged(docs, model).select("doc_id", "text", "lang_pred", "score", "ambiguous", "kind"))
    assert len(out) == len(ROWS)
    for r in out:
        lettered = re.search(r"[^\W\d_]", r["text"] or "") is not None
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1 and (lettered or r["score"] == 0)
    kept = language.recognised(docs, 10)
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows_of(kept)}.isdisjoint({1, 2, 3, 5})
    none = language.fit(docs.limit(0))
    assert none.languages == [] and {r["lang_pred"] for r in rows_of(language.tagged(docs, none))} == {"und"}
    one = language.fit(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in rows_of(language.tagged(docs, one))} == {"und", "en"}
    assert language.tagged(docs.limit(0), model).count() == 0
    assert rows_of(language.recognised(docs.withColumn("lang", F.lit(None).cast("string"))).select("doc_id")) == rows_of(docs.filter(docs["text"].rlike(r"\p{L}")).select("doc_id"))


def test_codewords_are_apart():
    for n in (2, 3, 7, 8, 40):
        code = language.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    manifest = token_files.write_token_files(docs, queries.vocabulary(), 2, file_bytes=2000)
    assert manifest.count() > 1
    got = [r.asDict() for r in token_files.read_token_files(manifest).orderBy("start").collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (doc_id, start, len(ids), ids.tobytes())
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    empty = token_files.write_token_files(docs.limit(0), queries.vocabulary(), 2)
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0


def test_random_texts_are_cut_like_the_library_does():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(queries.vocabulary()), token_files.Encoder(queries.vocabulary())
    texts = ["".join(RANDOM.choice(" \n'\tslrevmdtaA1!é×¿") for _ in range(RANDOM.randint(0, 30))) for _ in range(3000)]
    ids, counts = own.encode(*textkit.bytes_of(pa.array(texts)))
    first = np.r_[0, np.cumsum(counts)]
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_file_round_trip():
    random_ = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 1000):
        for top in (1, 2**16, 2**17, 2**32):
            ids = random_.integers(0, top, n, dtype=np.uint32)
            if n > 200:
                ids[::97] = 2**32 - 1
            raw = token_files.encode_file(ids, np.array([1, 0]), np.array([False, True]), np.array([0, n // 2, n]))
            back, doc_ids, missing, firsts = token_files.decode_file(raw)
            assert (back == ids).all() and doc_ids.tolist() == [1, 0] and missing.tolist() == [False, True] and firsts.tolist() == [0, n // 2, n]


def test_suffix_array_is_sorted():
    for _ in range(30):
        sizes = [RANDOM.randint(0, 40) for _ in range(5)]
        texts = [" ".join(RANDOM.choice("ab") for _ in range(n)) for n in sizes]
        shard = decontamination.Shard(*textkit.bytes_of(pa.array(texts)))
        suffixes = [tuple(shard.ids[i : shard.stop[shard.row[i]]].tolist()) for i in shard.order]
        assert suffixes == sorted(suffixes) and sorted(shard.order.tolist()) == list(range(len(shard.ids)))


def test_contamination(docs, benchmark, monkeypatch):
    found = {(r["doc_id"], r["n_words"]): r for r in rows_of(decontamination.benchmark_matches(docs, benchmark))}
    assert found[7, 60]["spans"] == [{"start": 20, "end": 35}] and found[7, 60]["items"] == ["1", "10"] and found[7, 60]["longest"] == 15
    assert found[8, 62]["spans"] == [{"start": 21, "end": 36}] and found[4, 2]["items"] == ["4"] and found[None, 0]["spans"] == []
    kept = decontamination.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r for r in ROWS if not r[1] or (PASSAGE not in r[1] and r[1].lower().split() != ["one", "two"])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))
    assert decontamination.decontaminated(docs.limit(0), benchmark).count() == 0
    assert decontamination.decontaminated(docs, benchmark.limit(0)).count() == len(ROWS)
    # A benchmark of many blocks, and shards of single documents.
    folder = decontamination._stored(benchmark)
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 2)
    batch = pa.table({"doc_id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS]}).to_batches()
    again = [r for b in decontamination._shards(folder, 10, 1, decontamination._rows)(iter(batch)) for r in b.to_pylist()]
    assert {(r["doc_id"], r["n_words"]): (r["spans"], r["items"], r["longest"]) for r in again} == {k: (r["spans"], r["items"], r["longest"]) for k, r in found.items()}


def test_scores(docs):
    training = F.col("doc_id") % 2 == 0
    out = rows_of(scoring.scored(docs, training))
    assert len(out) == len(ROWS)
    empty = [r for r in out if r["n_tokens"] == 1]
    assert len(empty) == 4 and len({r["base_score"] for r in empty}) == 1
    assert all(r["score"] <= 0 and r["n_known"] <= r["n_tokens"] for r in out)
    nothing = rows_of(scoring.scored(docs, F.lit(None).cast("boolean")))
    assert {r["train_tokens"] for r in nothing} == {0} and {r["n_known"] for r in nothing} == {0}
    assert scoring.scored(docs.limit(0), training).count() == 0


def test_passes_of_the_filter_add_up(docs, monkeypatch):
    whole = {(r["doc_id"], r["text_hash"]): r for r in rows_of(scoring.scored(docs, F.col("doc_id") < 8))}
    monkeypatch.setattr(scoring, "SEGMENT_BYTES", 100_000)
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 1)
    split = {(r["doc_id"], r["text_hash"]): r for r in rows_of(scoring.scored(docs, F.col("doc_id") < 8))}
    assert set(whole) == set(split)
    for key, r in whole.items():
        assert (split[key]["n_tokens"], split[key]["n_known"]) == (r["n_tokens"], r["n_known"])
        assert split[key]["base_score"] == pytest.approx(r["base_score"]) and abs(split[key]["score"] - r["score"]) < 0.6 + 0.1 * r["n_tokens"]


def test_filter_gives_back_levels():
    keys = textkit.mix(np.arange(20_000, dtype=np.uint64))
    counts = (np.arange(20_000) % 50 + 1) ** 2
    bloom = scoring.Bloom({0: scoring.Bloom.build(keys, counts)}, 1)
    got, want = bloom.levels(keys, np.zeros(len(keys), np.int64)), scoring.level(counts)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (bloom.levels(keys + np.uint64(1), np.zeros(len(keys), np.int64)) == 0).mean() > 0.9


def test_near_duplicates(docs):
    out = rows_of(neardup.near_duplicates(docs))
    assert len(out) == len(ROWS)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in out}
    blank = {c for (i, fp), c in by.items() if fp == 0}
    assert blank == {1} and {c for (i, _), c in by.items() if i in (4, 9, 10)} == {4} and {c for (i, _), c in by.items() if i == 7} == {7}
    kept = neardup.deduplicated(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and {1, 4, 6, 7, 11, -4, 12} <= set(ids) and not {2, 3, 5, 9, 10} & set(ids) - {5}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.deduplicated(docs.limit(0)).count() == 0


def test_pigeonring_misses_no_pair(spark):
    base = [RANDOM.getrandbits(64) for _ in range(40)]
    values = {v ^ sum(1 << b for b in RANDOM.sample(range(64), RANDOM.randint(0, 3))) for v in base for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for distance, segments in ((2, 16), (3, 16), (1, 4), (0, 8)):
        got = {(r.a, r.b) for r in neardup.pigeonring_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint"), distance, segments).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (5, 5)]
    got = {r.node: r.root for r in neardup.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}


def test_repeated_passages(docs):
    out = rows_of(substrings.without_repeats(docs))
    assert len(out) == len(ROWS)
    by = {(r["doc_id"], r["n_words"]): r for r in out}
    assert by[8, 62]["kept_text"] == "x y" and by[8, 62]["spans"] == [{"start": 1, "end": 61}]
    assert by[7, 60]["kept_text"] == "" and by[12, 500]["n_removed"] == 500 and by[6, 120_000]["n_removed"] == 0 and by[None, 0]["kept_text"] == ""
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_anchors_cover_every_repeat(spark):
    words = [RANDOM.choice("abc") for _ in range(1500)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, 1500, 90)]
    seen = {}
    for n, t in enumerate(texts):
        own = t.split()
        for i in range(len(own) - 19):
            seen.setdefault(tuple(own[i : i + 20]), []).append((n, i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for r in substrings.without_repeats(df, least=20, anchor=4).collect():
        gone = {i + j for places in seen.values() if len(places) > 1 for n, i in places if n == r.doc_id for j in range(20)}
        assert r.n_removed == len(gone)


def test_shards(docs):
    out = rows_of(sharding.sharded(docs, limit=1000))
    assert len(out) == len(ROWS)
    sums = {}
    for r in out:
        sums.setdefault(r["shard"], []).append(r["n_bytes"])
    for r in out:
        assert r["shard_bytes"] == sum(sums[r["shard"]]) and r["shard_rows"] == len(sums[r["shard"]])
        assert r["oversize"] == (r["shard_bytes"] > 1000) and len(r["shard"]) == r["depth"]
        # A split was needed: what shares one bit less exceeds the limit.
        if r["depth"]:
            assert sum(x["n_bytes"] for x in out if x["shard"].startswith(r["shard"][:-1])) > 1000
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_oversized_hashes_split_down_to_single_keys(spark):
    same = spark.createDataFrame([(1, "x" * 900)] * 3 + [(2, "y" * 900)] * 2 + [(i, "z") for i in range(3, 40)], "doc_id bigint, text string")
    out = rows_of(sharding.sharded(same, limit=1000))
    big = {r["doc_id"]: r for r in out if r["oversize"]}
    assert set(big) == {1, 2} and big[1]["shard_rows"] >= 3 and sum(1 for _ in out) == 42


def test_mix(docs):
    out = rows_of(mixing.mixed(docs, F.lit(None)))
    again = rows_of(mixing.mixed(docs.repartition(3), F.lit(None)))
    assert len(out) == len(ROWS) and [(r["doc_id"], r["taken"]) for r in out] == [(r["doc_id"], r["taken"]) for r in again]
    for source in ("s", None):
        own = [r for r in out if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r["taken"] for r in rows_of(mixing.mixed(docs.filter("text is null")))} == {0}


def test_edited_texts(docs):
    out = rows_of(syncmers.compared_with_edits(docs))
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert len(out) == len(ROWS)
    want = []
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        text, third = text or "", len(text or "") // 3
        want.append((doc_id, len(text), syncmers.hashlib.sha256((text[: len(text) - third] + (following or "")[:third]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in out)
    assert syncmers.compared_with_edits(docs.limit(0)).count() == 0
    alone = rows_of(syncmers.compared_with_edits(docs.filter("doc_id = 6")))
    assert [r["near_next"] for r in alone] == [1.0]


def test_edited_texts_over_many_ranges(docs, spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_PER_RANGE", 3)
    texts = [(i * 7 % 101, f"{i} " + " ".join(RANDOM.choice(VOCABULARY) for _ in range(30))) for i in range(100)]
    got = {r.doc_id: r.edited_sha256 for r in syncmers.compared_with_edits(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()}
    order = sorted(texts, reverse=True)
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        third = len(text) // 3
        assert got[doc_id] == syncmers.hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


def test_edited_texts_between_cuts(docs, spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_PER_RANGE", 3)
    monkeypatch.setattr(syncmers, "CUTS", 4)
    monkeypatch.setattr(syncmers, "PARTITIONS", 5)
    ids = [*range(0, 60), *range(10**12, 10**12 + 40, 3), *[-(2**62)] * 3, 2**62, None, None]
    texts = [(i, f"{n} " + " ".join(RANDOM.choice(VOCABULARY) for _ in range(30))) for n, i in enumerate(ids)]
    got = [(r.doc_id, r.edited_sha256) for r in syncmers.compared_with_edits(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()]
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (doc_id, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        third = len(text) // 3
        want.append((doc_id, syncmers.hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_grow_and_see_small_edits():
    words = [RANDOM.choice(VOCABULARY) for _ in range(20_000)]
    changed = list(words)
    for i in RANDOM.sample(range(20_000), 20):
        changed[i] = "changed"
    a, b = (syncmers.Printed(" ".join(w)) for w in (words, changed))
    whole = len(np.intersect1d(a.anchors[1], b.anchors[1])) / len(np.union1d(a.anchors[1], b.anchors[1]))
    assert len(a.print) > 4 * syncmers.LEAST and syncmers.likeness(a.print, b.print) < 1 and abs(syncmers.likeness(a.print, b.print) - whole) < 0.01


def test_passages_are_as_long_as_they_can_be():
    part = [" ".join(RANDOM.choice(VOCABULARY) for _ in range(80)).encode() for _ in range(5)]
    a, b = part[0] + b"#" + part[1] + b"#" + part[2], part[3] + b"%" + part[1] + b"%" + part[4] + b"%" + part[0]
    x, y = (np.frombuffer(t, np.uint8) for t in (a, b))
    found = syncmers.passages(x, y, syncmers.closed_syncmers(x), syncmers.closed_syncmers(y))
    want = {(a.index(p), b.index(p)) for p in (part[0], part[1])}
    assert want <= {(i, j) for i, j, _ in found} and syncmers.covered(found) >= len(part[0]) + len(part[1])
    for i, j, n in found:
        assert a[i : i + n] == b[j : j + n] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]) and a[i + n : i + n + 1] != b[j + n : j + n + 1] or i + n == len(a)
    assert syncmers.passages(x, x, syncmers.closed_syncmers(x), syncmers.closed_syncmers(x)) == [(0, 0, len(a))]


def test_syncmers_do_not_depend_on_context():
    data = np.frombuffer(LONG[:5000].encode(), np.uint8)
    place, hashes = syncmers.closed_syncmers(data)
    inner, outer = syncmers.INNER, syncmers.OUTER
    small = textkit.mix(np.array([int.from_bytes(data[i : i + inner].tobytes(), "little") for i in range(len(data) - inner + 1)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    span = outer - inner + 1
    assert place.tolist() == [i for i in range(len(data) - outer + 1) if min(small[i : i + span]) in (small[i], small[i + span - 1])]
    again = dict(zip(*syncmers.closed_syncmers(data[100:4000]), strict=True))
    assert again == {p - 100: h for p, h in zip(place.tolist(), hashes.tolist(), strict=True) if 100 <= p <= 4000 - outer}


def test_warc(spark):
    page = "<html>" + "é" * 60
    rows = [(1, "http://a/x", page, 1), (2, None, page, 1), (None, "u", page, 1), (3, "http://b", None, 1), (4, "", "", 1), (5, "x\r\ny", "ab\r\n\r\ncd" + page, 1), (5, "x", "ab\r\n\r\ncd" + page, 1), (6, "c", "short", 1), (7, "c", "short", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_id int")
    manifest = warc.write_archives(pages, archive_bytes=300)
    assert manifest.count() > 1
    out = rows_of(warc.captures(warc.read_records(manifest)))
    assert len(out) == len(rows)
    got = sorted((str(r["page_id"]), str(r["url"]), r["response"]["record_type"], str(r["response"]["refers_to"]), r["response"]["payload_bytes"]) for r in out)
    size = len(page.encode())
    assert got == sorted(
        [("1", "http://a/x", "response", "None", size), ("2", "None", "revisit", "1", size), ("None", "u", "revisit", "1", size), ("3", "http://b", "response", "None", 0), ("4", "", "response", "None", 0)]
        + [("5", "x  y", "response", "None", size + 8), ("5", "x", "response", "None", size + 8), ("6", "c", "response", "None", 5), ("7", "c", "response", "None", 5)]
    )
    assert all(r["request"]["request_line"].startswith("GET /") and r["metadata"]["record_id"] for r in out)
    payloads = {r["page_id"]: r["response"]["payload"] for r in out if r["response"]["record_type"] == "response"}
    assert bytes(payloads[1]).decode() == page and bytes(payloads[5]).decode() == "ab\r\n\r\ncd" + page
    empty = warc.write_archives(pages.limit(0))
    assert empty.count() == 0 and warc.captures(warc.read_records(empty)).count() == 0


def test_plain_archives_are_read_too():
    members = list(warc.capture("n", 1, "http://a", "x", None, None))
    plain = b"".join(m for raw in members for m in warc._members(raw))
    assert [h["warc-type"] for h, _ in warc.parse(plain)] == ["request", "response", "metadata"] == [h["warc-type"] for h, _ in warc.parse(b"".join(members))]
    with pytest.raises(ValueError):
        list(warc.parse(members[0][:-3]))


def test_revisits_name_the_record_they_repeat(spark):
    page = "<html>" + "x" * 200
    rows = [(4, "http://a/4", page), (2, "http://a/2", page), (9, "u", page), (7, "twice", page + "y"), (7, "twice", page + "y"), (8, "z", page + "y"), (1, "no", "short")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), archive_bytes=150)
    records = warc.read_records(manifest)
    assert records.filter("record_type = 'warcinfo'").count() == manifest.count() > 1
    out = {r.page_id: r.response for r in warc.captures(records).collect() if r.page_id != 7}
    assert len(out) == 5 and {i: r.refers_to for i, r in out.items()} == {4: 2, 2: None, 9: 2, 8: 7, 1: None}
    assert out[4].refers_to_record == out[9].refers_to_record == out[2].record_id and out[8].refers_to_record is None


def test_archives_of_other_writers(spark, tmp_path):
    plain = [
        (["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:0>"], b"software: x\r\n"),
        (["WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a/"], b"HTTP/1.1 200 OK\r\n\r\nbody"),
        (["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:2>", "WARC-Refers-To: <urn:uuid:1>", "WARC-Payload-Digest: sha1:ABC"], b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        (["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3>"], b""),
        (["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:4>", "WARC-Concurrent-To: <urn:uuid:1>"], b"page-id: none\r\nvia: http://b/\r\n"),
        (["WARC-Type: request", "WARC-Record-ID: <urn:uuid:5>", "WARC-Concurrent-To: <urn:uuid:9>"], b"\xff\xfe"),
        (["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:6>"], b"abc"),
    ]
    raw = b"".join("\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n" for lines, body in plain)
    stores.put(f"{tmp_path}/foreign.warc", raw)
    records = warc.read_records(spark.createDataFrame([(f"{tmp_path}/foreign.warc",)], "path string"))
    assert records.count() == 7
    out = {r.capture_id: r for r in warc.captures(records).collect()}
    assert set(out) == {"urn:uuid:1", "urn:uuid:2", "urn:uuid:3", "urn:uuid:9"}
    assert bytes(out["urn:uuid:1"].response.payload) == b"body" and out["urn:uuid:1"].page_id is None and out["urn:uuid:9"].response is None
    second = out["urn:uuid:2"].response
    assert (second.refers_to_record, second.payload_digest, second.payload_bytes, second.refers_to) == ("urn:uuid:1", "sha1:ABC", None, None)


def test_files_appear_whole(tmp_path):
    stores.put(f"file:{tmp_path}/a/b", b"abc")
    assert stores.get(f"file://{tmp_path}/a/b", 1, 1) == b"b" and [p.name for p in (tmp_path / "a").iterdir()] == ["b"]


def test_stages_keep_the_columns(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            assert name == "tokens" or out.columns == docs.columns
            known = {tuple(r) for r in given.collect()}
            assert name == "tokens" or {tuple(r) for r in rows} <= known
            assert name != "tokens" or len(rows) == given.count()
