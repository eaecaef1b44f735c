"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import textkit
from tallyweave.llm.shared import written

SAMPLE = 2_000  # labelled documents per language that the classifiers learn from
GRAMS = (2, 4)  # bytes
SLOTS = 1 << 16  # per gram length; two bytes have their own, longer grams are hashed
SMOOTHING = 0.5
# An answer is ambiguous if the second-nearest codeword is nearer, relatively, than this share of what one in a thousand of the right
# answers on the sample stays below, or the nearest one farther than this multiple of what one in a thousand exceeds.
RARE, GAP_SHARE, REACH = 0.001, 0.5, 1.5
EXHAUSTIVE = 7  # languages up to which codes have all different splits as bits
UNKNOWN = "und"
TEXT_AT_ONCE = 1 << 18  # bytes whose grams are looked at together; they take some forty times as much


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per language; all splits for a few languages, else the best of some random codes.

    For few languages every way of splitting them in two is a bit, which gives each pair of
    codewords the same distance. For many, rows of 10 log2 n random bits are drawn and those with
    the greatest least distance are kept.
    """
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    random, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, found = -1, None
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (languages, bits))
        if (np.abs(code.sum(axis=0)) == languages).any():
            continue
        apart = (bits - code.astype(int) @ code.T) // 2
        least = apart[~np.eye(languages, dtype=bool)].min()
        if least > best:
            best, found = least, code
    return found


def slots(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """A slot for the gram that begins at each byte; ``SLOTS`` where it leaves the row or holds two blanks in turn."""
    n = len(data)
    out = np.full(n, SLOTS, np.int32)
    if n < length:
        return out
    gram = np.zeros(n - length + 1, np.uint64)
    for i in range(length):
        gram |= data[i : n - length + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    if length > 2:
        gram = textkit.mix(gram) >> np.uint64(48)
    out[: len(gram)] = gram
    blank = data == 0x20
    double = np.zeros(n, bool)
    double[:-1] = blank[:-1] & blank[1:]
    for i in range(length - 1):
        out[: n - i][double[i:]] = SLOTS
    ends = offsets[1:]
    for i in range(1, length):
        at = ends - i
        out[at[(at >= offsets[:-1])]] = SLOTS
    return out


# Bytes of lower-cased text as classifiers see them: letters and all beyond ASCII, else a blank.
SEEN = np.full(256, 0x20, np.uint8)
SEEN[0x61:0x7B] = np.arange(0x61, 0x7B)
SEEN[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Model:
    """Languages, their codewords, log-odds per gram length (slot, bit), margins' scale per bit, trust per (language, bit)."""

    languages: list[str]
    code: np.ndarray
    odds: dict[int, np.ndarray]
    scale: np.ndarray
    trust: np.ndarray
    gap: float = 0.0  # least relative distance between the nearest codeword and the next of a sure answer
    reach: float = np.inf  # greatest distance of a sure answer

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean log-odds of each row's grams, per bit: the binary classifiers' answers."""
        data, n = SEEN[data], len(offsets) - 1
        total, seen = np.zeros((n, self.code.shape[1]), np.float64), np.zeros(n, np.int64)
        for length, odds in self.odds.items():
            slot = slots(data, offsets, length)
            full = np.flatnonzero(np.diff(offsets))
            for bit in range(odds.shape[1] if len(full) else 0):  # in turn, so that memory does not grow with the bits
                total[full, bit] += np.add.reduceat(odds[:, bit][slot], offsets[:-1][full], dtype=np.float64)
            seen += textkit.row_sums((slot < SLOTS).astype(np.int64), offsets)
        return total / np.maximum(seen, 1)[:, None]

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row from each codeword: exponential loss of the margins, by trust."""
        agree = (margins * self.scale)[:, None, :] * self.code[None, :, :]
        return (np.exp(-np.clip(agree, -30, 30)) * self.trust).sum(axis=2)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share of the softmax over negative distances, and ambiguity."""
        if self.code.shape[0] < 2:
            return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.zeros(len(margins), bool)
        away = self.distances(margins)
        best = away.argmin(axis=1)
        two = np.partition(away, 1, axis=1)[:, :2]
        soft = np.exp(two[:, :1] - away)
        return best, 1 / soft.sum(axis=1), ((two[:, 1] - two[:, 0]) < self.gap * two[:, 1]) | (two[:, 0] > self.reach)


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {g: np.zeros((len(languages), SLOTS), np.int64) for g in GRAMS}
        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last in textkit.groups(offsets, TEXT_AT_ONCE):
                own = offsets[first : last + 1]
                seen = SEEN[data[own[0] : own[-1]]]
                row = np.repeat(which[first:last], np.diff(own))
                for g in GRAMS:
                    slot = slots(seen, own - own[0], g)
                    fine = slot < SLOTS
                    counts[g] += np.bincount(row[fine] * SLOTS + slot[fine], minlength=len(languages) * SLOTS).reshape(-1, SLOTS)
            textkit.trim()
        for g, table in counts.items():
            which, slot = np.nonzero(table)
            yield pa.record_batch({"gram": pa.array(np.full(len(slot), g), pa.int32()), "lang": pa.array(which, pa.int32()), "slot": pa.array(slot, pa.int32()), "n": pa.array(table[which, slot], pa.int64())})

    return run


def _seen(text):
    """Lower-cased text between blanks."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" "))


def _trusted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(model.value.languages)}
        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last in textkit.groups(offsets, TEXT_AT_ONCE):
                own = offsets[first : last + 1]
                margins = model.value.margins(data[own[0] : own[-1]], own - own[0])
                right = margins * model.value.code[which[first:last]] > 0
                row, bit = np.indices(right.shape)
                yield pa.record_batch({"lang": pa.array(which[first:last][row.ravel()], pa.int32()), "bit": pa.array(bit.ravel(), pa.int32()), "right": pa.array(right.ravel().astype(np.int64)), "size": pa.array(np.abs(margins).ravel())})
            textkit.trim()

    return run


def _sure(model):
    """The relative gap and the distance of the rows that are answered rightly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(model.value.languages)}
        for batch in batches:
            data, offsets = textkit.bytes_of(batch.column("text"))
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, last in textkit.groups(offsets, TEXT_AT_ONCE):
                own = offsets[first : last + 1]
                away = model.value.distances(model.value.margins(data[own[0] : own[-1]], own - own[0]))
                two = np.partition(away, 1, axis=1)[:, :2]
                right = away.argmin(axis=1) == which[first:last]
                yield pa.record_batch({"gap": pa.array(((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-300))[right]), "away": pa.array(two[right, 0])})
            textkit.trim()

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows (text, lang) with a language; null texts and languages are left out.

    At most ``sample`` rows per language, the lowest by a hash of their text and, where there is one,
    doc_id, are learned from (of rows that repeat as many as stand there, up to that bound): the counts of their grams give each bit's log-odds between the
    languages on its two sides, every language weighing the same. How often a bit's classifier
    is right for a language on the sample is its trust there. Right answers on the sample also say how near the second codeword
    may come, and how far the nearest may be, for an answer to be sure.

    Up to seven languages have all splits as bits and decoding tells any two apart by as many of them; more
    languages have random codes, whose least distance differs from pair to pair.
    """
    spark = labelled.sparkSession
    known = labelled.filter("text is not null and lang is not null")
    place = F.xxhash64(*[c for c in ("text", "doc_id") if c in labelled.columns])
    rows = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (place / float(1 << 64) + 0.5).alias("_h"))
    # About twice as many different rows as are wanted are looked at, so that no language is sorted as a whole; rows that
    # repeat share a hash and are one row with its number, before and after the shuffle.
    share = {r["lang"]: 2.0 * sample / max(r["n"], 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()}
    near = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang")), F.lit(0.0)) if share else F.lit(0.0)
    few = rows.filter(F.col("_h") < near).groupBy("lang", "_h").agg(F.count("*").alias("n"), F.any_value("text").alias("text"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("take", F.least("n", sample - before)).filter("take > 0").select("lang", _seen(F.col("text")).alias("text"), "take")
    rows = written(few.select("lang", "text", F.explode(F.array_repeat(F.lit(1), F.col("take").cast("int")))).select("lang", "text"), "sample")
    languages = sorted(share)
    code = codewords(len(languages))
    model = Model(languages, code, {}, np.ones(code.shape[1]), np.ones(code.shape))
    if len(languages) < 2:
        return model
    counts = rows.mapInArrow(_count(languages), "gram int, lang int, slot int, n bigint").groupBy("gram", "lang", "slot").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most a row per gram length, language and slot
    columns = [table.column(c).to_numpy() for c in ("gram", "lang", "slot", "n")]
    for g in GRAMS:
        own = columns[0] == g
        seen = np.zeros((len(languages), SLOTS))
        seen[columns[1][own], columns[2][own]] = columns[3][own]
        share = (seen + SMOOTHING) / (seen + SMOOTHING).sum(axis=1, keepdims=True)
        odds = np.zeros((SLOTS + 1, code.shape[1]), np.float32, order="F")  # a bit's values side by side
        for b in range(code.shape[1]):
            odds[:-1, b] = np.log(share[code[:, b] > 0].mean(axis=0) / share[code[:, b] < 0].mean(axis=0))
        model.odds[g] = odds
    shared = spark.sparkContext.broadcast(model)
    right = rows.mapInArrow(_trusted(shared), "lang int, bit int, right bigint, size double").groupBy("lang", "bit").agg(F.avg("right").alias("right"), F.avg("size").alias("size"))
    sizes = np.zeros(code.shape)
    for r in right.collect():  # one row per language and bit
        model.trust[r["lang"], r["bit"]], sizes[r["lang"], r["bit"]] = r["right"], r["size"]
    model.trust = np.maximum(model.trust, 1e-6) / np.maximum(model.trust, 1e-6).sum(axis=1, keepdims=True)
    model.scale = 2 / np.maximum(sizes.mean(axis=0), 1e-9)
    shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    sure = rows.mapInArrow(_sure(shared), "gap double, away double")
    gap, away = sure.agg(F.percentile_approx("gap", RARE, 10_000), F.percentile_approx("away", 1 - RARE, 10_000)).first()
    shared.unpersist()
    if gap is not None:
        model.gap, model.reach = GAP_SHARE * gap, REACH * away
    return model


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """Documents with ``lang_pred``, ``score`` and ``ambiguous``, from the whole of ``text``; columns of these names are replaced.

    ``lang_pred`` is the language with the nearest codeword, ``score`` its share among all (0
    to 1), ``ambiguous`` whether the second-nearest is too near or the nearest too far for a sure answer. Texts that are null or
    without a letter are ``und`` with score 0, as all are if nothing was learned. Each row
    gives a row, in one pass without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pa.Array, lettered: pa.Array) -> pa.Array:
        names = np.array(shared.value.languages, object)
        data, offsets = textkit.bytes_of(text)
        known = lettered.to_numpy(zero_copy_only=False).astype(bool) & (len(names) > 0)
        best, score, unsure = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        for first, last in textkit.groups(offsets, TEXT_AT_ONCE):
            own = offsets[first : last + 1]
            answer = shared.value.decide(shared.value.margins(data[own[0] : own[-1]], own - own[0]))
            for into, values in zip((best, score, unsure), answer, strict=True):
                into.append(values)
        best, score, unsure = (np.concatenate(x) for x in (best, score, unsure))
        textkit.trim()
        said = np.full(len(known), UNKNOWN, object)
        said[known] = names[best[known]] if len(names) else UNKNOWN
        columns = [pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(unsure & known)]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "ambiguous"])

    text = F.col("text").cast("string")
    rows = docs.drop("lang_pred", "score", "ambiguous")
    rows = rows.withColumn("_said", predict(_seen(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_said"], "_said.*")


def recognised(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents (text, lang and more), with their columns, whose text is in a language the codes can tell.

    The codes are learned from the labelled documents themselves; out go those without a letter
    and those whose answer is not sure. The label decides nothing, and a table
    without labels loses only texts without letters. Rows that repeat are kept or left as one; null and empty texts
    go; columns of any name stay as they are; an empty table gives none.
    """
    model = fit(docs, sample)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return tagged(plain, model).filter(lettered & ~F.col("ambiguous")).select("_row.*")
