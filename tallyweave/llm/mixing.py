"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, prefix sums to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in code-point order, repeating
SHARE = 1.5  # of all sizes
MOST = 2.0  # times its size that a source may give
SLICES = 4096  # of the key's range; only the slice where the budget ends is sorted
QUALITY = {0: 1.0, 1: 2.0}  # weight of a document by its quality label; 1 without one


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1 that depends on the document's id and a seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source's weight is that of its place in code-point order, null last. Targets are in
    proportion to the weights and add up to ``share`` of all sizes, but none is above
    ``most`` times its source's size: what exceeds that goes to the others by weight.
    With sources in order of cap per weight, those at their cap come first.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    ordered = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rate = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    table = table.withColumn("rate", rate).withColumn("nth", F.row_number().over(ordered))
    level = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("nth", "rate"))).over(whole)
    table = table.withColumn("level", level)
    open_ = F.col("nth") >= F.col("level.nth")
    return table.select("source", "source_size", F.when(open_, F.col("w") * F.col("level.rate")).otherwise(F.col("cap")).alias("target"))


_OWN = ["size", "source_size", "target", "taken", "copies", "_base", "_weight", "_slice", "_tie"]


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    """Documents with their words, a hash of the text and -ln(u)."""
    rows = docs.drop(*[c for c in docs.columns if c in _OWN])
    return rows.withColumn("size", word_count(F.col("text"))).withColumn("_tie", F.xxhash64("text")).withColumn("_base", -F.log(uniform(F.col("doc_id"), seed)))


def _slice_of(weight: Column) -> Column:
    """The slice of a document's key; it never rises with the weight."""
    return F.floor((1 - F.exp(-F.col("_base") / weight)) * SLICES)


def _weighed(rows: DataFrame, quality: Column) -> DataFrame:
    rows = rows.withColumn("_weight", F.when(quality > 0, quality.cast("double")).otherwise(1.0))
    return rows.withColumn("_slice", _slice_of(F.col("_weight")))


def _planned(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source: its target, complete epochs, the words missing then, the slice where they end and the words before it."""
    slices = written(rows.groupBy("source", "_slice").agg(F.sum("size").alias("words")), "slices")
    targets = source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = F.floor(F.col("target") + 0.5)
    goals = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("_rest", F.when(F.col("source_size") > 0, goal - F.col("_epochs") * F.col("source_size")).otherwise(0))
    after = F.sum("words").over(Window.partitionBy("source").orderBy("_slice"))
    reached = slices.withColumn("after", after).join(goals.select(F.col("source").alias("s"), "_rest"), F.col("source").eqNullSafe(F.col("s")))
    # The first slice whose end is not before the budget's, and what is in the slices before it.
    last = reached.filter("after >= _rest").groupBy("s").agg(F.min(F.struct("_slice", (F.col("after") - F.col("words")).alias("_before"))).alias("last"))
    last = last.select(F.col("s").alias("s2"), F.col("last._slice").alias("_end"), F.col("last._before").alias("_before"))
    plan = goals.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_rest", "_end", "_before")
    return written(plan, "targets")  # a row per source; Spark sees its size before it joins


def _given(rows: DataFrame) -> DataFrame:
    """What the last epoch takes of rows that know their slice and their source's plan; all rows of the slice where a budget ends must be there."""
    edge = rows.filter(F.col("_slice") == F.col("_end"))
    order = Window.partitionBy("_source", "_slice").orderBy(F.col("_base") / F.col("_weight"), "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_given", F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(order), F.lit(0)))))
    others = rows.filter(~F.col("_slice").eqNullSafe(F.col("_end"))).withColumn("_given", F.when(F.col("_slice") < F.col("_end"), F.col("size")).otherwise(0))
    return others.unionByName(edge)


def _taken(rows: DataFrame) -> DataFrame:
    taken = (F.col("_epochs") * F.col("size") + F.col("_given")).cast("bigint")
    copies = (F.col("_epochs") + F.when((F.col("_given") > 0) & (F.col("_given") * 2 >= F.col("size")), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("taken", taken).withColumn("copies", copies)
    return rows.drop("_base", "_weight", "_slice", "_tie", "_source", "_epochs", "_rest", "_end", "_before", "_given")


def mixed(docs: DataFrame, quality: Column | None = None, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Documents (doc_id, text, source and more) with what a mix takes of each.

    Adds ``size`` (words), ``source_size``, ``target``, ``taken`` (words, repeats counted) and
    ``copies`` (whole documents: complete epochs, and one more where at least half of the
    last one is taken). Every document is taken as often as its source's size fits its target
    completely; the words still missing are taken in ascending order of -ln(u) / quality, u
    depending on doc_id and ``seed``, ties by doc_id, size and text. The document at which
    the budget ends gives only the words that are missing, so each source meets its
    rounded target exactly; no document gives more than ``most`` times its size.

    Only sums per source and slice of the key's range are gathered; of each source just the
    slice in which its budget ends is sorted. Columns of these names in the input are
    replaced. ``quality`` is a positive column, by default 1 (null or not positive: 1).
    Null texts have size 0; null sources form one source, null ids count as an empty id;
    repeated rows are documents of their own. An empty table gives no rows.
    """
    rows = _weighed(_measured(docs, seed), F.lit(1.0) if quality is None else quality)
    plan = _planned(rows, weights, share, most)
    return _taken(_given(rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))))


def mixed_by_labels(
    docs: DataFrame, qualities: DataFrame, with_rows: bool = True, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """As ``mixed``, weighing documents by ``qualities`` (doc_id, _quality; an id once), which are a table of their own.

    Only ids, sources and sizes are joined to it. Without ``with_rows`` these are all that
    is returned. With it, a text moves only where its label decides: rows that the last epoch takes
    at the least weight of all, or leaves at the greatest, are settled where they are.
    """
    rows = _measured(docs.drop("_quality"), seed)
    narrow = rows.select("doc_id", "source", "size", "_tie", "_base").join(qualities, "doc_id", "left")
    narrow = written(_weighed(narrow, F.col("_quality")).drop("_quality"), "sizes")
    plan = _planned(narrow, weights, share, most)
    if not with_rows:
        return _taken(_given(narrow.join(plan, narrow["source"].eqNullSafe(plan["_source"]))))
    least, greatest = narrow.agg(F.min("_weight"), F.max("_weight")).first()
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]))
    taken = F.coalesce(_slice_of(F.lit(least)) < F.col("_end"), F.lit(False))
    left = F.coalesce(_slice_of(F.lit(greatest)) > F.col("_end"), F.lit(True))
    settled = rows.filter(taken | left).withColumn("_given", F.when(taken, F.col("size")).otherwise(0))
    unsettled = _weighed(rows.filter(~(taken | left)).join(qualities.hint("shuffle_hash"), "doc_id", "left"), F.col("_quality")).drop("_quality")
    return _taken(settled).unionByName(_taken(_given(unsettled)))


def quality_of(labels: DataFrame) -> DataFrame:
    """(doc_id, quality weight) from labels; of several labels for one document the best counts."""
    pairs = [x for k, v in QUALITY.items() for x in (F.lit(k), F.lit(v))]
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("q"))
    return best.select("doc_id", F.element_at(F.create_map(*pairs), F.col("q")).alias("_quality"))
