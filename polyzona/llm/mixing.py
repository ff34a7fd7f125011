"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each source's share of the mix is its weight's share of all sizes, at most `epochs` times the source's own size; what a
source cannot give is shared anew by weight among the rest until none is above its limit. Within a source every row
gets a random key from a hash of its id; rows are taken in key order, whole epochs first, and the last epoch is cut
where the source's budget ends. A row is taken whole: the one that straddles the cut is taken if at least half of it fits.

The cut is found by prefix sums. A source's keys are cut into ranges of some `aim` rows, as many as its number of rows
asks for; the ranges' sums are small rows, and their prefix sums tell the one range in which the budget ends. Rows of
the ranges before it are taken, those after it are not, and only the rows of that one range are sorted and summed one by
one. So what is shuffled does not grow with texts, and a source with a third of all rows has a third of the ranges.

The null source is a source of its own, after all others. Null texts have size 0. Repeated rows each count; rows that
agree in id, size and text are interchangeable. Columns of the input whose names clash with the result's are replaced by
these. An empty table gives an empty result, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, native_words, quoted, whole_row

#: Bits of a row's key that ranges are made of.
KEY_BITS = 40


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = 3) -> DataFrame:
    """totals(source, source_size, ...), one row a source, with its target.

    Weights repeat over the sources by code point, null last. Sources reach their limits in the order of limit to weight;
    from the first one that does not, what is left is shared by weight.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    known = totals.withColumn("_w", w.cast("double")).withColumn("_most", F.col("source_size") * float(epochs))
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").asc_nulls_last())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = known.select(
        "*",
        F.row_number().over(order).alias("_pos"),
        (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("_most").over(above), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(above), F.lit(0.0))).alias("_weight"),
    )
    fits = F.col("_left") * F.col("_w") / F.col("_weight") < F.col("_most")
    first = ranked.withColumn("_cut", F.min(F.when(fits, F.struct("_pos", "_left", "_weight"))).over(whole))
    limited = F.col("_cut").isNull() | (F.col("_pos") < F.col("_cut._pos"))
    return first.select(*totals.columns, F.when(limited, F.col("_most")).otherwise(F.col("_cut._left") * F.col("_w") / F.col("_cut._weight")).alias("target"))


def _key(seed: int) -> Column:
    """A row's random key: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))


def _range(bits: str) -> Column:
    return F.expr(f"shiftright(CAST(conv(substring(_key, 1, {KEY_BITS // 4}), 16, 10) AS BIGINT), {KEY_BITS} - {bits})")


def plan(docs: DataFrame, scratch: Scratch, seed: int, weights: tuple[int, ...], share: float, epochs: int, aim: int) -> DataFrame:
    """One row a source: its name, size, target, whole epochs, budget of the last one, bits of its ranges, and the range
    in which the budget ends with the sum of those before it (null: none)."""
    sized = scratch.write(docs.select(F.col("source").alias("source"), _key(seed).alias("_key"), F.size(native_words(F.col("text"))).cast("long").alias("size")), sweep=False)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    bits = F.expr(f"least({KEY_BITS}, greatest(0, CAST(ceil(log2(n / {float(aim)})) AS INT)))")
    whole = F.expr("IF(source_size > 0, CAST(floor(target / source_size) AS BIGINT), 0L)")
    known = targets(totals, weights, share, epochs).withColumns({"bits": bits, "epochs": whole}).withColumn("budget", F.expr("CAST(floor(target) AS BIGINT) - epochs * source_size"))
    known = scratch.write(known.withColumn("_source", _name()).drop("n"), sweep=False)
    parts = sized.withColumn("_source", _name()).join(_small(known.select("_source", "bits")), "_source").groupBy("_source", _range("bits").alias("_range")).agg(F.sum("size").alias("part"))
    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.withColumn("before", F.coalesce(F.sum("part").over(upto), F.lit(0)))
    cut = sums.join(known.select("_source", "budget"), "_source").where("before <= budget AND budget < before + part").select("_source", F.col("_range").alias("cut"), "before")
    return scratch.write(known.join(cut, "_source", "left"))


def _name() -> Column:
    """A source's name without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))


def _small(known: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast if there are at most that many sources; a shuffle join, whose hot keys Spark splits, if there are more."""
    return F.broadcast(known) if known.count() <= most else known


def _decide(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """rows(doc_id, source, text, _row) with the plan's columns and times, how often a row is taken."""
    keyed = rows.withColumns({"_key": _key(seed), "_source": _name()}).drop("source").join(_small(known.drop("source")), "_source").withColumn("_range", _range("bits"))
    # A source whose budget ends in no range takes all of its rows once more, or none if there is nothing left to take.
    early = F.when(F.col("cut").isNotNull(), F.col("_range") < F.col("cut")).otherwise(F.col("budget") >= F.col("source_size"))
    plain = keyed.where("cut IS NULL OR _range <> cut").withColumn("times", F.col("epochs") + early.cast("long"))
    size = F.size(native_words(F.col("text"))).cast("long")
    inside = F.sum("_size").over(Window.partitionBy("_source").orderBy("_key", "doc_id", "_size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    last = keyed.where("_range = cut").withColumn("_size", size).withColumn("_inside", F.coalesce(inside, F.lit(0)))
    fits = (F.col("before") + F.col("_inside")) * 2 + F.col("_size") <= F.col("budget") * 2
    return plain.unionByName(last.withColumn("times", F.col("epochs") + fits.cast("long")).drop("_size", "_inside"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = 3, aim: int = 1000) -> DataFrame:
    """docs(doc_id, source, text, ...) with size, source_size, target and taken (words taken, repeats counted)."""
    made = ("size", "source_size", "target", "taken")
    known = plan(docs, Scratch(docs.sparkSession), seed, weights, share, epochs, aim)
    rows = _decide(docs.select("doc_id", "source", "text", whole_row(docs.drop(*made)).alias("_row")), known, seed)
    size = F.size(native_words(F.col("text"))).cast("long")
    kept = [F.col(f"_row.{quoted(c)}") for c in docs.columns if c not in made]
    return rows.withColumn("_size", size).select(*kept, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("times")).alias("taken"))


def draw(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = 3, aim: int = 1000) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, in the columns of docs; rows without words go."""
    known = plan(docs, Scratch(docs.sparkSession), seed, weights, share, epochs, aim)
    rows = _decide(docs.select("doc_id", "source", "text", whole_row(docs).alias("_row")), known, seed)
    with_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where((F.col("times") > 0) & with_words).select("_row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("_row.*")
