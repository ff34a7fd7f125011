"""Quality rules with thresholds that adapt to each language and source, by mergeable quantile sketches.

A sketch counts a metric's values in buckets of relative width (log buckets, a bucket for zero), so that sketches of
any groups merge by adding counts, and a quantile is off by `error` at most. Every language and source has its own
sketches; those of fewer than `enough` rows are merged to their language's, and these to the whole corpus's if need be.
From the quartiles come fences, Q3 + reach * (Q3 - Q1) + slack and, for word length, the one below too. Rows are then
joined with the fences of their group. Rows that fail the base rules feed no sketch.

Everything is DataFrame functions. The sketches have at most groups x metrics x buckets rows, whatever the input.

Null and blank texts have no words, so they fail the base rules. Null languages and sources form groups of their own.
Repeated rows each count and get a row each. Clashing columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, native_words, whole_row

#: Metrics: slack above, and below or None.
METRICS = {"symbol_share": (0.05, None), "dup_line_share": (0.3, None), "word_length": (1.5, 1.5)}
#: Values up to this are in the bucket for zero.
LEAST = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once for a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of that width that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        full = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
        return F.slice(full, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(let(ordered, places), start, step, lambda a: a["n"])

    return let(let(F.transform(words, lambda x: F.xxhash64(x)), windows), lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), 0).otherwise(covered(w)))


def measures(docs: DataFrame) -> DataFrame:
    """docs with a struct column _m: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))

    def of(w: Column) -> Column:
        long = lambda c, name: c.cast("long").alias(name)
        return F.struct(long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"), long(repeated_words(w), "n_repeat_words"))

    return docs.withColumns({"_w": let(native_words(F.col("text")), of), "_l": n_lines, "_s": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")}).withColumn(
        "_m",
        F.struct("_w.n_words", "_w.word_chars", F.col("_s").alias("n_symbols"), (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"), F.col("_l.n").cast("long").alias("n_lines"), "_w.n_repeat_words"),
    ).drop("_w", "_l", "_s")


def _base_failed(m: str) -> Column:
    return F.expr(f"{m}.n_words < 10 OR 100 * {m}.n_repeat_words > 20 * {m}.n_words")


def _values(m: str) -> dict[str, Column]:
    over = lambda a, b: F.expr(f"{m}.{a} / CAST(greatest({m}.{b}, 1) AS DOUBLE)")
    return {"symbol_share": over("n_symbols", "word_chars"), "dup_line_share": over("n_dup_lines", "n_lines"), "word_length": over("word_chars", "n_words")}


def _group(lang: str = "lang", source: str = "source") -> list[Column]:
    """Keys of a group without nulls."""
    return [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in ((lang, "_lang"), (source, "_source"))]


def sketches(measured: DataFrame, error: float = 0.01) -> DataFrame:
    """(_lang, _source, metric, bucket, n) over measured(lang, source, _m)."""
    width = log((1 + error) / (1 - error))
    values = _values("_m")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("x")
    rows = measured.where(~_base_failed("_m")).select(*_group(), pairs)
    bucket = F.when(F.col("x.value") > LEAST, F.ceil(F.ln("x.value") / width)).otherwise(-(1 << 30)).cast("int")
    return rows.groupBy("_lang", "_source", "x.metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, error: float = 0.01, enough: int = 200, reach: float = 3.0) -> DataFrame:
    """One row for each language and source: low and high fences of every metric."""
    growth = (1 + error) / (1 - error)
    levels = []
    for level, keys in enumerate((["_lang", "_source"], ["_lang"], [])):
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "metric")
        upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ranked = merged.withColumns({"upto": upto, "all": F.sum("n").over(w)})
        value = F.when(F.col("bucket") == -(1 << 30), 0.0).otherwise(F.pow(F.lit(growth), F.col("bucket")) * (2 / (1 + growth)))
        quartile = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * q), value))  # noqa: E731,B023
        levels.append(ranked.groupBy(*keys, "metric").agg(F.max("all").alias(f"n{level}"), F.struct(quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).alias(f"q{level}")))
    own, lang, whole = levels
    best = F.when(F.col("n0") >= enough, F.col("q0")).when(F.col("n1") >= enough, F.col("q1")).otherwise(F.col("q2"))
    rows = own.join(lang, ["_lang", "metric"]).join(whole, "metric").select("_lang", "_source", "metric", best.alias("q"))
    spread = F.col("q.q3") - F.col("q.q1")
    cols = []
    for metric, (above, below) in METRICS.items():
        at = F.col("metric") == metric
        cols.append(F.max(F.when(at, F.col("q.q3") + spread * reach + above)).alias(f"_hi_{metric}"))
        if below is not None:
            cols.append(F.max(F.when(at, F.col("q.q1") - spread * reach - below)).alias(f"_lo_{metric}"))
    return rows.groupBy("_lang", "_source").agg(*cols)


def _verdict(m: str) -> Column:
    """True unless a metric is outside its fences; rows of a group without fences pass."""
    ok = F.lit(True)
    for metric, value in _values(m).items():
        ok = ok & F.coalesce(value <= F.col(f"_hi_{metric}"), F.lit(True))
        if METRICS[metric][1] is not None:
            ok = ok & F.coalesce(value >= F.col(f"_lo_{metric}"), F.lit(True))
    return ok


def _learn(docs: DataFrame, scratch: Scratch, measured: DataFrame) -> DataFrame:
    return scratch.write(fences(scratch.write(sketches(measured), sweep=False)), sweep=False)


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang, source): the counts, base_failed and kept."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.write(measures(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "_m"), sweep=False)
    rules = _learn(docs, scratch, measured)
    rows = measured.select("doc_id", "_m", *_group()).join(rules, ["_lang", "_source"], "left")
    failed = _base_failed("_m")
    return rows.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words", failed.alias("base_failed"), (~failed & _verdict("_m")).alias("kept"))


def keep_good(docs: DataFrame, small: int = 20_000) -> DataFrame:
    """The rows of docs that pass, in its columns. Fences are broadcast if there are at most `small` groups.

    Texts are measured once: rows are written with their counts, and the fences are learnt from the counts alone.
    """
    scratch = Scratch(docs.sparkSession)
    measured = scratch.write(measures(docs.select("text", "lang", "source", whole_row(docs).alias("_row"))).select("_row", "lang", "source", "_m"), sweep=False)
    rules = _learn(docs, scratch, measured.select("lang", "source", "_m"))
    if rules.count() <= small:
        rules = F.broadcast(rules)
    rows = measured.select("_row", "_m", *_group()).join(rules, ["_lang", "_source"], "left")
    return rows.where(~_base_failed("_m") & _verdict("_m")).select("_row.*")
