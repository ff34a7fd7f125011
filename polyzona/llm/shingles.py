"""Near copies by shingles: SimHash and MinHash find candidates, the exact Jaccard similarity of shingle sets decides.

Texts are lower-cased (A-Z) and cut into words as for SimHash; a text of fewer than `width` words is one shingle, texts
without words are copies of each other. Texts of the same words are one sequence, and what follows is on sequences.

Candidates come from two searches, made from one pass over the texts. SimHash fingerprints of the shingles, within
`budget` bits by the trie self-join, find copies that differ in a word or two. Two bits are too few for a similarity of
0.8, where some ten of 64 bits differ and no trie can prune, so BANDS bands of ROWS MinHash values follow: a pair of
similarity 0.8 shares one with probability 0.99997. In each bucket every sequence is compared with one, its heart: that
which is in the largest buckets, and so in the middle of its group. That is one pair a sequence and band, however large
the group. Once these pairs are linked, only sequences of different groups are of interest: in buckets of up to `crowd`
sequences all pairs of these, in larger ones whoever is not in the largest group of its bucket against all members of
such buckets, so a link is never lost: shingles are ordered from rare to common, and of two sets as similar as asked for,
the first ones (as many as their sizes leave room for) have one in common. What is unique to a text comes first and
meets nothing. Both searches drop pairs that cannot be similar before these become rows, by their sizes and by bit maps
of their shingles: a bit in which two maps differ is a shingle that one set has alone, so no similar pair is dropped.

Null texts count as empty, null ids take part and sort as the largest. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, buffers, find_words, lean, mixed, signed, slices, whole_row, word_hashes
from .components import connected_components
from .simhash import links as trie_links
from .simhash import majority

BANDS, ROWS = 20, 4
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SEEDS = mixed(np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(7000))
_XOR, _ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)


def _shingled(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, hashes of the word sequences, hashes of the shingles, and where each row's shingles start."""
    of_words = Rolling(77)
    data, off = buffers(batch.column("text"))
    for i, j in slices(off, 1 << 20):
        piece = _LOWER[data[off[i] : off[j]]]
        starts, ends, row = find_words(piece, off[i : j + 1] - off[i])
        prefix = of_words.prefix(word_hashes(piece, starts, ends))
        where = np.searchsorted(row, np.arange(j - i + 1))
        n = np.diff(where)
        counts = np.maximum(n - width + 1, 1)
        edges = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(where[:-1], counts) + np.arange(edges[-1]) - np.repeat(edges[:-1], counts)
        last = np.minimum(first + width, np.repeat(where[1:], counts))
        whole = mixed(of_words.of(prefix, where[:-1], where[1:]) + n.astype(np.uint64))
        yield i, j, whole, of_words.of(prefix, first, last), edges


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, whole, values, edges in _shingled(batch, width):
                low = values.astype(np.uint32)
                bands = np.zeros((j - i, BANDS), np.uint64)
                for k in range(BANDS * ROWS):
                    least = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], edges[:-1]).astype(np.uint64)
                    bands[:, k // ROWS] = mixed(bands[:, k // ROWS] + least)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), signed(bands.reshape(-1)))
                rest = [c for c in batch.schema.names if c != "text"]
                prints = majority(values, np.diff(edges))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), signed(whole), signed(prints), lists], names=[*rest, "seq", "fp", "bands"])

    return lean(run)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, values, edges in _shingled(batch, width):
                each = [np.unique(values[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                ends = np.concatenate([[0], np.cumsum([len(e) for e in each])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([batch.column("seq").slice(i, j - i), lists], names=["seq", "shingles"])

    return lean(run)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set its size and a map of two to four bits a shingle, one set for each value of a shingle's lowest bits."""
    for batch in batches:
        lists = batch.column("shingles")
        n = np.diff(lists.offsets.to_numpy())
        words = 1 << np.ceil(np.log2(np.maximum(2 * n, 64) / 64)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(words)])
        values = lists.flatten().to_numpy().view(np.uint64)
        at = values & np.repeat(64 * words - 1, n).astype(np.uint64)
        flags = np.zeros(64 * ends[-1], bool)
        flags[np.repeat(64 * ends[:-1], n) + at.astype(np.int64)] = True
        bits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.packbits(flags, bitorder="little").view("<i8")))
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(n, pa.int32()), bits], names=["seq", "n", "bits"])


def marks(sets: DataFrame) -> DataFrame:
    """(seq, n, bits) of sets(seq, shingles)."""
    return sets.select("seq", "shingles").mapInArrow(lean(_marks), "seq long, n int, bits array<long>")


def may_be_similar(fifths: int, n: str = "n", bits: str = "bits", m: str = "m", other: str = "other_bits") -> str:
    """SQL that is false only for sets whose sizes and maps rule out a similarity of fifths / 5.

    Of similar sets with x and y shingles at most (5 - fifths) * (x + y) / (5 + fifths) are in one alone. Maps of
    sets so alike in size are of one length, or one is folded to its half; if neither helps the pair stays.
    """
    fold = lambda x, y: f"IF(size({x}) <= size({y}), {x}, zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p | q))"
    apart = f"aggregate(zip_with({fold(bits, other)}, {fold(other, bits)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"(5 * least({n}, {m}) >= {fifths} * greatest({n}, {m}) AND coalesce({5 + fifths} * {apart} <= {5 - fifths} * ({n} + {m}), true))"


def close_prints(sequences: DataFrame, scratch: Scratch, budget: int) -> DataFrame:
    """(a, b): pairs of sequences(seq, fp) that connect all whose fingerprints differ in at most budget bits."""
    least = scratch.write(sequences.groupBy("fp").agg(F.min("seq").alias("least")), sweep=False)
    found = scratch.write(trie_links(least.select("fp"), scratch, budget))
    a, b = least.toDF("a", "x"), least.toDF("b", "y")
    across = found.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = sequences.join(least, "fp").where("least < seq").select(F.col("least").alias("a"), F.col("seq").alias("b"))
    return across.union(same)


def candidates(prints: DataFrame, scratch: Scratch, crowd: int = 32) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: pairs of the sequences prints(seq, bands) and the hearts of their buckets; and the buckets' members (key, seq, large)."""
    own = scratch.write(prints.select("seq", F.posexplode("bands").alias("tree", "band")).select(F.xxhash64("tree", "band").alias("key"), "seq"))
    buckets = scratch.write(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), sweep=False)
    member = scratch.write(own.join(buckets, "key"))
    weight = scratch.write(member.groupBy("seq").agg(F.sum("n").alias("weight")), sweep=False)
    hearts = scratch.write(member.join(weight, "seq").groupBy("key").agg(F.max(F.struct("weight", "seq"))["seq"].alias("heart")), sweep=False)
    scratch.drop(own, weight)
    pairs = member.join(hearts, "key").where("seq <> heart").select(F.least("seq", "heart").alias("a"), F.greatest("seq", "heart").alias("b")).distinct()
    return pairs, member.select("key", "seq", F.expr(f"n > {crowd}").alias("large"))


def rooted(member: DataFrame, roots: DataFrame) -> DataFrame:
    """member(key, seq) with the root of each sequence, itself if it has no links."""
    return member.join(roots, member.seq == roots.node, "left").select("key", "seq", F.coalesce("root", "seq").alias("root"))


def between_groups(small: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch, fifths: int) -> DataFrame:
    """(a, b), a < b: pairs that may be similar, of one bucket of small(key, seq) and of two groups."""
    member = rooted(small, roots)
    mixed_ = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    asked = scratch.write(member.join(scratch.write(mixed_, sweep=False), "key"), sweep=False)
    held = scratch.write(asked.join(marks(sets.join(asked.select("seq").distinct(), "seq", "left_semi")), "seq"))
    x, y = held.toDF("a", "key", "r", "n", "bits"), held.toDF("b", "key", "s", "m", "other_bits")
    return x.join(y, (x.key == y.key) & F.expr(f"a < b AND r <> s AND {may_be_similar(fifths)}")).select("a", "b").distinct()


def left_over(large: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch, fifths: int) -> DataFrame:
    """(a, b), a < b: pairs that may be similar, of one not in the largest group of its large bucket and one of another group.

    For sizes x and y, fifths / 5 asks for an overlap of fifths * (x + y) / (5 + fifths) or more. Sizes fall into classes
    5 % wide; an entry is a shingle of a set for one class of partners, if it is among the set's first ones for that class.
    """
    member = rooted(large, roots)
    groups = member.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = scratch.write(groups.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("groups")).where("groups > 1"), sweep=False)
    asked = scratch.write(member.join(main.select("key", "main"), "key").groupBy("seq", "root").agg(F.max(F.expr("root <> main")).alias("left")), sweep=False)
    own = scratch.write(asked.join(sets, "seq").select("seq", "root", "left", "shingles"), sweep=False)
    held = scratch.write(own.select("seq", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), sweep=False)
    common = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    of_one = Window.partitionBy("seq")
    ranked = held.join(common, "shingle").withColumn("rank", F.col("n") - F.count("*").over(of_one) + F.row_number().over(of_one.orderBy("df", "shingle")))
    most = f"(n + 1 - rank) * {(5 + fifths) / fifths} - n"
    classes = f"IF({most} >= n * {fifths / 5}, sequence(CAST(floor(ln(n * {fifths / 5}) / ln(1.05)) AS INT), CAST(floor(ln({most} + 1e-6) / ln(1.05)) AS INT)), array())"
    first = ranked.where(f"{most} >= n * {fifths / 5} AND {most} > 0").join(own.select("seq", "root", "left"), "seq").join(marks(own).drop("n"), "seq")
    entry = scratch.write(first.select("seq", "root", "left", "n", "bits", "shingle", F.expr("CAST(floor(ln(n) / ln(1.05)) AS INT)").alias("own"), F.explode(F.expr(classes)).alias("other")))
    x = entry.where("left").select("shingle", "own", "other", F.col("seq").alias("s"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("bits").alias("other_bits"))
    y = entry.select(F.col("shingle").alias("shingle_"), F.col("own").alias("other_"), F.col("other").alias("own_"), "seq", "root", "n", "bits")
    met = x.join(y, F.expr(f"shingle = shingle_ AND own = own_ AND other = other_ AND r <> root AND {may_be_similar(fifths)}"))
    return met.select(F.least("s", "seq").alias("a"), F.greatest("s", "seq").alias("b")).distinct()


def keep_one(docs: DataFrame, width: int = 5, fifths: int = 4, budget: int = 2) -> DataFrame:
    """docs with one row of each group linked by a Jaccard similarity of fifths / 5 or more, that of the least doc_id.

    Of several rows with the least doc_id, one with the least hash of its text, then the least text, stays.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ident = [F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64(text).alias("_hash")]
    rows = docs.select(*ident, text.alias("text"), whole_row(docs).alias("_row"))
    prints = scratch.write(rows.select("_null", "_id", "_hash", "text").mapInArrow(_sketches(width), "_null boolean, _id long, _hash long, seq long, fp long, bands array<long>"))
    sequences = scratch.write(prints.groupBy("seq").agg(F.min(F.struct("_null", "_id", "_hash")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    scratch.drop(prints)
    found, member = candidates(sequences.select("seq", "bands"), scratch)
    pairs = scratch.write(found.union(close_prints(sequences.select("seq", "fp"), scratch, budget)).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("seq")).distinct().join(sequences.select("seq", "first.*"), "seq")
    # Rows of one id and hash have one text.
    texts = rows.select("_null", "_id", "_hash", "text").join(asked, ["_null", "_id", "_hash"]).select("seq", "text")
    sets = scratch.write(texts.mapInArrow(_sets(width), "seq long, shingles array<long>").dropDuplicates(["seq"]))

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b").select("a", "b", F.size("p").alias("x"), F.size("q").alias("y"), F.size(F.array_intersect("p", "q")).alias("common"))
        return scratch.write(both.where(f"5 * common >= {fifths} * (x + y - common)").select("a", "b"))

    links = linked(pairs)
    roots = scratch.write(connected_components(links, scratch), sweep=False)
    rest = between_groups(member.where("NOT large"), roots, sets, scratch, fifths)
    large = member.where("large")
    if not large.isEmpty():
        rest = rest.union(left_over(large.select("key", "seq"), roots, sets, scratch, fifths))
    more = linked(scratch.write(rest.distinct().join(pairs, ["a", "b"], "left_anti")))
    if not more.isEmpty():
        roots = scratch.write(connected_components(links.union(more), scratch), sweep=False)
    named = sequences.join(roots, sequences.seq == roots.node, "left").select("first", F.coalesce("root", "seq").alias("root"))
    stays = named.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    place = F.row_number().over(Window.partitionBy("_null", "_id", "_hash").orderBy("text"))
    return rows.join(stays, ["_null", "_id", "_hash"]).withColumn("_place", place).where("_place = 1").select("_row.*")
