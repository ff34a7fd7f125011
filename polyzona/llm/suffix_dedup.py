"""Removal of byte strings that occur twice, by a content-defined cover of sampled positions.

Every byte covered by a string of `length` bytes that also starts anywhere else is removed, in the same document too.

A difference cover is a set of sampled positions such that two suffixes always have samples at one common offset. Here
the cover follows the content: the sample of position p is the first least hash of `gram` bytes among the `reach`
positions from p on. Equal strings then have their samples at equal offsets, and one sample serves a run of
neighbouring positions, of which there are about 64. As in the recursive algorithm, samples are named by what follows
them, names that occur once are dropped, the remaining suffixes are merged in by what stands between them and their
sample, and equal neighbours are compared:

1. samples are named by the bytes after them that all strings of `passage` bytes with this sample have in common; names
   found once go. What is left is a result of its own (n_passage: bytes under such names): every string of `passage`
   bytes that occurs elsewhere has one, and many passages that repeat are shorter than `length`;
2. samples are named by the bytes that all strings of `length` bytes have in common; names found once go;
3. runs of positions are named by all the bytes of their strings; runs of the same name are repeats as a whole;
4. of names from step 2 with a run that is left, that run and one run for each name of step 3 are taken byte by byte:
   strings of equal name are repeats.

With `triples`, step 4 is done by a difference cover of triples (difference_cover.py) instead; the registered query does
without, see the README for figures. Names in steps 3 and 4 have 128 bits, so that 10**12 of them give no false match; those of
the steps before have 64 bits and decide what is looked at, and n_passage.

Null texts are empty; texts shorter than `length` keep all. Rows are known by a hash of doc_id and text: equal rows are
occurrences of their own, and share their result. Bytes that are left are hashed, or returned, as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, buffers, lean, mixed, signed, slices
from .difference_cover import equal_starts

REACH, GRAM = 128, 32
_SYMBOL = mixed(np.arange(256, dtype=np.uint64) + np.uint64(5000))
_SECOND = Rolling(401)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by block-wise running minima from both sides."""
    n = len(x)
    if n < width:
        return x[:0]
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Strings:
    """Samples and names of the strings of one slice of texts."""

    def __init__(self, piece: np.ndarray, off: np.ndarray, length: int, passage: int, rolling: Rolling):
        self.length, self.passage, self.rolling = length, passage, rolling
        self.prefix, self.second = rolling.prefix(_SYMBOL[piece]), _SECOND.prefix(_SYMBOL[piece])
        self.ends = np.repeat(off[1:], np.diff(off))
        n = max(len(piece) - passage + 1, 0)
        self.whole = np.arange(n) + passage <= self.ends[:n]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first and last position of each run of positions with one sample, and the sample."""
        p, down = self.prefix, self.rolling.down
        grams = mixed((p[GRAM:] - p[:-GRAM]) * down[: len(p) - GRAM]) if len(p) > GRAM else p[:0]
        least = sliding_min(grams, REACH)[: len(self.whole)]
        if not self.whole.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        new = self.whole.copy()
        new[1:] &= ~self.whole[:-1] | (least[1:] != least[:-1])
        last = self.whole.copy()
        last[:-1] &= ~self.whole[1:] | (least[1:] != least[:-1])
        lo, hi, out = np.flatnonzero(new), np.flatnonzero(last), []
        while len(lo):
            want, at = least[lo], np.full(len(lo), -1)
            left = np.arange(len(lo))
            for t in range(REACH):
                hit = grams[lo[left] + t] == want[left]
                at[left[hit]] = lo[left[hit]] + t
                left = left[~hit]
                if not len(left):
                    break
            out.append((lo, np.minimum(hi, at), at))
            more = at < hi  # the same hash once more: positions after it have the next one as their sample
            lo, hi = at[more] + 1, hi[more]
        return tuple(np.concatenate(x) for x in zip(*out))

    def near(self, at: np.ndarray) -> np.ndarray:
        """Names of step 1."""
        return self.rolling.of(self.prefix, at, at + self.passage - REACH + 1)

    def names(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The name of step 2, and both halves of that of step 3."""
        shape = ((at - lo) * 1024 + (hi - lo)).astype(np.uint64)
        return [self.rolling.of(self.prefix, at, at + self.length - REACH + 1), *(mixed(r.of(p, lo, hi + self.length) + shape) for r, p in self._both())]

    def hashes(self, at: np.ndarray) -> list[np.ndarray]:
        return [r.of(p, at, at + self.length) for r, p in self._both()]

    def _both(self) -> tuple:
        return (self.rolling, self.prefix), (_SECOND, self.second)


def _pieces(batch: pa.RecordBatch, length: int, passage: int, rolling: Rolling) -> Iterator[tuple]:
    data, off = buffers(batch.column("text"))
    for i, j in slices(off):
        own, piece = off[i : j + 1] - off[i], data[off[i] : off[j]]
        yield i, j, own, piece, Strings(piece, own, length, passage, rolling)


def _near(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(400)
        for batch in batches:
            for *_, strings in _pieces(batch, length, passage, rolling):
                yield pa.RecordBatch.from_arrays([signed(strings.near(strings.runs()[2]))], names=["near"])

    return lean(run)


def _runs(length: int, passage: int):
    """Runs with their names; hi is less than lo where no string of `length` bytes fits in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(400)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, _, own, _, strings in _pieces(batch, length, passage, rolling):
                lo, hi, at = strings.runs()
                hi = np.maximum(np.minimum(hi, strings.ends[lo] - length), lo - 1)
                fits, names = np.flatnonzero(hi >= lo), [np.zeros(len(lo), np.uint64) for _ in range(3)]
                for to, values in zip(names, strings.names(lo[fits], hi[fits], at[fits])):
                    to[fits] = values
                row = np.searchsorted(own, lo, "right") - 1
                places = [pa.array((x - own[row]).astype(np.int32)) for x in (lo, hi, at)]
                yield pa.RecordBatch.from_arrays([signed(strings.near(at)), *map(signed, names), pa.array(keys[i + row]), *places], names=["near", "short", "long", "long2", "key", "lo", "hi", "at"])

    return lean(run)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of int lists, nulls being empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _strings(length: int):
    """Hashes of all strings of the runs in lo, hi; found says whether the run's positions are to be decided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(400)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            lo, where = _lists(batch.column("lo"))
            hi, _ = _lists(batch.column("hi"))
            for i, j, own, _, strings in _pieces(batch, length, length, rolling):
                a, b = where[i], where[j]
                n = hi[a:b] - lo[a:b] + 1
                run_of = np.repeat(np.arange(b - a), n)
                row = np.repeat(np.arange(j - i), np.diff(where[i : j + 1]))[run_of]
                at = lo[a:b][run_of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                values = strings.hashes(at + own[row])
                yield pa.RecordBatch.from_arrays([*map(signed, values), pa.array(keys[i + row]), pa.array(at.astype(np.int32))], names=["name", "name2", "key", "at"])

    return lean(run)


def _covered(n: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes are covered by strings that start at lo .. hi."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _mark(length: int, under: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            (lo, where), (hi, _) = _lists(batch.column("lo")), _lists(batch.column("hi"))
            at, near = _lists(batch.column("at"))
            sizes, removed, spans, digests, kept, shared = [], [], [], [], [], []
            for r in range(len(off) - 1):
                piece = data[off[r] : off[r + 1]]
                gone = _covered(len(piece), lo[where[r] : where[r + 1]], hi[where[r] : where[r + 1]], length)
                left = piece[~gone].tobytes()
                sizes.append(len(piece))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                shared.append(int(_covered(len(piece), at[near[r] : near[r + 1]], at[near[r] : near[r + 1]], under).sum()))
                if texts:
                    kept.append(left)
            out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "n_passage": pa.array(shared, pa.int64())}
            if texts:
                out["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return lean(run)


def repeats(texts: DataFrame, length: int, passage: int, scratch: Scratch, triples: bool) -> DataFrame:
    """(key, lo, hi, at): of texts(key, text), lists of the runs of places at which repeated strings of `length` bytes start,
    and of the samples whose names of step 1 occur elsewhere."""
    long_enough = texts.where(F.octet_length("text") >= passage)

    # 1: short names of samples; those found once go.
    twice = scratch.write(long_enough.mapInArrow(_near(length, passage), "near long").groupBy("near").count().where("count > 1").select("near"))
    schema = "near long, short long, long long, long2 long, key long, lo int, hi int, at int"
    runs = scratch.write(long_enough.mapInArrow(_runs(length, passage), schema).join(twice, "near").drop("near"))
    scratch.drop(twice)
    samples = scratch.write(runs.groupBy("key").agg(F.collect_set("at").alias("at")), sweep=False)

    # 2: long names of samples.
    held = runs.where("hi >= lo").drop("at")
    twice = scratch.write(held.groupBy("short").count().where("count > 1").select("short"), sweep=False)

    # 3: runs with the same strings throughout; one of each stands for them in step 4.
    runs2 = scratch.write(held.join(twice, "short"))
    scratch.drop(runs, twice)
    same = scratch.write(runs2.groupBy("long", "long2").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo")).alias("one")).where("n > 1"), sweep=False)
    runs3 = scratch.write(runs2.join(same, ["long", "long2"], "left").selectExpr("short", "key", "lo", "hi", "n IS NOT NULL AS done", "n IS NOT NULL AND one = struct(key, lo) AS stands"))
    scratch.drop(runs2, same)

    # 4: what is left, string by string.
    open_names = scratch.write(runs3.where("NOT done").select("short").distinct(), sweep=False)
    asked = runs3.where("NOT done OR stands").distinct().join(open_names, "short").groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    asked = asked.selectExpr("key", "transform(r, x -> x.lo) AS lo", "transform(r, x -> x.hi) AS hi")
    if triples:
        hits = equal_starts(texts, asked, length, scratch).selectExpr("key", "at AS lo", "at AS hi")
    else:
        strings = scratch.write(texts.join(asked, "key").mapInArrow(_strings(length), "name long, name2 long, key long, at int"))
        found = scratch.write(strings.groupBy("name", "name2").count().where("count > 1").select("name", "name2"))
        hits = strings.join(found, ["name", "name2"]).selectExpr("key", "at AS lo", "at AS hi")
    marks = hits.unionByName(runs3.where("done").select("key", "lo", "hi")).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    marks = marks.selectExpr("key", "transform(r, x -> x.lo) AS lo", "transform(r, x -> x.hi) AS hi")
    marks = scratch.write(samples.join(marks, "key", "left"))
    scratch.drop(runs3, open_names, samples, *(() if triples else (strings, found)))
    return marks


def dedup_bytes(docs: DataFrame, length: int = 400, texts: bool = False, passage: int = 285, triples: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage (bytes under
    sampled names that occur elsewhere: every repeated string of `passage` bytes has one) and, with texts, the kept bytes."""
    passage = min(passage, length)
    if passage < REACH + GRAM:
        raise ValueError(f"length and passage must be {REACH + GRAM} or more")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    marks = repeats(rows.select("key", "text"), length, passage, scratch, triples)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long" + (", kept binary" if texts else "")
    return rows.join(marks, "key", "left").select("doc_id", "text", "lo", "hi", "at").mapInArrow(_mark(length, passage - REACH + 1, texts), out)
