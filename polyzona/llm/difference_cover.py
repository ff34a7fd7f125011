"""Equal strings of one length, by the difference cover of triples, cut off where the names reach that length.

Positions whose id is 1 or 2 modulo 3 are sampled. Their first triples are three words of 44 bytes, known by 128 bits;
equal triples get one name, that of their least position, and the names of positions at fixed steps are the triples of
the next level, until a name stands for nearly `length` bytes. A name found once ends there: no string with it occurs
elsewhere. As only equality is asked for, names need no order. Strings are then merged with the sampled position that
both have at one offset (0, 1 or 2), the few bytes before and after it being compared as such.

Only positions that some string asked about needs take part. A level shuffles them three times: for their names, to
return these, and for the triples of the next level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, buffers, lean, mixed

WORD = 44
FIRST = 3 * WORD
_SYMBOL = mixed(np.arange(256, dtype=np.uint64) + np.uint64(5000))


def steps(length: int) -> tuple[list[int], int]:
    """Steps of the levels after the first, multiples of 3, and the width of the last names: `length` less 2 to 7."""
    width, out = FIRST, []
    while True:
        step = min(width, 3 * ((length - 2 - width) // 6))
        if step <= 0:
            return out, width
        out.append(step)
        width += 2 * step


def _parts(length: int):
    """Parts of texts under the strings that start at lo .. hi, each with an id of its first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, off = buffers(batch.column("text"))
            keys, rows = batch.column("key").to_pylist(), []
            for r, (lo, hi) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist())):
                text, runs, i = data[off[r] : off[r + 1]], sorted(zip(lo, hi)), 0
                while i < len(runs):
                    first, end, j = runs[i][0], runs[i][1] + length, i + 1
                    while j < len(runs) and runs[j][0] < end:
                        end, j = max(end, runs[j][1] + length), j + 1
                    rows.append((base, keys[r], first, text[first:end].tobytes(), [a - first for a, _ in runs[i:j]], [b - first for _, b in runs[i:j]]))
                    base, i = base + end - first, j
            names = ["base", "key", "first", "part", "lo", "hi"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return lean(run)


def _packed(part: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each position on as one number."""
    out = np.zeros(len(part) - size + 1, np.uint64)
    for k in range(size):
        out |= part[k : k + len(out)].astype(np.uint64) << np.uint64(8 * k)
    return out


def _gathered(rows: Iterator[list[np.ndarray]], names: list[str], limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` rows out of short columns."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0])
        if n >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


def _triples(levels: list[int]):
    """(base, id, a, b): the first triples of the sampled positions whose names the strings are made of."""
    places = [0]
    for step in levels:
        places = sorted({p + k * step for p in places for k in range(3)})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        both = Rolling(402), Rolling(403)
        for batch in batches:
            data, off = buffers(batch.column("part"))
            columns = zip(batch.column("base").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist())
            for r, (base, lo, hi) in enumerate(columns):
                part = data[off[r] : off[r + 1]]
                edge = np.zeros(len(part) + 4, np.int64)
                for p in places:
                    np.add.at(edge, np.array(lo) + p, 1)
                    np.add.at(edge, np.array(hi) + p + 3, -1)
                at = np.flatnonzero(np.cumsum(edge)[: max(len(part) - FIRST + 1, 0)] > 0)
                at = at[(base + at) % 3 != 0]
                yield [np.full(len(at), base), base + at, *(h.windows(_SYMBOL[part], FIRST)[at].view(np.int64) for h in both)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(rows(batches), ["base", "id", "a", "b"])

    return lean(run)


def _merged(length: int, width: int):
    """(base, id, before, edge): the sampled positions of each string, and the bytes around the name there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            data, off = buffers(batch.column("part"))
            columns = zip(batch.column("base").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist())
            for r, (base, lo, hi) in enumerate(columns):
                words = _packed(np.concatenate([data[off[r] : off[r + 1]], np.zeros(8, np.uint8)]), 8)
                at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]))
                for before in range(3):
                    # Strings whose ids are 1 and 2 meet at offset 0, 0 and 1 at 1, 0 and 2 at 2; equal ones at either.
                    own = at[(base + at) % 3 != (0, 2, 1)[before]]
                    after = length - width - before
                    lead = words[own] & np.uint64((1 << 8 * before) - 1)
                    tail = words[own + before + width] & np.uint64((1 << 8 * after) - 1)
                    edge = lead | tail << np.uint64(8 * before)
                    yield [np.full(len(own), base), base + own + before, np.full(len(own), before, np.int32), edge.view(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(rows(batches), ["base", "id", "before", "edge"])

    return lean(run)


def _named(triples: DataFrame, scratch: Scratch) -> DataFrame:
    """(base, id, name) of the triples found twice or more."""
    parts = [c for c in triples.columns if c not in ("base", "id")]
    equal = scratch.write(triples.groupBy(*parts).agg(F.min("id").alias("name"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = scratch.write(triples.join(equal, parts).select("base", "id", "name"))
    scratch.drop(equal)
    return out


def equal_starts(texts: DataFrame, asked: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, at): the places asked(key, lo, hi) in texts(key, text) whose strings start at another place asked, too."""
    levels, width = steps(length)
    parts = scratch.write(texts.join(asked, "key").mapInArrow(_parts(length), "base long, key long, first int, part binary, lo array<int>, hi array<int>"))
    names = _named(parts.select("base", "part", "lo", "hi").mapInArrow(_triples(levels), "base long, id long, a long, b long"), scratch)
    of_part = Window.partitionBy("base").orderBy("id")
    for step in levels:
        further = [F.max("name").over(of_part.rangeBetween(k, k)) for k in (step, 2 * step)]
        triples = names.select("base", "id", F.col("name").alias("a"), further[0].alias("b"), further[1].alias("c"))
        triples = scratch.write(triples.where("b IS NOT NULL AND c IS NOT NULL"))
        scratch.drop(names)
        names = _named(triples, scratch)
        scratch.drop(triples)
    edges = parts.select("base", "part", "lo", "hi").mapInArrow(_merged(length, width), "base long, id long, before int, edge long")
    strings = scratch.write(edges.join(names, ["base", "id"]).selectExpr("base", "id - before AS start", "before", "edge", "name"))
    scratch.drop(names)
    found = strings.groupBy("before", "edge", "name").count().where("count > 1").drop("count")
    starts = scratch.write(strings.join(found, ["before", "edge", "name"]).select("base", "start").distinct())
    scratch.drop(strings)
    return starts.join(parts.select("base", "key", "first"), "base").selectExpr("key", "CAST(start - base + first AS INT) AS at").distinct()
