"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: texts are lower-cased (A-Z), words joined to shingles of `width` words, repeats included; a bit is 1 if it
is set in over half of the shingles' XXH64 values (seed 42). A text of fewer words is one shingle, a text without words
has fingerprint zero, linked like any other.

Self-join: distinct fingerprints form a binary trie. Pairs of its nodes are traversed together; each step adds the bits
by which the two differ, and a pair is dropped when these exceed the budget. The upper levels are walked by DataFrame
operations, level by level: fingerprints are joined with the nodes that exist on the next level and keep those within
the budget, until a node is small enough, so that a group of near copies is split however large it is. The lower levels
are walked within a task, in numpy, on many node pairs at once. A task reports a spanning forest of the links it found,
not all pairs, and components are built over those.

Null texts count as empty, null ids take part and sort as the largest (a group of them alone has a null component_id);
repeated rows share a fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, buffers, find_words, lean, signed, slices, whole_row
from .components import connected_components

_LOWER = bytes(range(256)).lower()
#: Bits of the first level of the trie that is walked, and of a step down.
START, STEP = 8, 4


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, off = buffers(batch.column("text"))
            out = []
            for i, j in slices(off, 1 << 20):
                own, piece = off[i : j + 1] - off[i], data[off[i] : off[j]]
                starts, ends, row = find_words(piece, own)
                raw = piece.tobytes().translate(_LOWER)
                # All words of the slice, joined by one space: a shingle is a range of that.
                joined = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
                begin = np.concatenate([[0], np.cumsum(ends - starts + 1)])
                where = np.searchsorted(row, np.arange(j - i + 1))
                n = np.diff(where)
                shingles = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
                first = np.repeat(where[:-1], shingles) + _ramp(shingles)
                last = np.minimum(first + width, np.repeat(where[1:], shingles))
                values = np.array([digest(joined[a:b], 42) for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist())], np.uint64)
                out.append(majority(values, shingles))
            prints = np.concatenate(out) if out else np.zeros(0, np.uint64)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), signed(prints)], names=[*rest, "fp"])

    return lean(run)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of values."""
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if len(full):
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp has the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


# ---------------------------------------------------------------- the trie


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs of the sorted arrays a and b that differ in at most budget bits.

    A front holds node pairs of one depth: columns are the ranges in a and b, the nodes' prefixes and the bits spent.
    Large fronts are walked in parts, so that memory stays bounded.
    """
    zero = np.zeros(1, np.uint64)
    stack = [(np.array([[0, len(a), 0, len(b)]]), zero, zero, np.zeros(1, np.int64), 63)]
    while stack:
        box, pa_, pb_, spent, bit = stack.pop()
        small = np.full(len(box), True) if bit < 0 else (box[:, 1] - box[:, 0]) * (box[:, 3] - box[:, 2]) <= leaf
        for part in np.array_split(box[small], max(1, int(small.sum()) // 20_000)):
            la, lb = part[:, 1] - part[:, 0], part[:, 3] - part[:, 2]
            k = _ramp(la * lb)
            per, start = np.repeat(lb, la * lb), np.repeat(part[:, [0, 2]], la * lb, axis=0)
            x, y = start[:, 0] + k // np.maximum(per, 1), start[:, 1] + k % np.maximum(per, 1)
            hit = np.bitwise_count(a[x] ^ b[y]) <= budget
            if hit.any():
                yield x[hit], y[hit]
        box, pa_, pb_, spent = box[~small], pa_[~small], pb_[~small], spent[~small]
        if not len(box):
            continue
        half = np.uint64(1) << np.uint64(bit)
        mid_a = np.clip(np.searchsorted(a, pa_ | half), box[:, 0], box[:, 1])
        mid_b = np.clip(np.searchsorted(b, pb_ | half), box[:, 2], box[:, 3])
        down = []
        for p in (0, 1):
            for q in (0, 1):
                lo_a, hi_a = (box[:, 0], mid_a) if p == 0 else (mid_a, box[:, 1])
                lo_b, hi_b = (box[:, 2], mid_b) if q == 0 else (mid_b, box[:, 3])
                ok = (lo_a < hi_a) & (lo_b < hi_b) & (spent + (p != q) <= budget)
                down.append((np.stack([lo_a, hi_a, lo_b, hi_b], axis=1)[ok], pa_[ok] | half * np.uint64(p), pb_[ok] | half * np.uint64(q), spent[ok] + (p != q)))
        front = [np.concatenate(x) for x in zip(*down)]
        for at in np.array_split(np.arange(len(front[0])), max(1, len(front[0]) // 200_000)):
            stack.append((*(x[at] for x in front), bit - 1))


def _forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between items 0 .. n-1."""
    up, kept = list(range(n)), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for xs, ys in links:
        for x, y in zip(xs.tolist(), ys.tolist()):
            p, q = root(x), root(y)
            if p != q:
                up[p] = q
                kept.append((x, y))
    return kept


def _join_node(budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["fp"].to_numpy()[pdf["own"].to_numpy()].view(np.uint64))
        rest = np.sort(pdf["fp"].to_numpy()[~pdf["own"].to_numpy()].view(np.uint64))
        all_, out = np.concatenate([own, rest]), []

        def links():
            for x, y in trie_links(own, own, budget):
                keep = x < y
                yield x[keep], y[keep]
            if len(rest):
                for x, y in trie_links(own, rest, budget):
                    yield x, y + len(own)

        if len(own):
            out = _forest(links(), len(all_))
        at = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": all_[at[:, 0]].view(np.int64), "b": all_[at[:, 1]].view(np.int64)})

    return run


def _prefix(fp: str, depth: int) -> str:
    """The first depth bits of a fingerprint, as a number."""
    return f"shiftrightunsigned({fp}, {64 - depth})"


def links(prints: DataFrame, scratch: Scratch, budget: int = 2, node: int = 256) -> DataFrame:
    """(a, b): links between distinct fingerprints prints(fp) that give all components at that budget.

    node is the number of fingerprints aimed at in one node. The walk starts with the node pairs at START bits and goes
    down STEP bits at a time, for pairs only whose second node holds more than that many. A row of `sent` is one
    fingerprint and one node that it meets, within the budget so far; nodes that hold nothing are met by none.
    """
    if not 0 <= budget <= 3:
        raise ValueError("budget must be 0 to 3")
    spark, done = prints.sparkSession, []
    masks = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(START), k)]
    depth, own = START, _prefix("fp", START)
    nodes = scratch.write(prints.groupBy(F.expr(own).alias("node")).agg(F.count("*").alias("n")), sweep=False)
    met = prints.select("fp", F.explode(F.lit(masks)).alias("mask")).selectExpr("fp", f"{own} ^ mask AS node").where(f"node <= {own}")
    # Pairs are walked from the node with the greater prefix; a node meets itself, too.
    sent = met.join(nodes, "node").select("fp", "node", "n")
    while depth + STEP <= 64:
        if nodes.where(f"n > {4 * node}").isEmpty():
            break
        sent = scratch.write(sent, sweep=False)
        done.append(sent.where(f"n <= {4 * node}").select("fp", "node", F.lit(depth).alias("depth")))
        down = sent.where(f"n > {4 * node}").select("fp", F.col("node").alias("parent"))
        crowd = nodes.where(f"n > {4 * node}").select(F.col("node").alias("parent"))
        depth, own = depth + STEP, _prefix("fp", depth + STEP)
        inside = prints.withColumn("parent", F.expr(_prefix("fp", depth - STEP))).join(crowd, "parent")
        nodes = scratch.write(inside.groupBy("parent", F.expr(own).alias("node")).agg(F.count("*").alias("n")), sweep=False)
        sent = down.join(nodes, "parent").where(f"bit_count(node ^ {own}) <= {budget} AND node <= {own}").select("fp", "node", "n")
    whole = sent.select("fp", "node", F.lit(depth).alias("depth"))
    for d in done:
        whole = whole.unionByName(d)
    # own says that the fingerprint lies in the node.
    whole = whole.withColumn("own", F.expr("shiftrightunsigned(fp, 64 - depth) = node"))
    # Walking costs more than the rows' bytes tell, so tasks are not merged by size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return whole.repartition(tasks, "depth", "node").groupBy("depth", "node").applyInPandas(_join_node(budget), "a long, b long")


def components(prints: DataFrame, scratch: Scratch, budget: int = 2, node: int = 256) -> DataFrame:
    """(fp, component_id) for every fingerprint of prints(doc_id, fp): the least doc_id reachable by links of at most budget bits."""
    least = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), sweep=False)
    found = scratch.write(links(least.select("fp"), scratch, budget, node))
    roots = scratch.write(connected_components(found, scratch), sweep=False)
    labelled = scratch.write(least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), sweep=False)
    names = scratch.write(labelled.groupBy("root").agg(F.min("least").alias("component_id")), sweep=False)
    by_print = scratch.write(labelled.join(names, "root").select("fp", "component_id"))
    scratch.drop(least, found, roots, labelled, names)
    return by_print


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, node: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links of at most budget bits."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, width))
    by_print = components(prints, scratch, budget, node)
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, budget: int = 2) -> DataFrame:
    """docs with one row of each component, that of the least doc_id, in the columns of docs.

    A row without id goes by a number made from its text, above 2**62 and so after all others. Of several rows with the least doc_id, one with
    the least fingerprint, then the least text, stays.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    rows = docs.select(ident.alias("doc_id"), F.xxhash64("text").alias("_hash"), "text", whole_row(docs).alias("_row"))
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(rows.select("doc_id", "_hash", "text").mapInArrow(_fingerprints(width), "doc_id long, _hash long, fp long"))
    found = components(prints, scratch, budget)
    stays = prints.join(found, "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "fp", "_hash")).alias("s")).select("s.doc_id", "s._hash")
    place = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy("text"))
    return rows.join(stays, ["doc_id", "_hash"]).withColumn("_place", place).where("_place = 1").select("_row.*")
