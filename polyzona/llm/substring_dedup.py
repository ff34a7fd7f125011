"""Substring dedup by level-wise doubling over word windows.

A window of `length` words is removed where its word sequence also starts in a document with a smaller id. Long windows
are rare, so the search climbs: windows of `start` words are compared first, and those repeated at one length alone are
extended to twice that length, again and again, until the wanted length is reached or no candidates survive. On a level
a window of `length` words is represented by the least hash among its windows of that level's width (equal windows have
equal least ones), which a run of neighbouring windows shares: about a quarter of the positions are shuffled on the
first level, none is lost, and at the wanted length a window represents itself.

Null and blank texts have no words. Texts shorter than `length` keep all. A null doc_id neither gives nor takes
matches. Rows with the same doc_id never match each other, since neither id is smaller. Windows are compared by 64-bit
hashes: n candidate windows give about n * n / 2**65 false matches, less than one up to some five billion of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, buffers, find_words, lean, signed, slices, word_hashes


def _sequences(batch: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """For slices of a batch: first row, data, offsets, word starts, ends, rows, word hashes, and which windows are whole."""
    data, off = buffers(batch.column("text"))
    for i, j in slices(off):
        own = off[i : j + 1] - off[i]
        piece = data[off[i] : off[j]]
        starts, ends, row = find_words(piece, own)
        words = word_hashes(piece, starts, ends)
        whole = row[length - 1 :] == row[: len(row) - length + 1] if len(row) >= length else np.zeros(0, bool)
        yield i, j, piece, own, starts, ends, row, words, whole


def widths(length: int, start: int) -> list[int]:
    """Widths of the levels: start, doubled until the wanted length."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _least(words: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each window of that length, the least hash of the windows of that width in it."""
    inner = Rolling(width).windows(words, width)
    if len(words) < length or width == length:
        return inner if len(words) >= length else np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(inner, length - width + 1).min(axis=1)


def _level(length: int, before: int | None, width: int):
    """(key, doc_id): the representatives at that width of the windows whose representatives at the width before are in keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if before:
                keys, lists = _flat(batch.column("keys"))
            for i, j, _, _, _, _, row, words, whole in _sequences(batch, length):
                at = np.flatnonzero(whole)
                if before and len(at):
                    known, kept = _least(words, length, before).view(np.int64), []
                    where = np.searchsorted(row[at], np.arange(j - i + 1))
                    for k in range(j - i):
                        mine = at[where[k] : where[k + 1]]
                        kept.append(mine[np.isin(known[mine], keys[lists[i + k] : lists[i + k + 1]])])
                    at = np.concatenate(kept)
                if not len(at):
                    continue
                key, doc = _least(words, length, width)[at], row[at]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([signed(key[new]), pa.array(ids[i + doc[new]])], names=["key", "doc_id"])

    return lean(run)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of int64 lists; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _mark(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Rolling(length)
        for batch in batches:
            keys, lists = _flat(batch.column("keys"))
            for i, j, piece, own, starts, ends, row, words, whole in _sequences(batch, length):
                full = one.windows(words, length).view(np.int64)
                hit = np.zeros(len(full), bool)
                where = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    if lists[i + k] < lists[i + k + 1]:
                        a, b = where[k], max(where[k], where[k + 1] - length + 1)
                        hit[a:b] = np.isin(full[a:b], keys[lists[i + k] : lists[i + k + 1]])
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(hit)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                first = gone & np.concatenate([[True], ~gone[:-1] | (row[1:] != row[:-1])])[: len(gone)]
                raw = piece.tobytes()
                digests, kept, removed, spans = [], [], [], []
                for k in range(j - i):
                    a, b = where[k], where[k + 1]
                    left = " ".encode().join([raw[s:e] for s, e in zip((starts[a:b][~gone[a:b]]).tolist(), (ends[a:b][~gone[a:b]]).tolist())])
                    digests.append(hashlib.sha256(left).hexdigest())
                    removed.append(int(gone[a:b].sum()))
                    spans.append(int(first[a:b].sum()))
                    if texts:
                        kept.append(left.decode("utf-8", "replace"))
                out = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_words": pa.array(np.diff(where)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
                if texts:
                    out["kept"] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return lean(run)


def dedup_substrings(docs: DataFrame, length: int = 13, texts: bool = False, start: int = 7) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, n_spans, kept_sha256 and, with texts, kept."""
    if length < 2 or start < 1:
        raise ValueError("length must be 2 or more, start 1 or more")
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, before, used = docs.where("doc_id IS NOT NULL"), None, []
    for width in widths(length, start):
        level = rows.mapInArrow(_level(length, before, width), "key long, doc_id long")
        # The first level is computed twice, since it is too large to write; those after it are small.
        level = scratch.write(level) if before else level
        ends = level.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
        first = scratch.write(ends if width == length else ends.select("key"))
        found = level.join(first, "key")
        found = found.where("lo < doc_id") if width == length else found
        found = scratch.write(found.groupBy("doc_id").agg(F.collect_set("key").alias("keys")))
        # What this level was made of is not read again.
        scratch.drop(first, *used, *([level] if before else []))
        if width == length or found.isEmpty():
            break
        rows, before, used = docs.where("doc_id IS NOT NULL").join(found, "doc_id"), width, [found]
    out = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if texts else "")
    return docs.join(found, "doc_id", "left").select("doc_id", "text", "keys").mapInArrow(_mark(length, texts), out)
