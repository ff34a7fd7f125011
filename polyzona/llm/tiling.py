"""Benchmark decontamination by greedy string tiling.

Texts are cut into lower-cased runs of letters and digits. A test item and a document are compared where they share
seeds, runs of `tile` tokens: seeds of the documents are looked up in a table of the items' seeds. For such a pair, the
longest match of unmarked tokens is marked again and again (Karp-Rabin hashes of windows, halving the length searched
for, confirmed token by token), so that passages whose parts were moved about are still covered. A pair counts if the
tiles cover `threshold` of the item's tokens. A pair whose seeds cannot reach that, even if all of them were tiles, is
not tiled at all; this drops no pair that would count.

Of matches of one length, the first by place in the item, then in the document, is marked first, so tiles are the same
in every run. Items are handled in blocks of at most `block_bytes` of text, each of which is one pass over the documents
whose result is written before the next block is read, so what is held by the driver and sent to the executors is
bounded however large the benchmark is. Parts of an item of fewer than `least` tokens say too little: such an item
counts where it is found whole, as one tile. Null and empty items are skipped. Null texts have no tokens. Rows that
repeat a doc_id are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, buffers, find_words, lean, slices, word_hashes

#: ASCII: letters to lower case, everything but letters and digits to a space; bytes of other letters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_OTHER = re.compile(r"[^\w]|_")


def plain(raw: bytes) -> bytes:
    """Lower-case letters and digits of a text in UTF-8, with a space for any other character."""
    if raw.isascii():
        return raw.translate(_PLAIN)
    return _OTHER.sub(" ", raw.decode("utf-8", "replace").lower()).encode()


def tokens(raw: bytes) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    data = np.frombuffer(plain(raw), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (place in item, place in doc, length) of at least `tile` tokens, longest first."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    rolling, out = Rolling(77), []
    pre_i, pre_d = rolling.prefix(item), rolling.prefix(doc)
    size = min(len(item), len(doc))
    while size >= tile:
        # Windows of this length without marked tokens, by running hashes.
        at_i, at_d = (_open(f, size) for f in (free_i, free_d))
        hash_i, hash_d = rolling.of(pre_i, at_i, at_i + size), rolling.of(pre_d, at_d, at_d + size)
        order = np.argsort(hash_d, kind="stable")
        low, high = (np.searchsorted(hash_d[order], hash_i, s) for s in ("left", "right"))
        found = []
        for k in np.flatnonzero(low < high).tolist():
            for d in at_d[order[low[k] : high[k]]].tolist():
                n = _grow(item, doc, free_i, free_d, int(at_i[k]), d)
                if n >= size:
                    found.append((int(at_i[k]), d, n))
        if not found:
            size = size - 1 if size <= tile + 1 else max(tile, size // 2)
            continue
        # Only the longest are marked; what they cut or leave is looked for again.
        longest = max(n for _, _, n in found)
        for i, d, n in sorted(set(found)):
            if n == longest and free_i[i : i + n].all() and free_d[d : d + n].all():
                out.append((i, d, n))
                free_i[i : i + n] = free_d[d : d + n] = False
    return out


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of that size whose tokens are all free."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[:-size])


def _grow(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, i: int, d: int) -> int:
    """Length of the match from these places on, compared token by token, as far as it goes over free tokens."""
    n = min(len(item) - i, len(doc) - d)
    same = (item[i : i + n] == doc[d : d + n]) & free_i[i : i + n] & free_d[d : d + n]
    return n if same.all() else int(np.argmin(same))


class Items:
    """Test items that share a tile's size: their tokens, and a sorted table of their seeds."""

    def __init__(self, known: list[tuple[int, np.ndarray]], tile: int):
        self.tile, self.rolling = tile, Rolling(55)
        self.ids, self.tokens = [k for k, _ in known], [t for _, t in known]
        seeds = [self.rolling.windows(t, tile) for t in self.tokens]
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        self.place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.place = self.seeds[order], self.item[order], self.place[order]
        self.distinct = np.unique(self.seeds)
        # A table of bits by the seeds' low bits: most tokens of a corpus share no seed, and this tells cheaply.
        self.bits = 1 << max(16, int(len(self.distinct)).bit_length() + 6)
        self.maybe = np.zeros(self.bits, bool)
        self.maybe[(self.distinct & np.uint64(self.bits - 1)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> np.ndarray:
        """Places of those seeds that some item has."""
        at = np.flatnonzero(self.maybe[(seeds & np.uint64(self.bits - 1)).astype(np.int64)])
        where = np.searchsorted(self.distinct, seeds[at])
        where[where == len(self.distinct)] = 0
        return at[self.distinct[where] == seeds[at]] if len(self.distinct) else at[:0]

    def compare(self, doc: np.ndarray, shared: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, covered, tokens, tiles, longest) for the items that tiles of doc cover up to the threshold.

        shared has the hashes of doc's seeds that some item has.
        """
        shared = np.unique(shared)
        if not len(shared):
            return
        low, high = np.searchsorted(self.seeds, shared, "left"), np.searchsorted(self.seeds, shared, "right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())])
        for k in np.unique(self.item[rows]).tolist():
            item = self.tokens[k]
            reach = np.zeros(len(item) + 1, np.int64)
            at = self.place[rows[self.item[rows] == k]]
            np.add.at(reach, at, 1)
            np.add.at(reach, at + self.tile, -1)
            if (np.cumsum(reach[:-1]) > 0).sum() < threshold * len(item):
                continue
            tiles = greedy_tiles(item, doc, self.tile)
            covered = sum(n for _, _, n in tiles)
            if covered >= threshold * len(item):
                yield self.ids[k], covered, len(item), len(tiles), max(n for _, _, n in tiles)


def _tables(items: list[tuple[int, bytes]], tile: int, least: int) -> list[tuple[Items, bool]]:
    """Items of `least` tokens or more in one table, by tiles; shorter ones by their length, as one tile (part is False)."""
    known = [(k, t) for k, t in ((k, tokens(x)) for k, x in items) if len(t)]
    by_size: dict[tuple[int, bool], list] = {}
    for k, t in known:
        by_size.setdefault((tile, True) if len(t) >= max(least, tile) else (len(t), False), []).append((k, t))
    return [(Items(group, size), part) for (size, part), group in by_size.items()]


def _search(items: list[tuple[int, bytes]], tile: int, threshold: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(items, tile, least)
        for batch in batches:
            data, off = buffers(batch.column("text"))
            docs = batch.column("doc_id")
            out: list[tuple] = []
            for i, j in slices(off):
                own = off[i : j + 1]
                texts = [plain(data[a:b].tobytes()) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
                edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                piece = np.frombuffer(b"".join(texts), np.uint8)
                starts, ends, row = find_words(piece, edges)
                words = word_hashes(piece, starts, ends)
                where = np.searchsorted(row, np.arange(j - i + 1))
                for table, part in tables:
                    seeds = table.rolling.windows(words, table.tile)
                    at = table.hits(seeds)
                    at = at[row[at] == row[at + table.tile - 1]]
                    for k in np.unique(row[at]).tolist():
                        for found in table.compare(words[where[k] : where[k + 1]], seeds[at[row[at] == k]], threshold if part else 1.0):
                            out.append((docs[i + k].as_py(), *found))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "covered", "item_tokens", "tiles", "longest"])

    return lean(run)


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of about that many bytes; one block at a time is on the driver."""
    part, size = [], 0
    for r in benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).orderBy("item_id", "text").toLocalIterator():
        part.append((r[0], bytes(r[1])))
        size += len(part[-1][1])
        if size >= block_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = 4, threshold: float = 0.6, least: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, tiles, longest) of every pair whose tiles cover the threshold of the item."""
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    schema = "doc_id long, item_id long, covered int, item_tokens int, tiles int, longest int"
    scratch = Scratch(docs.sparkSession)
    for part in blocks(benchmark, block_bytes):
        # The last block is left to the caller's plan; each one before it is finished first.
        out = None if out is None else scratch.write(out)
        found = rows.mapInArrow(_search(part, tile, threshold, least), schema)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows of contaminated documents, in the columns of docs; null ids are decided together."""
    bad = find_contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_contaminated_id")).distinct()
    return docs.join(bad, F.expr("doc_id IS NOT DISTINCT FROM _contaminated_id"), "left_anti")
