"""Token ids in patched frame-of-reference blocks.

A block holds BLOCK ids: its minimum, the differences to it packed at the width that the `share` percentile of them
needs, and a list of exceptions (places and whole differences) for those that need more. A segment is a run of whole
documents with an index of its blocks' starts, so that any block is found without reading those before it. Segments
are rows of a Parquet table (part, seq, n_ids, n_docs, image): Spark's commit protocol then leaves whole files only,
also when executors are lost, on any store that Spark writes to; an image is also a valid file of its own.

Layout of an image, little-endian: b"PFR1", block size u32, documents u32, blocks u32, ids u64; for each document its
id i64, 1 or 0 for a null id u8, and its number of ids u32; block starts u32 (one more than blocks, from the first
block's); blocks: minimum u32, width u8, 0 u8, exceptions u16, packed differences, places u16, differences u32.

Documents come in ascending doc_id order, null ids first, then by the text's hash and the text. Null texts are empty and
have the end id alone. Words are cut at ASCII white space, where the tokenizer's own pattern cuts too, so each distinct
word is encoded once per worker.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, lean, slices

BLOCK = 512
_HEAD = struct.Struct("<4sIIIQ")
_BLOCK = struct.Struct("<IBBH")

# ---------------------------------------------------------------- blocks


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values as rows of bytes, lowest bits first."""
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : BLOCK * width].reshape(len(packed), BLOCK, width)
    full = np.zeros((len(packed), BLOCK, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").reshape(len(packed), -1).view("<u4")


def encode_ids(ids: np.ndarray, share: float = 0.95) -> tuple[list[int], bytes]:
    """Starts of the blocks, with the end, and the blocks."""
    n = len(ids)
    count = -(-n // BLOCK)
    grid = np.zeros((count, BLOCK), np.uint32)
    grid.reshape(-1)[:n] = ids
    if n % BLOCK:
        grid.reshape(-1)[n:] = ids[n - n % BLOCK :].min()
    low = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    delta = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    common = np.partition(delta, at, axis=1)[:, at] if count else low
    widths = np.array([int(x).bit_length() for x in common], np.int64)
    packed: list[bytes] = [b""] * count
    for w in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == w)
        for r, b in zip(rows.tolist(), _pack(delta[rows], w)):
            packed[r] = b.tobytes()
    starts, out = [0], []
    for r in range(count):
        odd = np.flatnonzero(delta[r] >> np.uint32(widths[r])) if widths[r] < 32 else np.zeros(0, np.int64)
        out.append(_BLOCK.pack(int(low[r]), int(widths[r]), 0, len(odd)) + packed[r] + odd.astype("<u2").tobytes() + delta[r][odd].astype("<u4").tobytes())
        starts.append(starts[-1] + len(out[-1]))
    return starts, b"".join(out)


def decode_ids(data: bytes, starts: list[int], n: int) -> np.ndarray:
    """The n ids of the blocks that begin at starts."""
    count = len(starts) - 1
    grid, heads = np.zeros((count, BLOCK), np.uint32), [_BLOCK.unpack_from(data, s) for s in starts[:-1]]
    by_width: dict[int, list[int]] = {}
    for r, h in enumerate(heads):
        by_width.setdefault(h[1], []).append(r)
    for w, rows in by_width.items():
        if w:
            size = BLOCK * w // 8
            packed = np.stack([np.frombuffer(data, np.uint8, size, starts[r] + _BLOCK.size) for r in rows])
            grid[rows] = _unpack(packed, w)
    for r, (low, w, _, odd) in enumerate(heads):
        if odd:
            at = starts[r] + _BLOCK.size + BLOCK * w // 8
            grid[r, np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
        grid[r] += np.uint32(low)
    return grid.reshape(-1)[:n]


def encode_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    starts, blocks = encode_ids(ids)
    head = _HEAD.pack(b"PFR1", BLOCK, len(sizes), len(starts) - 1, len(ids))
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes()
    return head + names + np.array(sizes, "<u4").tobytes() + np.array(starts, "<u4").tobytes() + blocks


def decode_segment(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, their sizes, and all token ids."""
    magic, block, docs, blocks, n = _HEAD.unpack_from(image)
    if magic != b"PFR1" or block != BLOCK:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    names, known = np.frombuffer(image, "<i8", docs, at), np.frombuffer(image, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(image, "<u4", docs, at + 9 * docs)
    starts = np.frombuffer(image, "<u4", blocks + 1, at + 13 * docs)
    base = at + 13 * docs + 4 * (blocks + 1)
    ids = decode_ids(image[base:], starts.tolist(), n)
    return [int(d) if k else None for d, k in zip(names, known)], sizes, ids


# ---------------------------------------------------------------- tokens


class _Known(dict):
    """A table that is filled by its function as keys are asked for, and emptied when it is full."""

    def __init__(self, make: Callable[[bytes], bytes], room: int):
        self.make, self.room = make, room

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(self) >= self.room:
            self.clear()
        self[key] = value
        return value


#: What ends a word as a part of its own, if a lower-case ASCII letter comes before it: ASCII but letters and digits.
_TAIL = bytes(b for b in range(128) if not chr(b).isalnum())
_SMALL = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: Lower-case ASCII letters, and letters from U+00C0 to U+00FF, in UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
#: Their bytes in lower case, as the characters by which the model knows bytes: printable Latin-1 as it is, others from U+0100 on.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_AS_CHAR = [chr(256 + _ODD.index(b)) if b in _ODD else chr(b) for b in range(256)]
_MODEL = "".join(_AS_CHAR[b + 32 if 0x80 <= b <= 0x9E else b] for b in range(256))


class WordEncoder:
    """Token ids of texts by way of their distinct words, as little-endian bytes.

    The tokenizer lower-cases, so words are looked up in lower case; texts that may hold its special tokens, which are
    matched as written, are not lowered. A word that ends in a letter and punctuation is encoded as these two, between
    which the tokenizer's pattern always cuts, unless it may hold a special token. Both tables are emptied when they are full.
    """

    def __init__(self, file: str, end_id: int, room: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(file), np.array([end_id], "<u4").tobytes()
        self.piece = self.tokenizer.model.tokenize
        self.parts = _Known(self._part, room)
        self.words = _Known(self._word, room)

    def _part(self, part: bytes) -> bytes:
        # These letters are composed and one word of the tokenizer's model; the rest goes through all of its steps.
        if _LETTERS.fullmatch(part):
            return array("I", [t.id for t in self.piece(part.decode("latin-1").translate(_MODEL))]).tobytes()
        return array("I", self.tokenizer.encode_batch_fast([part.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(_TAIL)
        if len(core) == len(word) or not core or core[-1] not in _SMALL or b"<|" in word:
            return self.parts[word]
        return self.parts[core] + self.parts[word[len(core) :]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, with the end id."""
        known = self.words.__getitem__
        return [b"".join(map(known, (t if b"<|" in t else t.lower()).split())) + self.end for t in texts]


_ENCODERS: dict[tuple[str, int, int], WordEncoder] = {}


def encoder(file: str, end_id: int, room: int) -> WordEncoder:
    """One encoder for each worker process."""
    if (file, end_id, room) not in _ENCODERS:
        _ENCODERS[file, end_id, room] = WordEncoder(file, end_id, room)
    return _ENCODERS[file, end_id, room]


def _write(file: str, end_id: int, segment_ids: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = encoder(file, end_id, room), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        texts: list[bytes] = []
        total = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            image = encode_segment(names, [len(t) // 4 for t in texts], ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(names)], pa.int32()), pa.array([image], pa.binary())], names=["part", "seq", "n_ids", "n_docs", "image"])

        for batch in batches:
            data, off = buffers(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for i, j in slices(off, 1 << 20):
                for doc, ids in zip(docs[i:j], words.encode([data[x:y].tobytes() for x, y in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist())])):
                    names.append(doc)
                    texts.append(ids)
                    total += len(ids) // 4
                    if total >= segment_ids:
                        yield segment()
                        names, texts, total, seq = [], [], 0, seq + 1
        if names:
            yield segment()

    return lean(run)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, segment_ids: int = 1 << 16, room: int = 700_000) -> None:
    """docs(doc_id, text) encoded, each with end_id at its end, in ascending doc_id order, as segments below path.

    room bounds a worker's tables of known words, at some 100 bytes a word in each of two; idle workers keep them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    rows.mapInArrow(_write(tokenizer_file, end_id, segment_ids, room), "part int, seq int, n_ids long, n_docs int, image binary").write.parquet(path)


def _read(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("image")):
                docs, sizes, ids = decode_segment(image.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                raw, n = ids.astype("<u4").tobytes(), len(docs)
                tokens = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]
                columns = {"part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(docs, pa.int64()), "inside": pa.array(ends - sizes), "n_tokens": pa.array(sizes.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(t) for t in tokens], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(tokens, pa.binary())} if whole else {}))

    return lean(run)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with ids, the ids as little-endian bytes, decoded from the files."""
    files = spark.read.schema("part int, seq int, n_ids long, n_docs int, image binary").parquet(path)
    docs = files.select("part", "seq", "image").mapInArrow(_read(ids), "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    # Prefix sums of the segments' sizes within a part, and of the parts' sizes, of which there are as many as tasks wrote.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before")).join(parts, "part")
    found = docs.join(starts, ["part", "seq"]).withColumn("start", F.expr("base + before + inside"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))
