"""A packed index of zones' bboxes: rows of segments, each a file image with a checksum of its own.

A segment, little-endian: b"PZX1", checksum u32, records u32; then records sorted by level and id: level i32, bbox as four
f64, length of the id u16, the id in UTF-8. The checksum is 32-bit FNV-1a of the image with the checksum's bytes as zero.
Segments are made and read one batch at a time, so neither side holds an index as a whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = struct.Struct("<4sII")
_RECORD = struct.Struct("<iddddH")
SCHEMA = "level int, id string, w double, s double, e double, n double"


def checksum(image: bytes) -> int:
    """FNV-1a of the image, bytes 4 to 7 counting as zero."""
    h = 0x811C9DC5
    for b in image[:4] + bytes(4) + image[8:]:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def pack(records: list[tuple]) -> bytes:
    body = b"".join(_RECORD.pack(level, w, s, e, n, len(raw := id_.encode())) + raw for level, id_, w, s, e, n in records)
    image = _HEAD.pack(b"PZX1", 0, len(records)) + body
    return image[:4] + struct.pack("<I", checksum(image)) + image[8:]


def unpack(image: bytes) -> list[tuple]:
    """Records of an image; raises if it is not one or was changed."""
    magic, stated, count = _HEAD.unpack_from(image)
    if magic != b"PZX1":
        raise ValueError("not an index segment")
    if stated != checksum(image):
        raise ValueError("checksum of an index segment does not match")
    out, at = [], _HEAD.size
    for _ in range(count):
        level, w, s, e, n, size = _RECORD.unpack_from(image, at)
        at += _RECORD.size
        out.append((level, image[at : at + size].decode(), w, s, e, n))
        at += size
    if at != len(image):
        raise ValueError("an index segment has bytes left over")
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = list(zip(*(c.to_pylist() for c in batch.columns)))
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([records[0][0]], pa.int32()), pa.array([records[0][1]]), pa.array([len(records)], pa.int32()), pa.array([pack(records)], pa.binary())], names=["level", "first_id", "records", "image"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for image in batch.column("image").to_pylist():
            cols = list(zip(*unpack(image)))
            kinds = [pa.int32(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["level", "id", "w", "s", "e", "n"])


def encode_index(zones: DataFrame) -> DataFrame:
    """level and first_id of each segment, its number of records and image, over zones(id, level, bbox_w ...)."""
    rows = zones.select(F.col("level").cast("int").alias("level"), "id", *[F.col(f"bbox_{k}").alias(k) for k in "wsen"])
    return rows.repartitionByRange("level", "id").sortWithinPartitions("level", "id").mapInArrow(_encode, "level int, first_id string, records int, image binary")


def decode_index(segments: DataFrame) -> DataFrame:
    """level, id, w, s, e, n of all records."""
    return segments.select("image").mapInArrow(_decode, SCHEMA)


def index_differences(segments: DataFrame, zones: DataFrame) -> DataFrame:
    """Records of the index that the zones do not have, and the other way round: id, side."""
    mine = zones.select(F.col("level").cast("int").alias("level"), "id", *[F.col(f"bbox_{k}").alias(k) for k in "wsen"])
    kept = decode_index(segments)
    return kept.exceptAll(mine).select("id", F.lit("index").alias("side")).unionByName(mine.exceptAll(kept).select("id", F.lit("dataset").alias("side")))
