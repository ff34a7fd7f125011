"""Scalar functions: identifiers, codes, versions, hashes, cache keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that decomposition leaves as they are. Fixed values.
SPECIAL_LETTERS = {"ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l"}
#: Entities in the order in which they are replaced. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"))
ADMIN_LEVELS = ("ADM0", "ADM1", "ADM2", "ADM3", "ADM4", "ADM5")


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no such function."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def slug(value: Column, ascii_only: bool = False) -> Column:
    """Lower-case letters and digits with single hyphens; ascii_only says that no decomposition is needed."""
    out = F.lower(value)
    for letter, plain in SPECIAL_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    out = out if ascii_only else _without_marks(out)
    return F.regexp_replace(F.regexp_replace(F.lower(out), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def global_id(country: Column, level: Column, local: Column) -> Column:
    return F.concat_ws(":", F.lower(country), F.lower(level), local)


def valid_global_id(value: Column) -> Column:
    """A bare two-letter country, or country:level:local."""
    return F.coalesce(value.rlike("^[a-z]{2}$|^[a-z]{2}:adm[0-5]:[a-z0-9][a-z0-9._-]*$"), F.lit(False))


def country_code(value: Column) -> Column:
    """Two lower-case letters, or null."""
    v = F.lower(F.trim(value))
    return F.when(v.rlike("^[a-z]{2}$"), v)


def admin_level(value: Column) -> Column:
    v = F.upper(F.trim(value))
    return F.when(v.isin(*ADMIN_LEVELS), v)


def admin_depth(level: Column) -> Column:
    return F.substring(level, 4, 10).cast("int")


def parent_level(level: Column) -> Column:
    d = admin_depth(level)
    return F.when(d > 0, F.concat(F.lit("ADM"), (d - 1).cast("string")))


def child_level(level: Column) -> Column:
    d = admin_depth(level)
    return F.when(d < 5, F.concat(F.lit("ADM"), (d + 1).cast("string")))


def fnv1a32(value: Column) -> Column:
    """Eight hex digits of 32-bit FNV-1a over UTF-16 code units, for text in the basic plane.

    The prime is 2**24 + 403, so the product is a shift and a small product, and no BIGINT overflows.
    """
    units = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(u)
        return (F.shiftleft(x.bitwiseAND(F.lit(0xFF)), 24) + x * 403).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step))), 8, "0")


def semver_key(version: Column) -> Column:
    """struct ordered like semantic versions: numbers, then releases after their prereleases. Null if malformed."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    return F.when(
        version.rlike(pattern),
        F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").cast("int").alias("release"), part(4).alias("pre")),
    )


def is_prerelease(version: Column) -> Column:
    return F.regexp_extract(version, r"^v?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1) != ""


def in_range(version: Column, wanted: str) -> Column:
    """Every clause of a list such as '>=1.2.0 <2.0.0' holds; a bare version must be equal."""
    out = F.lit(True)
    key = semver_key(version)
    for clause in wanted.split():
        op = next((o for o in (">=", "<=", ">", "<", "=") if clause.startswith(o)), "")
        other = semver_key(F.lit(clause[len(op) :]))
        out = out & {">=": key >= other, "<=": key <= other, ">": key > other, "<": key < other}.get(op, key == other)
    return F.coalesce(out, F.lit(False))


def decode_entities(value: Column) -> Column:
    for name, plain in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(plain))
    return value


def cache_key(*parts: Column) -> Column:
    """Parts joined by colons; doubles at six places, halves up."""
    return F.concat_ws(":", *parts)


def cache_number(value: Column) -> Column:
    return F.format_number(F.floor(value * 1e6 + 0.5) / 1e6, "0.######")


def quantised(value: Column) -> Column:
    return F.format_string("%.5f", value)


def property_path(json: Column, path: str) -> Column:
    """A dotted path of a JSON text."""
    return F.get_json_object(json, "$." + path)


#: Ways in which ids are made, best first. Fixed values.
STABILITY = ("official-code", "source-stable-code", "source-id", "source-disambiguated", "name-parent-fallback")


def stability(official: Column, stable: Column, source: Column, disambiguator: Column) -> Column:
    """Which of STABILITY an id has."""
    by_code = F.when(official.isNotNull(), "official-code").when(stable.isNotNull(), "source-stable-code").when(source.isNotNull(), "source-id")
    return F.when(disambiguator.isNotNull(), "source-disambiguated").otherwise(by_code.otherwise("name-parent-fallback"))


def content_id(*parts: Column) -> Column:
    """feature- and sixteen hex digits of the SHA-256 of the parts."""
    return F.concat(F.lit("feature-"), F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 16))


def local_type(value: Column, expected: Column) -> Column:
    """The type if it is among the expected ones, else the last of those."""
    return F.when(F.array_contains(expected, value), value).otherwise(F.element_at(expected, -1))
