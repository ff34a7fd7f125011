"""Column rules on codes, texts and keys: classifications, hashes of bytes, levels of a request, tile addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ADMIN_LEVELS

#: Kinds and sources of adjacency edges. Fixed values.
EDGE_TYPES = ("shared-border", "point-touch", "maritime", "logical")
EDGE_SOURCES = ("computed", "manual")
#: Zooms below which a catalog shows levels 0, 1, ... Fixed values.
CATALOG_ZOOMS = (5, 8, 12, 15, 18)
#: Error codes that mean that a source could not be had. Fixed values.
SOURCE_UNAVAILABLE = (
    "COUNTRY_LEVEL_UNAVAILABLE",
    "OFFLINE_SOURCE_LOCK_MISSING",
    "SOURCE_ACQUIRE_FAILED",
    "SOURCE_METADATA_AMBIGUOUS",
    "SOURCE_METADATA_INVALID",
    "SOURCE_METADATA_NOT_FOUND",
    "SOURCE_PROTOCOL_UNSUPPORTED",
    "SOURCE_URL_INVALID",
    "SOURCE_URL_MISSING",
)
#: What a set of error codes comes to, first match first. Fixed values.
OUTCOMES = (
    ("licence-restricted", ("SOURCE_LICENSE_RESTRICTED",)),
    ("stable-id-failed", ("IDENTITY_DUPLICATE_TERRITORY_ID",)),
    ("geometry-repair-failed", ("GEOMETRY_REPAIR_REJECTED",)),
    ("hierarchy-failed", ("PARENT_LEVEL_EMPTY", "PARENT_UNRESOLVED", "PARENT_AMBIGUOUS", "PARENT_CONTAINMENT_FAILED")),
    ("adjacency-failed", ("COUNTRY_ADJACENCY_INVALID", "ARTIFACT_SELF_ADJACENCY")),
    ("validation-failed", ("COUNTRY_LEVEL_DATASET_INVALID", "COUNTRY_CHECKSUM_MISMATCH")),
)
#: What words in an error's text come to, first match first. Fixed values.
ERROR_WORDS = (
    ("performance-deferred", ("timeout", "too_large")),
    ("parse-error", ("parse", "json")),
    ("validation-failed", ("checksum",)),
    ("download-error", ("fetch", "download", "http")),
    ("adjacency-failed", ("adjacency",)),
    ("loader-smoke-failed", ("loader",)),
)
SEMVER = r"^\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?$"


def catalog_level(zoom: Column) -> Column:
    """Level that a catalog shows at a zoom; null without one."""
    out = F.lit(len(CATALOG_ZOOMS))
    for level in reversed(range(len(CATALOG_ZOOMS))):
        out = F.when(zoom < CATALOG_ZOOMS[level], level).otherwise(out)
    return F.when(zoom.isNotNull(), out)


def outcome_of_codes(codes: Column) -> Column:
    """Outcome of an array of error codes; null if there are none."""
    out = F.when(F.forall(codes, lambda c: c.isin(*SOURCE_UNAVAILABLE)), "source-unavailable").otherwise("validation-failed")
    for name, any_of in reversed(OUTCOMES):
        out = F.when(F.arrays_overlap(codes, F.array(*map(F.lit, any_of))), name).otherwise(out)
    return F.when(F.size(codes) > 0, out)


def outcome_of_text(message: Column) -> Column:
    """Outcome of an error's text."""
    low, out = F.lower(message), F.lit("provider-error")
    for name, words in reversed(ERROR_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def admin_level_of(level: Column, given: Column) -> Column:
    """The level named in the zone's metadata, else ADM and its number."""
    return F.coalesce(given, F.concat(F.lit("ADM"), level.cast("string")))


def levels_up_to(levels: Column) -> Column:
    """All levels from the top to the deepest one in the array of numbers."""
    return F.when(F.size(levels) > 0, F.sequence(F.lit(0), F.array_max(levels).cast("int"))).otherwise(F.array().cast("array<int>"))


def format_rank(fmt: Column, preference: Column) -> Column:
    """Place in the list of preferred formats, unknown ones last; 0 for all without a list."""
    at = F.array_position(preference, fmt)
    return F.when(preference.isNull(), 0).when(at > 0, at - 1).otherwise(2**31 - 1).cast("long")


def covers_parent(covered: Column, parent: Column) -> Column:
    """No parent asked for, no restriction, or the parent is in the list."""
    return F.coalesce(parent, F.lit("")).eqNullSafe("") | covered.isNull() | F.coalesce(F.array_contains(covered, parent), F.lit(False))


def numeric_child_id(prefix: str, parent: Column, code: Column) -> Column:
    """prefix, the parent's own part and a code of digits; null if the code has other characters."""
    code = F.trim(code)
    return F.when(code.rlike(r"^\d+$"), F.concat_ws(":", F.lit(prefix), F.regexp_replace(parent, "^[a-z]{2}:adm[0-5]:", ""), code))


def tile_address(template: Column, base: Column) -> Column:
    """A tile template below a base address: absolute ones stay, rooted ones keep the base's host, others its folder."""
    host, folder = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1), F.regexp_extract(base, r"^(.*/)", 1)
    return F.when(template.rlike(r"^[a-z]+://"), template).when(template.startswith("/"), F.concat(host, template)).otherwise(F.concat(folder, template))


def number_text(value: Column) -> Column:
    """A double as the shortest decimal, whole numbers without a point, for values between 1e-3 and 1e7."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def grid_key(x: Column, y: Column, eps: float) -> Column:
    """A point's place on a grid of that width, halves up."""
    at = lambda c: F.floor(c / eps + 0.5).cast("long").cast("string")
    return F.concat_ws(",", at(x), at(y))


def side_key(x1: Column, y1: Column, x2: Column, y2: Column, eps: float) -> Column:
    """The same key for a side in either direction."""
    a, b = grid_key(x1, y1, eps), grid_key(x2, y2, eps)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def fnv_bytes(value: Column, blank_from: int = -1, blank: int = 4) -> Column:
    """32-bit FNV-1a of a binary value as a number; `blank` bytes from blank_from on count as zero."""
    digits = F.hex(value)
    count = F.octet_length(value)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    units = F.transform(places, lambda i: F.when((i >= blank_from) & (i < blank_from + blank) & (F.lit(blank_from) >= 0), 0).otherwise(F.conv(F.substring(digits, i * 2 + 1, 2), 16, 10)).cast("long"))

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(u)
        return (F.shiftleft(x.bitwiseAND(F.lit(0xFF)), 24) + x * 403).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)


def safe_path(value: Column) -> Column:
    """A relative path that does not leave its folder."""
    return F.coalesce((F.trim(value) != "") & ~value.rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:"), F.lit(False))


def safe_url(value: Column) -> Column:
    """http, https, file, or a safe relative path."""
    v = F.trim(value)
    scheme = v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.coalesce(F.when(scheme, v.rlike("^(?i)(https?|file):")).otherwise(safe_path(v)), F.lit(False))


def valid_level(value: Column) -> Column:
    return F.coalesce(value.isin(*ADMIN_LEVELS), F.lit(False))
