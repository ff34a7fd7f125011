"""Planar geometry as Column builders over polys: array<polygon: array<ring: array<struct<x double, y double>>>>.

Rings are closed. Python functions build the expressions, since SQL functions cannot be used inside lambdas. Distances
in metres are great-circle ones. NaN coordinates match nothing: every predicate is false for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres; the unit of shared borders follows from it. A fixed value.
EARTH_RADIUS = 6_371_008.8
#: Tolerance of the query predicates: the spacing of doubles at one. A fixed value.
TIGHT = 2.220446049250313e-16
#: Tolerance of the topology and quality predicates. A fixed value.
LOOSE = 1e-9
POLYS = "array<array<array<struct<x:double,y:double>>>>"
RING = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once."""
    return F.transform(F.array(value), body)[0]


def rings(polys: Column) -> Column:
    return F.flatten(polys)


def points(polys: Column) -> Column:
    """All vertices, closing ones included."""
    return F.flatten(F.flatten(polys))


def coordinate_count(polys: Column) -> Column:
    return F.size(points(polys))


def bbox(polys: Column) -> Column:
    """struct(w, s, e, n) over all rings."""
    return let(
        points(polys),
        lambda p: F.struct(
            F.array_min(F.transform(p, lambda v: v["x"])).alias("w"),
            F.array_min(F.transform(p, lambda v: v["y"])).alias("s"),
            F.array_max(F.transform(p, lambda v: v["x"])).alias("e"),
            F.array_max(F.transform(p, lambda v: v["y"])).alias("n"),
        ),
    )


def segments(ring: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of a closed ring."""
    both = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), both)


def _sum(array: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + term(v))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive if counter-clockwise."""
    return _sum(segments(ring), lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]) / 2


def area(polys: Column, clamp: bool = True) -> Column:
    """Shells minus holes; a polygon whose holes exceed its shell counts 0 with clamp."""

    def one(p: Column) -> Column:
        shell = F.abs(signed_area(p[0]))
        left = shell - _sum(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: F.abs(signed_area(r)))
        return F.greatest(left, F.lit(0.0)) if clamp else left

    return _sum(polys, one)


def ring_centroid(ring: Column) -> Column:
    """struct(x, y); the first vertex where the area is zero."""

    def by_area(a: Column) -> Column:
        cross = lambda s: s["x1"] * s["y2"] - s["x2"] * s["y1"]
        x = _sum(segments(ring), lambda s: (s["x1"] + s["x2"]) * cross(s))
        y = _sum(segments(ring), lambda s: (s["y1"] + s["y2"]) * cross(s))
        flat = F.struct(ring[0]["x"].alias("x"), ring[0]["y"].alias("y"))
        return F.when(a == 0, flat).otherwise(F.struct((x / F.nullif(a * 6, F.lit(0.0))).alias("x"), (y / F.nullif(a * 6, F.lit(0.0))).alias("y")))

    return let(signed_area(ring), by_area)


def center(polys: Column) -> Column:
    """Centroids of the shells weighted by area, holes ignored; the bbox's middle where the weight is zero."""
    shells = F.filter(F.transform(polys, lambda p: p[0]), lambda r: F.size(r) >= 4)
    parts = F.transform(shells, lambda r: F.struct(F.abs(signed_area(r)).alias("a"), ring_centroid(r).alias("c")))

    def weigh(p: Column) -> Column:
        total = _sum(p, lambda v: v["a"])
        mean = lambda k: _sum(p, lambda v: v["a"] * v["c"][k]) / F.nullif(total, F.lit(0.0))
        b = bbox(polys)
        middle = F.struct(((b["w"] + b["e"]) / 2).alias("x"), ((b["s"] + b["n"]) / 2).alias("y"))
        return F.when(total == 0, middle).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))

    return let(parts, weigh)


def largest_shell(polys: Column) -> Column:
    """The outer ring of the greatest area, the first of equals."""
    ranked = F.transform(polys, lambda p, i: F.struct(F.abs(signed_area(p[0])).alias("a"), (-i).alias("i"), p[0].alias("r")))
    return F.array_max(F.transform(ranked, lambda v: F.struct(v["a"].alias("a"), v["i"].alias("i"), v["r"].alias("r"))))["r"]


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(y1), F.radians(y2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0)))) * 2 * EARTH_RADIUS


def round_half_up(value: Column, places: int) -> Column:
    """Rounded with halves toward plus infinity."""
    return F.floor(value * 10**places + 0.5) / 10**places


# ---------------------------------------------------------------- points and rings


def cross(px: Column, py: Column, s: Column) -> Column:
    return (py - s["y1"]) * (s["x2"] - s["x1"]) - (px - s["x1"]) * (s["y2"] - s["y1"])


def on_segment(px: Column, py: Column, s: Column, eps: float = TIGHT) -> Column:
    pad = 0.0 if eps == TIGHT else eps
    within = (px >= F.least(s["x1"], s["x2"]) - pad) & (px <= F.greatest(s["x1"], s["x2"]) + pad)
    within = within & (py >= F.least(s["y1"], s["y2"]) - pad) & (py <= F.greatest(s["y1"], s["y2"]) + pad)
    return (F.abs(cross(px, py, s)) <= eps) & within


def crosses_ray(px: Column, py: Column, s: Column) -> Column:
    """The segment crosses the ray to the right of the point, half-open in y."""
    return ((s["y1"] > py) != (s["y2"] > py)) & (px < (s["x2"] - s["x1"]) * (py - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])


def ring_parity(px: Column, py: Column, ring: Column) -> Column:
    return F.size(F.filter(segments(ring), lambda s: F.coalesce(crosses_ray(px, py, s), F.lit(False)))) % 2 == 1


def on_ring(px: Column, py: Column, ring: Column, eps: float = TIGHT) -> Column:
    return F.exists(segments(ring), lambda s: on_segment(px, py, s, eps))


def in_ring(px: Column, py: Column, ring: Column, covers: bool, eps: float = TIGHT) -> Column:
    return F.when(on_ring(px, py, ring, eps), F.lit(covers)).otherwise(ring_parity(px, py, ring))


def _holes(p: Column) -> Column:
    return F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))


def _no_nan(px: Column, py: Column, found: Column) -> Column:
    return ~F.isnan(px) & ~F.isnan(py) & found


def pip_query(px: Column, py: Column, polys: Column, covers: bool = True) -> Column:
    """Query semantics: the shell's edge counts with covers, a hole's edge is always outside."""
    return _no_nan(px, py, F.exists(polys, lambda p: in_ring(px, py, p[0], covers) & ~F.exists(_holes(p), lambda h: in_ring(px, py, h, True))))


def pip_cover(px: Column, py: Column, polys: Column, eps: float = LOOSE) -> Column:
    """Topology semantics: edges of shells and of holes are covered."""
    return _no_nan(px, py, F.exists(polys, lambda p: in_ring(px, py, p[0], True, eps) & ~F.exists(_holes(p), lambda h: in_ring(px, py, h, False, eps))))


def pip_parity(px: Column, py: Column, polys: Column) -> Column:
    """Hierarchy semantics: half-open parity alone, without a rule for edges."""
    return _no_nan(px, py, F.exists(polys, lambda p: ring_parity(px, py, p[0]) & ~F.exists(_holes(p), lambda h: ring_parity(px, py, h))))


def pip_repair(px: Column, py: Column, polys: Column) -> Column:
    """Repair semantics: the shell's edge counts within 1e-9, holes by parity, also for the point moved by 360 degrees."""
    plain = lambda x, q: F.exists(q, lambda p: in_ring(x, py, p[0], True, LOOSE) & ~F.exists(_holes(p), lambda h: ring_parity(x, py, h)))
    moved = F.transform(polys, lambda p: F.transform(p, unwrap))
    return _no_nan(px, py, plain(px, polys) | plain(px, moved) | plain(px - 360, moved) | plain(px + 360, moved))


def representative_point(polys: Column) -> Column:
    """The centroid if covered, else the first vertex of the largest shell."""
    return let(center(polys), lambda c: F.when(pip_cover(c["x"], c["y"], polys), c).otherwise(largest_shell(polys)[0]))


# ---------------------------------------------------------------- segments


def segment_of(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _sides(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    return cross(a["x1"], a["y1"], b), cross(a["x2"], a["y2"], b), cross(b["x1"], b["y1"], a), cross(b["x2"], b["y2"], a)


def properly_cross(a: Column, b: Column, eps: float = 0.0) -> Column:
    d1, d2, d3, d4 = _sides(a, b)
    apart = lambda p, q: ((p > eps) & (q < -eps)) | ((p < -eps) & (q > eps))
    return apart(d1, d2) & apart(d3, d4)


def segments_intersect(a: Column, b: Column, eps: float = TIGHT) -> Column:
    """Proper crossing or an end point on the other segment."""
    ends = on_segment(a["x1"], a["y1"], b, eps) | on_segment(a["x2"], a["y2"], b, eps) | on_segment(b["x1"], b["y1"], a, eps) | on_segment(b["x2"], b["y2"], a, eps)
    return properly_cross(a, b) | ends


def geometry_intersects(a: Column, b: Column, covers: bool = True) -> Column:
    """A vertex of one in the other (holes' vertices too), or segments that meet; touching counts in either mode."""
    inside = lambda p, q: F.exists(points(p), lambda v: pip_query(v["x"], v["y"], q, covers))
    of = lambda g: F.flatten(F.transform(rings(g), segments))
    return inside(a, b) | inside(b, a) | F.exists(of(a), lambda s: F.exists(of(b), lambda t: segments_intersect(s, t)))


def geometry_covers(a: Column, b: Column, eps: float = LOOSE) -> Column:
    """Every vertex of b's shells is covered by a; edges are not tested."""
    return F.forall(F.flatten(F.transform(b, lambda p: p[0])), lambda v: pip_cover(v["x"], v["y"], a, eps))


# ---------------------------------------------------------------- rings made anew


def wrap_longitude(x: Column) -> Column:
    """Into -180 .. 180; 180 itself stays."""
    return F.when((x >= -180) & (x <= 180), x).otherwise(F.pmod(x + 180, F.lit(360.0)) - 180)


def unwrap(ring: Column) -> Column:
    """A ring whose jumps of over 180 degrees are undone, vertex by vertex."""

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)["x"]
        x = F.when(F.size(acc) == 0, v["x"]).otherwise(v["x"] - 360 * F.floor((v["x"] - last + 180) / 360))
        return F.array_append(acc, F.struct(x.alias("x"), v["y"].alias("y")))

    return F.aggregate(ring, F.array().cast(RING), step)


def decimate(ring: Column, step: int) -> Column:
    """Every step-th vertex, the first and last always; rings of up to six vertices, or left with under four, stay."""
    kept = F.filter(ring, lambda v, i: (i % step == 0) | (i == F.size(ring) - 1))
    return F.when((F.size(ring) <= 6) | (F.size(kept) < 4), ring).otherwise(kept)


def simplify(polys: Column, step: int) -> Column:
    return F.transform(polys, lambda p: F.transform(p, lambda r: decimate(r, step))) if step > 1 else polys


def without_repeats(ring: Column) -> Column:
    """A ring without consecutive equal vertices."""
    return F.filter(ring, lambda v, i: (i == 0) | (v != F.get(ring, i - 1)))


def closed(ring: Column) -> Column:
    return F.when((F.size(ring) > 0) & (ring[0] != F.element_at(ring, -1)), F.array_append(ring, ring[0])).otherwise(ring)


def rounded(ring: Column, places: int = 6) -> Column:
    return F.transform(ring, lambda v: F.struct(round_half_up(v["x"], places).alias("x"), round_half_up(v["y"], places).alias("y")))


def normalise_ring(ring: Column, places: int = 6) -> Column:
    """Rounded, without repeats, closed."""
    return let(without_repeats(rounded(ring, places)), closed)


def oriented(ring: Column, counter_clockwise: bool) -> Column:
    a = signed_area(ring)
    return F.when(a < 0 if counter_clockwise else a > 0, F.reverse(ring)).otherwise(ring)
