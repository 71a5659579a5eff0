"""Rings as arrays of points: area, role, bounds, quantisation and orientation, in higher-order functions.

A ring is ``array<array<double>>``; nulls stay null, an empty ring has area 0
and no bounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bind


def _turned(ring: Column) -> Column:
    """The ring from its second point on, the first at its end."""
    return F.when(F.size(ring) > 0, F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))).otherwise(ring)


def signed_area2(ring: Column) -> Column:
    """Twice the signed area, terms summed in ring order."""
    terms = F.zip_with(ring, _turned(ring), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def exact_area2(ring: Column) -> Column:
    """Twice the signed area of a ring of integers, exact over 32-bit coordinates."""
    whole = lambda x: x.cast("bigint").cast("decimal(12,0)")
    terms = F.zip_with(ring, _turned(ring), lambda p, q: (whole(p[0]) * whole(q[1]) - whole(q[0]) * whole(p[1])).cast("decimal(38,0)"))
    return F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda s, t: (s + t).cast("decimal(38,0)"))


def ring_role(area2: Column) -> Column:
    """``outer`` for positive, ``inner`` for negative, else ``unknown``."""
    return F.when(area2 > 0, "outer").when(area2 < 0, "inner").otherwise("unknown")


def round_half_up(x: Column) -> Column:
    """To the nearest whole, halves towards plus infinity."""
    return F.when(x - F.floor(x) >= 0.5, F.floor(x) + 1).otherwise(F.floor(x)).cast("bigint")


def bounds(rings: Column) -> Column:
    """(x, y, width, height) of all points of an array of rings, rounded as stored boxes are."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        round_half_up(F.array_min(xs)).alias("x"), round_half_up(F.array_min(ys)).alias("y"),
        round_half_up(F.array_max(xs) - F.array_min(xs)).alias("width"), round_half_up(F.array_max(ys) - F.array_min(ys)).alias("height"),
    )


def quantise(ring: Column) -> Column:
    """Whole coordinates, without points that repeat the one before or close the ring."""
    whole = F.transform(ring, lambda p: F.array(round_half_up(p[0]), round_half_up(p[1])))

    def opened(kept: Column) -> Column:
        closed = (F.size(kept) > 1) & (F.get(kept, F.lit(0)) == F.try_element_at(kept, F.lit(-1)))
        return F.when(closed, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)

    return bind(whole, lambda w: bind(F.filter(w, lambda p, i: (i == 0) | (p != F.get(w, i - 1))), opened))


def normal_ring(ring: Column, role: Column) -> Column:
    """Quantised ring in the written direction (inner positive, outer negative); null if fewer than three points differ."""
    def turned(whole: Column) -> Column:
        positive = bind(whole.cast("array<array<double>>"), signed_area2) > 0
        return F.when(F.size(F.array_distinct(whole)) >= 3, F.when(positive != (role == "inner"), F.reverse(whole)).otherwise(whole))

    return bind(quantise(ring), turned)


def is_full_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a box is the whole image; false where anything is missing."""
    return F.coalesce((x == 0) & (y == 0) & (w == width) & (h == height), F.lit(False))


def is_full_contour(ring: Column, width: Column, height: Column) -> Column:
    """Whether a ring runs along the image's border and encloses all of it."""
    on_border = lambda p: ((p[0] == 0) | (p[0] == width) | (p[1] == 0) | (p[1] == height)) & p[0].between(0, width) & p[1].between(0, height)
    def along(p: Column, q: Column) -> Column:
        return ((p[0] == q[0]) & ((p[0] == 0) | (p[0] == width)) | (p[1] == q[1]) & ((p[1] == 0) | (p[1] == height))) & (p != q)

    edges = F.zip_with(ring, _turned(ring), along)
    return F.coalesce((F.size(ring) >= 4) & F.forall(ring, on_border) & F.forall(edges, lambda e: e) & (F.abs(signed_area2(ring)) == 2 * width * height), F.lit(False))


def inner_before_outer(roles: Column) -> Column:
    """Whether an inner ring stands before the first outer one."""
    inner, outer = F.array_position(roles, "inner"), F.array_position(roles, "outer")
    return (inner > 0) & ((outer == 0) | (inner < outer))
