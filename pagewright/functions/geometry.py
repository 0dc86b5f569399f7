"""Geometry as Column expressions. The origin is at the top left; y grows downward.

A box is a struct of four labelled corners: tlx, tly, trx, try, blx, bly, brx, bry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("tlx", "tly", "trx", "try", "blx", "bly", "brx", "bry")
ORIENTATION_TOLERANCE = 10e-5


def box(*corners: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(corners, CORNERS, strict=True)])


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)).cast("float")


def weighted_euclidean(x1: Column, y1: Column, x2: Column, y2: Column, wx: float = 1.0, wy: float = 1.0) -> Column:
    return F.sqrt(wx * (x2 - x1) * (x2 - x1) + wy * (y2 - y1) * (y2 - y1)).cast("float")


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (F.abs(x2 - x1) + F.abs(y2 - y1)).cast("float")


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from point 1 to point 2."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1)).cast("float")


def bound_180(a: Column) -> Column:
    """[-180, 180)."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def bound_360(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def almost_zero(x: Column, eps: float = 1e-3) -> Column:
    return F.abs(x) < eps


def width(b: Column) -> Column:
    return F.sqrt((b["brx"] - b["blx"]) ** 2 + (b["bry"] - b["bly"]) ** 2)


def height(b: Column) -> Column:
    return F.sqrt((b["tlx"] - b["blx"]) ** 2 + (b["tly"] - b["bly"]) ** 2)


def rotation(b: Column) -> Column:
    return F.degrees(F.atan2(b["bry"] - b["bly"], b["brx"] - b["blx"]))


def centroid(b: Column) -> tuple[Column, Column]:
    return (b["tlx"] + b["trx"] + b["blx"] + b["brx"]) / 4, (b["tly"] + b["try"] + b["bly"] + b["bry"]) / 4


def orientation(b: Column) -> Column:
    """Horizontal, Rotate180, Rotate90 or Rotate270 from the base line; Other if it is oblique."""
    dx, dy = b["brx"] - b["blx"], b["bry"] - b["bly"]
    flat, upright = F.abs(dy) < ORIENTATION_TOLERANCE, F.abs(dx) < ORIENTATION_TOLERANCE
    return F.when(flat & (dx >= 0), "Horizontal").when(flat, "Rotate180").when(upright & (dy > 0), "Rotate270").when(upright, "Rotate90").otherwise("Other")


def group_orientation(o: Column) -> Column:
    """Aggregate: the common orientation, else Other."""
    return F.when(F.min(o) == F.max(o), F.min(o)).otherwise("Other")


def is_mirrored(b: Column) -> Column:
    """Whether the corners run the other way round: positive cross product of the top and left edges."""
    return (b["trx"] - b["tlx"]) * (b["tly"] - b["bly"]) - (b["try"] - b["tly"]) * (b["tlx"] - b["blx"]) > 0


def unmirror(b: Column) -> Column:
    """Top and bottom corners change places in a mirrored box."""
    swapped = box(b["blx"], b["bly"], b["brx"], b["bry"], b["tlx"], b["tly"], b["trx"], b["try"])
    return F.when(is_mirrored(b), swapped).otherwise(b)


def invert_y(y: Column, page_height: Column) -> Column:
    return page_height - y


def axis_aligned(b: Column) -> Column:
    """The upright box around a box."""
    xs, ys = [b[c] for c in CORNERS[::2]], [b[c] for c in CORNERS[1::2]]
    x0, x1, y0, y1 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    return box(x0, y0, x1, y0, x0, y1, x1, y1)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct s, x, y: foot of point p on line a-b and its place s (0 at a, 1 at b); null on zero length."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    s = F.when(n > 0, ((px - ax) * dx + (py - ay) * dy) / F.when(n > 0, n))
    return F.struct(s.alias("s"), (ax + s * dx).alias("x"), (ay + s * dy).alias("y"))


def intersects(l1: Column, t1: Column, r1: Column, b1: Column, l2: Column, t2: Column, r2: Column, b2: Column) -> Column:
    return (l1 < r2) & (l2 < r1) & (t1 < b2) & (t2 < b1)


def overlaps(top1: Column, bottom1: Column, top2: Column, bottom2: Column) -> Column:
    """1-D overlap; touching counts."""
    return ~((top1 > bottom2) | (bottom1 < top2))


def intersection_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def intersection(x0: Column, y0: Column, x1: Column, y1: Column, u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """Struct x, y, w, h, area of what two upright boxes share; no width or height where they don't meet."""
    left, top = F.greatest(x0, u0), F.greatest(y0, v0)
    w, h = intersection_length(x0, x1, u0, u1), intersection_length(y0, y1, v0, v1)
    return F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"))


def bbox_from_array(b: Column) -> Column:
    """[x1, y1, x2, y2] as x, y, w, h; zeros with fewer than four numbers."""
    def at(i: int) -> Column:
        return F.when(F.size(b) >= 4, F.get(b, F.lit(i))).otherwise(0.0)

    return F.struct(at(0).alias("x"), at(1).alias("y"), (at(2) - at(0)).alias("w"), (at(3) - at(1)).alias("h"))


def bbox_normalised(b: Column, page_w: Column, page_h: Column) -> Column:
    """As above, divided by the page size if the far corner exceeds 1000; sizes are at least 0."""
    pixels = F.coalesce((page_w > 0) & (page_h > 0) & ((F.get(b, F.lit(2)) > 1000) | (F.get(b, F.lit(3)) > 1000)), F.lit(False))
    whole = F.size(b) >= 4

    def at(i: int) -> Column:
        by = page_w if i % 2 == 0 else page_h
        return F.when(whole, F.when(pixels, F.get(b, F.lit(i)) / F.when(by > 0, by)).otherwise(F.get(b, F.lit(i)))).otherwise(0.0)

    zero = F.lit(0.0)
    return F.struct(at(0).alias("x"), at(1).alias("y"), F.greatest(zero, at(2) - at(0)).alias("w"), F.greatest(zero, at(3) - at(1)).alias("h"))


def vertical(y1: Column, y2: Column) -> Column:
    return F.abs(y2 - y1).cast("float")


def horizontal(x1: Column, x2: Column) -> Column:
    return F.abs(x2 - x1).cast("float")


def within_line_angle(a: Column, b: Column) -> Column:
    """Degrees from a box's lower right corner to the next one's lower left, against the first's rotation, folded to -90..90; 0 if they meet."""
    turn = bound_180(angle(a["brx"], a["bry"], b["blx"], b["bly"]) - rotation(a))
    folded = F.when(turn > 90, turn - 180).when(turn < -90, turn + 180).otherwise(turn)
    return F.when((a["brx"] == b["blx"]) & (a["bry"] == b["bly"]), 0.0).otherwise(folded)


def between_line_angle(a: Column, b: Column) -> Column:
    """Degrees from centre to centre against the first box's rotation, folded to 0..180."""
    turn = bound_180(angle(*centroid(a), *centroid(b)) - rotation(a))
    return F.when(turn < 0, turn + 180).otherwise(turn)


def perpendicular_gap(a: Column, b: Column) -> Column:
    """What is left between two boxes across the first one's lines; null where they overlap."""
    turn = between_line_angle(a, b)
    folded = F.when(turn > 90, turn - 180).otherwise(turn)
    gap = F.abs(euclidean(*centroid(a), *centroid(b)) * F.cos(F.radians(90 - folded))) - height(a) / 2 - height(b) / 2
    return F.when(gap >= 0, gap)


def blocking(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column, eps: float = 1e-3) -> Column:
    """Struct angle, overlap, distance, overlapped: how segment c-d lies to segment a-b.

    The ends of a-b are carried across to the line of c-d. Of these and c, d the middle two bound what is shared:
    overlap is its length over that of c-d, negative where they don't overlap; distance is that of its middle from a-b, signed.
    Equal segments share all at distance 0; perpendicular or pointlike ones share nothing and have null values.
    """
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    dot = ux * vx + uy * vy
    flat = almost_zero(dot, eps)
    safe = F.when(flat, F.lit(None)).otherwise(dot)

    # The foot on c-d of a point, along the normal of a-b, as a share t of c-d: (p - c) . u = t (v . u).
    def share(px: Column, py: Column) -> Column:
        return ((px - cx) * ux + (py - cy) * uy) / safe

    s, t = share(ax, ay), share(bx, by)
    order = F.array_sort(F.array(s, t, F.lit(0.0), F.lit(1.0)))
    low, high = F.get(order, F.lit(1)), F.get(order, F.lit(2))
    over = (F.greatest(s, t) >= 0) & (F.least(s, t) <= 1)
    mid = (low + high) / 2
    mx, my = cx + mid * vx, cy + mid * vy
    across = F.when(almost_zero(ux, eps), mx - ax).when(almost_zero(uy, eps), my - ay).otherwise(((mx - ax) - (my - ay) * ux / F.when(~almost_zero(uy, eps), uy)) / F.sqrt(ux * ux / F.when(~almost_zero(uy, eps), uy * uy) + 1))
    turn = bound_180(F.degrees(F.atan2(vy, vx) - F.atan2(uy, ux)))
    same = almost_zero(ax - cx, eps) & almost_zero(ay - cy, eps) & almost_zero(bx - dx, eps) & almost_zero(by - dy, eps)
    part = F.when(over, high - low).otherwise(low - high)
    row = lambda a, o, d, yes: F.struct(a.cast("double").alias("angle"), o.cast("double").alias("overlap"), d.cast("double").alias("distance"), yes.alias("overlapped"))
    none = F.lit(None)
    return F.when(same, row(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(True))).when(flat, row(turn, none, none, F.lit(False))).otherwise(row(turn, part, across, over))


def overlapping_distance(found: Column, low: float = -30.0, high: float = 30.0) -> Column:
    """Distance of ``blocking`` if the segments overlap and are parallel enough, else infinity."""
    turn = F.when(found["angle"] > 90, found["angle"] - 180).when(found["angle"] < -90, found["angle"] + 180).otherwise(found["angle"])
    return F.when(found["overlapped"] & turn.between(low, high), F.abs(found["distance"])).otherwise(float("inf"))


def transformed(b: Column, m: Column) -> Column:
    """A box under an affine matrix (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f."""
    def at(x: str, y: str) -> tuple[Column, Column]:
        return m["a"] * b[x] + m["c"] * b[y] + m["e"], m["b"] * b[x] + m["d"] * b[y] + m["f"]

    return box(*[v for x, y in zip(CORNERS[::2], CORNERS[1::2], strict=True) for v in at(x, y)])


def inverted(b: Column, page_height: Column) -> Column:
    """A box of a page whose y grows upward, with y growing downward."""
    return box(*[invert_y(b[c], page_height) if c.endswith("y") else b[c] for c in CORNERS])


def glyph_box(width: Column, ascent: Column, m: Column, page_height: Column, unit: float = 1.0) -> Column:
    """A letter's box: its advance by the ascent of its font (one unit at least), on the page."""
    zero, top = F.lit(0.0), F.greatest(ascent, F.lit(unit))
    return inverted(transformed(box(zero, top, width, top, zero, zero, width, zero), m), page_height)


def drawn_glyph_box(bounds: Column, m: Column, page_height: Column, unit: float = 1.0) -> Column:
    """A letter's box where the font draws its glyphs: the upper corners of its bounds, turned upright, over the base line's."""
    width = bounds["brx"] - bounds["blx"]
    up = unmirror(inverted(transformed(bounds, m), page_height))
    base = glyph_box(width, F.lit(unit), m, page_height, unit)
    return box(up["tlx"], up["tly"], up["trx"], up["try"], base["blx"], base["bly"], base["brx"], base["bry"])
