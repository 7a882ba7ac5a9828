"""Affine transforms, colours and paths as column expressions (single precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: x' = sx x + kx y + tx, y' = ky x + sy y + ty
TRANSFORM = "struct<sx:float,ky:float,kx:float,sy:float,tx:float,ty:float>"
FIELDS = ("sx", "ky", "kx", "sy", "tx", "ty")


def _f(x: Column | str | float) -> Column:
    if isinstance(x, str):
        x = F.col(x)
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def from_row(sx, ky, kx, sy, tx, ty) -> Column:
    return F.struct(*[_f(v).alias(n) for n, v in zip(FIELDS, (sx, ky, kx, sy, tx, ty), strict=True)])


def identity() -> Column:
    return from_row(1, 0, 0, 1, 0, 0)


def from_translate(tx, ty) -> Column:
    return from_row(1, 0, 0, 1, tx, ty)


def from_scale(x, y) -> Column:
    return from_row(x, 0, 0, y, 0, 0)


def translate(t: Column, tx, ty) -> Column:
    return from_row(t["sx"], t["ky"], t["kx"], t["sy"], t["tx"] + _f(tx), t["ty"] + _f(ty))


def scale(t: Column, x, y) -> Column:
    """Scales the rows: the first by ``x``, the second by ``y``."""
    x, y = _f(x), _f(y)
    return from_row(t["sx"] * x, t["ky"] * y, t["kx"] * x, t["sy"] * y, t["tx"] * x, t["ty"] * y)


def concat(t: Column, other: Column) -> Column:
    """``t`` first, then ``other``."""
    a, b = other, t
    return from_row(
        a["sx"] * b["sx"] + a["kx"] * b["ky"],
        a["ky"] * b["sx"] + a["sy"] * b["ky"],
        a["sx"] * b["kx"] + a["kx"] * b["sy"],
        a["ky"] * b["kx"] + a["sy"] * b["sy"],
        a["sx"] * b["tx"] + a["kx"] * b["ty"] + a["tx"],
        a["ky"] * b["tx"] + a["sy"] * b["ty"] + a["ty"],
    )


def product(transforms: Column) -> Column:
    """The transforms of an array applied one after the other."""
    return F.aggregate(transforms, identity(), lambda acc, t: concat(acc, t))


def apply_point(t: Column, x, y) -> Column:
    x, y = _f(x), _f(y)
    return F.struct((t["sx"] * x + t["kx"] * y + t["tx"]).cast("float").alias("x"), (t["ky"] * x + t["sy"] * y + t["ty"]).cast("float").alias("y"))


def page_matrix(width, height, left, bottom, right, top) -> Column:
    """User space to device space: the box fills the device, y turned over."""
    sx = _f(width) / (_f(right) - _f(left))
    sy = _f(height) / (_f(top) - _f(bottom))
    return from_row(sx, 0, 0, -sy, -_f(left) * sx, _f(top) * sy)


def rgb(r, g, b, a=1.0) -> Column:
    return F.struct(*[_f(v).alias(n) for n, v in zip("rgba", (r, g, b, a), strict=True)])


def gray(value) -> Column:
    return rgb(value, value, value)


def cmyk(c, m, y, k) -> Column:
    c, m, y, k = (_f(v) for v in (c, m, y, k))
    one = _f(1.0)
    return rgb(*(((one - v) * (one - k)).cast("float") for v in (c, m, y)))


def luminosity(r, g, b) -> Column:
    """Mask value 0..255 of 8-bit components: weighted, clamped, truncated."""
    raw = _f(0.299) * _f(r) + _f(0.587) * _f(g) + _f(0.114) * _f(b)
    return F.floor(F.least(F.greatest(raw, _f(0)), _f(255))).cast("int")


#: A path is an array of verbs with flat coordinates.
PATH = "array<struct<verb:string,pts:array<float>>>"


def path_transform(path: Column, t: Column) -> Column:
    """Every control point of every segment transformed."""

    def points(pts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(pts) / 2).cast("int") - 1), lambda i: apply_point(t, F.get(pts, 2 * i), F.get(pts, 2 * i + 1)))
        return F.when(F.size(pts) > 0, F.flatten(F.transform(pairs, lambda p: F.array(p["x"], p["y"])))).otherwise(pts)

    return F.transform(path, lambda s: F.struct(s["verb"].alias("verb"), points(s["pts"]).alias("pts")))
