"""Vector columns: dot products and norms in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def box_valid(box: Column) -> Column:
    """Whether a box (x0, y0, x1, y1 as shares of a page) is one."""
    inside = [(box[k] >= 0) & (box[k] <= 1) for k in ("x0", "y0", "x1", "y1")]
    return F.coalesce(inside[0] & inside[1] & inside[2] & inside[3] & (box["x0"] < box["x1"]) & (box["y0"] < box["y1"]), F.lit(False))
