"""Dense vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return text.let(F.struct(a.alias("v"), F.sqrt(dot(a, a)).alias("length")), lambda x: F.transform(x["v"], lambda c: F.when(x["length"] > 0, c / x["length"]).otherwise(c.cast("double"))))
