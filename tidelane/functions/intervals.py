"""Half-open intervals and fragment attributes as column expressions; NULL stands for every missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the longest fragment that a store holds.
MAX_LENGTH = 65_535
_INF = 2**62


def intersect(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return (x0 < y1) & (y0 < x1)


def intersect_with_null(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """A null start is 0 and a null stop is unbounded."""
    low, high = (lambda c: F.coalesce(c, F.lit(0))), (lambda c: F.coalesce(c, F.lit(_INF)))
    return intersect(low(x0), high(x1), low(y0), high(y1))


def midpoint(start: Column, stop: Column) -> Column:
    return start + F.floor((stop - start) / 2).cast("int")


def mapq_min(a: Column, b: Column) -> Column:
    """The smaller of two qualities, ignoring nulls."""
    return F.least(a, b)


def mapq_gte(a: Column, b: Column, threshold: int) -> Column:
    """Unknown quality passes."""
    return F.coalesce(F.least(a, b) >= threshold, F.lit(True))


def gc_dequantize(code: Column) -> Column:
    return (code.cast("double") / F.lit(254.0)).cast("float")


def checked_gc(gc: Column) -> Column:
    """A share outside [0, 1] is an error; missing and NaN values pass."""
    inside = gc.isNull() | F.isnan(gc) | gc.between(0.0, 1.0)
    return F.when(inside, gc).otherwise(F.raise_error(F.concat(F.lit("gc outside [0, 1]: "), gc.cast("string"))).cast("double"))


def _rounded(gc):
    """Python's round(g, 5), by numpy, and one by one only near ties, where the binary value decides."""
    import numpy as np

    g = gc.to_numpy(dtype="float64", na_value=np.nan)
    scaled = g * 1e5
    out = np.rint(scaled) / 1e5
    for k in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6).tolist():
        out[k] = round(float(g[k]), 5)
    return out


@F.pandas_udf(T.DoubleType())
def gc_rounded(gc):
    """The share to five places, by Python's rounding of binary values, which built-in decimal rounding misses on some ties; null for NaN."""
    import pandas as pd

    out = pd.Series(_rounded(gc))
    return out.astype("Float64").mask(out.isna())


@F.pandas_udf(T.ShortType())
def gc_quantize(gc):
    """round(round(gc, 5) * 254), both by Python's rounding."""
    import numpy as np
    import pandas as pd

    code = np.rint(_rounded(gc) * 254)
    return pd.Series(code).astype("Float64").mask(np.isnan(code)).astype("Int16")
