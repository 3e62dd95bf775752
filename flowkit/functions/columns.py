"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name; flow tables have spaces and slashes in theirs."""
    return F.col(f"`{name}`")


def safe_label(label: Column) -> Column:
    return F.translate(F.lower(label), " /", "__")


def bad_value(name: str, dtype: T.DataType) -> Column:
    """Null, NaN or infinite."""
    c = col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return c.isNull()


def parse_number(c: Column) -> Column:
    """Tolerant parse: text that is no number gives null, as do NaN tokens."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def half_even(c: Column, decimals: int = 0) -> Column:
    if decimals == 0:
        return F.rint(c)
    scale = float(10**decimals)
    return F.rint(c * scale) / scale


def sanitize_port(c: Column) -> Column:
    x = parse_number(c)
    clipped = F.greatest(F.lit(1.0), F.least(F.lit(65535.0), F.rint(x)))
    return F.when(x.isNull(), F.lit(1)).otherwise(clipped.cast("int")).cast("int")


def order_hash(seed: int | str, ids: Iterable[str | Column]) -> Column:
    """Seeded md5 of an id; sorting by it is a random order that any engine reproduces.

    Different ids have different texts below the hash: `|` and `\\` are escaped, and null is `\\N`.
    """
    def part(i: str | Column) -> Column:
        text = (col(i) if isinstance(i, str) else i).cast("string")
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\N"))

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *map(part, ids)))


def hash_unit(h: Column) -> Column:
    """Leading 32 bits of a hex hash as a number in [0, 1)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(2**32)


def row_key(cols: Iterable[str]) -> Column:
    """64-bit key for shuffles: equal rows have equal keys. Nulls count with their place."""
    names = list(cols)
    return F.xxhash64(*[col(c) for c in names], *[col(c).isNull() for c in names])


def split_sources(c: Column) -> Column:
    return F.split(c, "\\|")


def argmax_class(proba: Column) -> Column:
    """Position of the largest entry, first one on ties, counted from 0."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def one_hot_vector(pred: Column, k: int) -> Column:
    return F.array(*[F.when(pred == i, 1.0).otherwise(0.0) for i in range(k)])


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def boundary_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def percent_text(share: Column) -> Column:
    return F.when(share.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f%%", share * 100.0))


def bounded_quota(*parts: Column) -> Column:
    """Smallest of the parts, but not below zero."""
    return F.greatest(F.lit(0), F.least(*parts))


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner scheme, highest power first."""
    return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))


# Rational approximation of the normal quantile (Acklam), relative error < 1.2e-9.
_CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
               6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0)
_TAIL_FROM = 0.02425


def inverse_normal(p: Column) -> Column:
    """Quantile function of the standard normal distribution for 0 < p < 1."""
    q = p - 0.5
    r = q * q
    centre = _polynomial(r, _CENTRE_NUM) * q / _polynomial(r, _CENTRE_DEN)

    def tail(side: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.log(side))
        return _polynomial(t, _TAIL_NUM) / _polynomial(t, _TAIL_DEN)

    return (
        F.when(p < _TAIL_FROM, tail(p))
        .when(p > 1.0 - _TAIL_FROM, -tail(F.lit(1.0) - p))
        .otherwise(centre)
    )
