"""Expressions on float arrays and other scalars; all arithmetic is in DOUBLE and lower distance means nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("COSINE", "L2", "DOT")
#: Decimals by which distances are compared, so that equal vectors tie whatever the order of summation.
TIE_DECIMALS = 12


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if a side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance from the differences, so near-equal vectors lose no digits."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """L2 is the root, COSINE is 1 - dot of normalised vectors, DOT is -dot."""
    if metric == "L2":
        return l2(a, b)
    return F.lit(1.0) - dot(a, b) if metric == "COSINE" else -dot(a, b)


def normalise(a: Column | str) -> Column:
    """Scaled to norm 1 as floats; null for a zero vector and for one whose norm is not finite."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def all_finite(a: Column | str) -> Column:
    """Whether every element is a finite number; null for a null array."""
    return F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def is_zero(a: Column | str) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def voxel_key(x: Column, y: Column, z: Column, grid: int) -> Column:
    """Number of the voxel of a point of the cube [-1, 1] in a grid of ``grid`` cells a side; outer points are clipped."""
    cell = lambda c: F.greatest(F.least(F.floor((c + 1.0) * 0.5 * grid), F.lit(grid - 1)), F.lit(0)).cast("bigint")
    return cell(x) * (grid * grid) + cell(y) * grid + cell(z)


def luminance(hex_colour: Column) -> Column:
    """WCAG relative luminance of '#rrggbb'."""
    def channel(at: int) -> Column:
        c = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return channel(2) * 0.2126 + channel(4) * 0.7152 + channel(6) * 0.0722


def contrast_ratio(a: Column, b: Column) -> Column:
    """WCAG contrast of two colours, from 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def smoothstep(t: Column) -> Column:
    return t * t * (F.lit(3.0) - t * 2.0)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; 0 where all values are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.when(value.isNotNull(), F.lit(0.0)))


def from_half(raw: Column, dim: int) -> Column:
    """Floats from ``dim`` little-endian half-precision numbers in a binary column; null for another length.

    A half has a sign, 5 bits of exponent and 10 of fraction; zeros, subnormal numbers, infinities and NaN are all kept.
    """
    def number(i: Column) -> Column:
        byte = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
        bits = byte(i * 2 + 1) + F.shiftleft(byte(i * 2 + 2), 8)
        sign = F.when(bits >= 32768, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
        finite = F.when(exponent == 0, fraction * 2.0**-24).otherwise((fraction / 1024.0 + 1.0) * F.pow(F.lit(2.0), exponent - 15))
        special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        return (sign * F.when(exponent == 31, special).otherwise(finite)).cast("float")

    return F.when(F.octet_length(raw) == 2 * dim, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), number))


def colour_ramp(value: Column, stops: list[str]) -> Column:
    """'#rrggbb' of a value in [0, 1] on a ramp of evenly spaced colours; values outside are clipped, null and NaN stay null."""
    if len(stops) < 2:
        raise ValueError("a ramp needs two colours or more")
    t = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    at = F.least(F.floor(t), F.lit(len(stops) - 2)).cast("int")

    def channel(first: int) -> Column:
        table = F.array(*[F.lit(float(int(s[first : first + 2], 16))) for s in stops])
        low, high = F.get(table, at), F.get(table, at + 1)
        return F.lpad(F.lower(F.hex(F.round(lerp(low, high, t - at)).cast("bigint"))), 2, "0")

    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.concat(F.lit("#"), channel(1), channel(3), channel(5)))
