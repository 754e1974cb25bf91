"""Colours as column expressions: schemes over a map's extent, quality ramps, palettes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ends of the quality ramp, and the grey of missing values.
LIGHT, DARK, GREY = (254, 237, 222), (140, 45, 4), (128, 128, 128)
PALETTE = [(166, 206, 227), (31, 120, 180), (178, 223, 138), (51, 160, 44), (251, 154, 153), (227, 26, 28), (253, 191, 111), (255, 127, 0), (202, 178, 214), (106, 61, 154), (255, 255, 153), (177, 89, 40)]


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def fixed(c: tuple[int, int, int]) -> Column:
    return rgb(*(F.lit(v) for v in c))


def hsb(h: Column, s: float, b: Column) -> Column:
    """Red, green and blue of hue (its fraction counts), saturation and brightness in 0 to 1."""
    six = (h - F.floor(h)) * 6
    k = F.floor(six)
    f = six - k
    p, q, t = b * (1 - s), b * (1 - f * s), b * (1 - (1 - f) * s)

    def pick(*by_sector: Column) -> Column:
        chain = F.when(k == 0, by_sector[0])
        for i in range(1, 5):
            chain = chain.when(k == i, by_sector[i])
        return F.floor(chain.otherwise(by_sector[5]) * 255 + 0.5)

    return rgb(pick(b, q, p, p, t, b), pick(t, b, b, q, p, p), pick(p, p, t, b, b, q))


def orthogonal(xf: Column, yf: Column, x_is_hue: bool = True) -> Column:
    hue, dark = (xf, yf) if x_is_hue else (yf, xf)
    return hsb(hue, 0.7, 1 - dark * 0.8)


def radial(xf: Column, yf: Column, middle: tuple[float, float] = (0.5, 0.5), zero_angle: float = 0.0) -> Column:
    """Hue from the counter-clockwise angle around ``middle``, brightness from the distance to it."""
    mx, my = middle
    far = max(math.hypot(cx - mx, cy - my) for cx in (0, 1) for cy in (0, 1))
    angle = F.pmod(F.degrees(F.atan2(yf - my, xf - mx)) + zero_angle, F.lit(360.0))
    return hsb(angle / 360, 0.7, 1 - F.hypot(xf - mx, yf - my) / far * 0.8)


def fractions(sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``sites`` with xf and yf, their place in the extent of their map (0 where it has no width)."""
    by = by or ["map_id"]
    extent = sites.groupBy(*by).agg(*(f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))

    def part(c: str) -> Column:
        return F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo{c}"), F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.lit(0.0))

    return sites.join(extent, by).withColumn("xf", part("x")).withColumn("yf", part("y")).drop("_lox", "_hix", "_loy", "_hiy")


def color_sites(sites: DataFrame, scheme: str = "orthogonal", **options) -> DataFrame:
    """``sites`` with colours by a scheme over each map: orthogonal or radial."""
    f = {"orthogonal": orthogonal, "radial": radial}[scheme]
    return fractions(sites).withColumn("color", f(F.col("xf"), F.col("yf"), **options)).drop("xf", "yf")


def palette_color(number: Column) -> Column:
    """The palette's colours in turn, from number 0."""
    return F.element_at(F.array(*(fixed(c) for c in PALETTE)), (F.pmod(number, F.lit(len(PALETTE))) + 1).cast("int"))


def number_colors(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("color", palette_color(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1))


def _lerp(a: tuple[int, int, int], b: tuple[int, int, int], f: Column) -> Column:
    return rgb(*(F.floor(x + (y - x) * f + 0.5) for x, y in zip(a, b, strict=True)))


def quality_color(v: Column, low: Column, high: Column, high_is_good: bool) -> Column:
    """Light where good, dark where bad; values beyond the ends count as the ends, missing ones are grey."""
    f = F.try_divide(v - low, high - low)
    good = f if high_is_good else 1 - f
    return F.when(f.isNull() | F.isnan(f), fixed(GREY)).otherwise(_lerp(DARK, LIGHT, F.greatest(F.lit(0.0), F.least(F.lit(1.0), good))))


def comparison_color(v: Column, low: float, new_high: float, old_high: float) -> Column:
    """Light to dark up to ``new_high``, on to black at ``old_high``."""
    black = (0, 0, 0)
    first = _lerp(LIGHT, DARK, F.try_divide(v - low, F.lit(float(new_high - low))))
    second = _lerp(DARK, black, F.try_divide(v - new_high, F.lit(float(old_high - new_high))))
    return F.when(v < low, fixed(LIGHT)).when(v > old_high, fixed(black)).when(v <= new_high, first).otherwise(second)
