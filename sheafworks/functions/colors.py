"""Colour columns: luminance, conversions, hex and HSL, filters, alpha."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafworks.functions.tables import half_up

#: Weights of red, green and blue in the two grey formulas.
GRAY, SCREEN = (0.3, 0.59, 0.11), (0.299, 0.587, 0.114)


def luminance(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = GRAY) -> Column:
    return F.lit(weights[0]) * r + F.lit(weights[1]) * g + F.lit(weights[2]) * b


def gray_pixels(pixels: DataFrame) -> DataFrame:
    """r, g and b become the rounded luminance."""
    gray = half_up(luminance(F.col("r"), F.col("g"), F.col("b"))).cast("int")
    return pixels.withColumns({"r": gray, "g": gray, "b": gray})


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, Column, Column]:
    return tuple(F.lit(1.0) - F.least(F.lit(1.0), x + k) for x in (c, m, y))


def gray_color_ops(ops: DataFrame) -> DataFrame:
    """Colour-setting operators become one-number grey operators; other operators and arities stay."""
    a = [F.get("args", F.lit(i)) for i in range(4)]
    n = F.size("args")
    cmyk, rgb = luminance(*cmyk_to_rgb(*a)), luminance(*a[:3])
    low = F.lower("op")
    gray = (
        F.when(low == "rg", rgb).when(low == "k", cmyk)
        .when(low.isin("sc", "scn"), F.when(n == 1, a[0]).when(n == 3, rgb).when(n == 4, cmyk))
    )
    out = ops.withColumn("_gray", gray)
    name = F.when(F.col("op") == low, "g").otherwise("G")
    return out.select("op_id", F.when(F.col("_gray").isNotNull(), name).otherwise(F.col("op")).alias("op"), F.when(F.col("_gray").isNotNull(), F.array("_gray")).otherwise(F.col("args")).alias("args"))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0") for x in (r, g, b)])


def hex_to_rgb(text: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness in percent, rounded."""
    r, g, b = (x.cast("double") / F.lit(255.0) for x in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / F.lit(2.0)
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (F.lit(2.0) - high - low)).otherwise(d / (high + low))
    hue = (
        F.when(d == 0, 0.0).when(high == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0))
        .when(high == g, (b - r) / d + F.lit(2.0)).otherwise((r - g) / d + F.lit(4.0))
    ) / F.lit(6.0)
    return half_up(hue * 360).cast("int"), half_up(sat * 100).cast("int"), half_up(light * 100).cast("int")


def clamp(x: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))


def filter_matrices(saturate: float, grayscale: float, sepia: float, hue: float) -> list[list[list[float]]]:
    """The public filter-effects matrices, in the order in which they are applied."""
    s, a, p = saturate, 1 - grayscale, 1 - sepia
    c, n = math.cos(math.radians(hue)), math.sin(math.radians(hue))
    return [
        [[0.213 + 0.787 * s, 0.715 - 0.715 * s, 0.072 - 0.072 * s], [0.213 - 0.213 * s, 0.715 + 0.285 * s, 0.072 - 0.072 * s], [0.213 - 0.213 * s, 0.715 - 0.715 * s, 0.072 + 0.928 * s]],
        [[0.2126 + 0.7874 * a, 0.7152 - 0.7152 * a, 0.0722 - 0.0722 * a], [0.2126 - 0.2126 * a, 0.7152 + 0.2848 * a, 0.0722 - 0.0722 * a], [0.2126 - 0.2126 * a, 0.7152 - 0.7152 * a, 0.0722 + 0.9278 * a]],
        [[0.393 + 0.607 * p, 0.769 - 0.769 * p, 0.189 - 0.189 * p], [0.349 - 0.349 * p, 0.686 + 0.314 * p, 0.168 - 0.168 * p], [0.272 - 0.272 * p, 0.534 - 0.534 * p, 0.131 + 0.869 * p]],
        [[0.213 + 0.787 * c - 0.213 * n, 0.715 - 0.715 * c - 0.715 * n, 0.072 - 0.072 * c + 0.928 * n], [0.213 - 0.213 * c + 0.143 * n, 0.715 + 0.285 * c + 0.140 * n, 0.072 - 0.072 * c - 0.283 * n], [0.213 - 0.213 * c - 0.787 * n, 0.715 - 0.715 * c + 0.715 * n, 0.072 + 0.928 * c + 0.072 * n]],
    ]


def css_filter(pixels: DataFrame, brightness: float = 1, contrast: float = 1, saturate: float = 1, grayscale: float = 0, sepia: float = 0, hue_rotate: float = 0, invert: float = 0) -> DataFrame:
    """The chain brightness, contrast, saturate, grayscale, sepia, hue-rotate, invert, clamped after each step."""
    out = pixels.select(*[c for c in pixels.columns if c not in "rgb"], *[clamp(F.col(c) * F.lit(float(brightness))).alias(c) for c in "rgb"])
    step = lambda df, f: df.withColumns({c: clamp(f(F.col(c))) for c in "rgb"})
    out = step(out, lambda x: (x - F.lit(127.5)) * F.lit(float(contrast)) + F.lit(127.5))
    for m in filter_matrices(saturate, grayscale, sepia, hue_rotate):
        out = out.withColumns({c: clamp(F.lit(m[i][0]) * F.col("r") + F.lit(m[i][1]) * F.col("g") + F.lit(m[i][2]) * F.col("b")) for i, c in enumerate("rgb")})
    out = step(out, lambda x: x * F.lit(1.0 - 2 * invert) + F.lit(255.0 * invert))
    return out.withColumns({c: half_up(F.col(c)).cast("int") for c in "rgb"}).select(*pixels.columns)


def flatten_alpha(pixels: DataFrame, background: tuple[int, int, int] = (255, 255, 255)) -> DataFrame:
    """Composited over a colour; alpha becomes 255."""
    a = F.col("a").cast("double") / F.lit(255.0)
    cols = {c: half_up(a * F.col(c) + (F.lit(1.0) - a) * F.lit(float(v))).cast("int") for c, v in zip("rgb", background, strict=True)}
    return pixels.withColumns(cols | {"a": F.lit(255)})
