"""One picture that shows two: what to store so that it looks like one on white and like the other on black.

A stored pixel (opacity a, colour c) looks c*a/255 + 255 - a on white and c*a/255 on black. All of it is built-in
arithmetic on columns; channels are lists of three columns, red, green, blue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Channels = list[Column]


def luma(c: Channels) -> Column:
    return (299 * c[0] + 587 * c[1] + 114 * c[2]) / F.lit(1000.0)


def byte(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


def bounded(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def appearances(light: Channels, dark: Channels, strength: float) -> tuple[Channels, Channels]:
    """What each ground should show: the light picture in the upper half of the range, the dark one in the lower, with
    `strength` (0 to 1) of their colour."""
    part = lambda c, base: [base + (luma(c) + (v - luma(c)) * strength) * 0.5 for v in c]
    return part(light, F.lit(127.5)), part(dark, F.lit(0.0))


def opacity(white: Channels, black: Channels) -> Column:
    """The opacity of least squared error over both looks and all channels.

    The error's slope in a is piecewise linear: each channel adds 2a - 2p, and beyond its break point t only
    a - 2p + t, p being black, or 255 - white where white + black < 255. The zero lies on one of four pieces.
    """
    breaks = F.array_sort(F.array(*[F.abs(w + b - 255) for w, b in zip(white, black)]))
    pull = sum((F.when(w + b >= 255, 2 * b).otherwise(2 * (255 - w)) for w, b in zip(white, black)), F.lit(0.0))
    pieces, past = [], F.lit(0.0)
    for k in range(3):
        zero = (pull - past) / (6 - k)
        pieces.append(F.when(zero <= breaks[k], zero))
        past = past + breaks[k]
    return F.coalesce(*pieces, (pull - past) / 3)


def stored(white: Channels, black: Channels, a: Column) -> Channels:
    """The colours to store under an opacity."""
    return [F.when(a == 0, 0).otherwise(byte(bounded((w + b - 255 + a) / 2, F.lit(0), a) * 255 / a)) for w, b in zip(white, black)]


def staged(pixels: DataFrame, name: str, channels: Channels) -> tuple[DataFrame, Channels]:
    """The channels as columns of their own, so that what is used many times is computed once."""
    names = [f"_{name}{i}" for i in range(len(channels))]
    return pixels.withColumns(dict(zip(names, channels))), [F.col(n) for n in names]


def shown(pixels: DataFrame, parts: Channels, *keys: str) -> DataFrame:
    return pixels.select(*keys, *[c.cast("int").alias(n) for c, n in zip(parts, ("alpha", "red", "green", "blue"))])


def reveal(pixels: DataFrame, light: Channels, dark: Channels, strength: float, *keys: str) -> DataFrame:
    """(keys, alpha, red, green, blue)."""
    p, light = staged(pixels, "l", light)
    p, dark = staged(p, "d", dark)
    white, black = appearances(light, dark, strength)
    p, white = staged(p, "w", white)
    p, black = staged(p, "b", black)
    p, (a,) = staged(p, "a", [byte(opacity(white, black))])
    return shown(p, [a, *stored(white, black, a)], *keys)


def true_on_black(black: Channels, white_luma: Column) -> Channels:
    """Opacity and colours that show `black` as it is, and on white come near a brightness."""
    a = F.greatest(F.ceil(F.greatest(*black)).cast("int"), byte(255 + (black[0] + black[1] + black[2]) / 3 - white_luma))
    return [a, *[F.when(a == 0, 0).otherwise(byte(b * 255 / a)) for b in black]]


def tone(y: Column, low: Column, high: Column, start: Column, end: Column) -> Column:
    """Brightness mapped from a range to another; ranges narrower than 16 count as the whole."""
    narrow = high - low < 16
    low, high = F.when(narrow, 0).otherwise(low), F.when(narrow, 255).otherwise(high)
    return start + (end - start) * bounded((y - low) / (high - low), F.lit(0.0), F.lit(1.0))


def gamut(at: Column, chroma: Column) -> Column:
    """How much of a channel's difference from its brightness fits into 0 to 255."""
    return F.when(chroma > 0, (255 - at) / chroma).when(chroma < 0, -at / chroma).otherwise(1.0)


def chroma_budget(contrast: Column, strength: Column) -> Column:
    """The spread of colour allowed at a strength (0 to 100), less at high contrast."""
    return F.when(strength == 0, 0.0).otherwise(bounded(16 + strength * 0.32 - F.greatest(F.lit(0), contrast - 96) / 48, F.lit(16.0), F.lit(48.0)))


def spread(c: Channels) -> Column:
    return F.greatest(*c) - F.least(*c)


def colour_limit(light: Channels, dark: Channels, light_tone: Column, dark_tone: Column) -> Column:
    """The strength up to which a pixel keeps within 4 levels of spread between the looks and inside the gamut."""
    apart = spread([w - b for w, b in zip(light, dark)])
    fits = [gamut(t, (v - luma(c)) * 0.5) for c, t in ((light, light_tone), (dark, dark_tone)) for v in c]
    return F.least(F.when(apart > 0, F.lit(4.0) / apart).otherwise(1.0), *fits)


def balanced(white: Channels, black: Channels) -> Channels:
    """Opacity and colours where the opacity takes the middle of the channels' differences."""
    apart = [w - b for w, b in zip(white, black)]
    a = byte(255 - (F.least(*apart) + F.greatest(*apart)) * 0.5)
    return [a, *stored(white, black, a)]


def source_coloured(pixels: DataFrame, light: Channels, dark: Channels, white_range: tuple[Column, Column], strength: Column, exposure: Column, limit: Column, *keys: str) -> DataFrame:
    """(keys, alpha, red, green, blue) with the dark picture's own colour, as much as the limit and the gamut allow."""
    p, dark = staged(pixels, "d", dark)
    p, (y, white) = staged(p, "y", [luma(dark), tone(luma(light), *white_range, F.lit(185), F.lit(236))])
    chroma, at, apart = [v - y for v in dark], y * exposure, spread(dark)
    most = strength * exposure
    k = F.least(most, F.when(apart > 0, limit / apart).otherwise(most))
    p, (k,) = staged(p, "k", [F.greatest(F.lit(0.0), F.least(k, *[gamut(at, c) for c in chroma]))])
    p, black = staged(p, "b", [at + c * k for c in chroma])
    p, looks = staged(p, "s", true_on_black(black, white))
    return shown(p, looks, *keys)


def code_module(cover: Channels, ink: Column, low: Column, high: Column, floor: Column) -> Channels:
    """Opacity and gray of a code's module over a cover: on black ink shows 16 and ground 112, on white the cover."""
    white = bounded(F.floor(tone(luma(cover), low, high, floor, F.lit(250.0)) + 0.5), F.lit(181), F.lit(255))
    black = F.when(ink, 16).otherwise(112)
    a = F.floor(255 * (1 - (white - black) / F.lit(250.0)) + 0.5).cast("int")
    return [a, F.when(a == 0, 0).otherwise(F.floor(black * F.lit(255.0) / a + 0.5)).cast("int")]


def dark_first(light: Channels, dark: Channels, strength: float) -> tuple[Column, Channels]:
    """Opacity and colours to store where the look on black counts most: it is exact, and the opacity no lower than it needs, or as
    the lightness of the other picture asks for."""
    _, black = appearances(light, dark, strength)
    needed = F.ceil(F.greatest(*black)).cast("int")
    a = F.greatest(needed, byte(255 + (black[0] + black[1] + black[2]) / 3 - (luma(light) * 0.5 + 127.5)))
    return a, [F.when(a == 0, 0).otherwise(byte(b * 255 / a)) for b in black]
