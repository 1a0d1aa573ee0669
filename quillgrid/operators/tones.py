"""Bringing the lightness of a code's squares to what a reader needs, as little as a level asks for.

Pixels are rows (image, y, x, red, green, blue) with parts 0 ... 255; the code's squares have `scale` pixels and stand at (left, top),
`count` along an edge. A square's middle is moved to its target lightness while colours keep their proportions; around the
middle the change fades out, and how far it reaches follows the level. Squares that a reader finds its way by (markers and the
lines between them) change as a whole.

Cases: pixels outside the code, and those whose square is neither dark nor light (null), stay as they are; a null part gives
nulls; repeated pixels are changed alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that are tried one after the other, how wide the change fades out, and the lightness of dark and light squares.
LEVELS, FADE, DARK, LIGHT = (0.28, 0.4, 0.55, 0.72), 0.12, 0.18, 0.82
WEIGHTS = (0.299, 0.587, 0.114)


def functional(row: Column, column: Column, count: int) -> Column:
    """Whether a square belongs to a corner marker with its edge, or to the lines between them."""
    corner = ((column < 8) & (row < 8)) | ((column >= count - 8) & (row < 8)) | ((column < 8) & (row >= count - 8))
    return corner | (column == 6) | (row == 6)


def refined(y: Column, x: Column, parts: list[Column], ink: Column, left: int, top: int, scale: int, count: int, level: Column) -> list[Column]:
    """Red, green and blue of a pixel at a level; ink: whether its square is dark."""
    row, column = F.floor((y - top) / scale), F.floor((x - left) / scale)
    inside = (y >= top) & (x >= left) & (row < count) & (column < count)
    away = lambda at, start: F.abs((F.pmod(at - start, F.lit(scale)) + 0.5) / scale - 0.5)
    reach = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (level / 2 + FADE - F.greatest(away(x, left), away(y, top))) / FADE))
    amount = F.when(functional(row, column, count), F.lit(1.0)).otherwise(reach)
    own = [p / F.lit(255.0) for p in parts]
    light = own[0] * WEIGHTS[0] + own[1] * WEIGHTS[1] + own[2] * WEIGHTS[2]
    darker = F.least(F.lit(1.0), F.lit(DARK) / F.greatest(light, F.lit(0.001)))
    lighter = F.greatest(F.lit(0.0), (F.lit(LIGHT) - light) / F.greatest(1 - light, F.lit(0.001)))
    out = []
    for c, p in zip(own, parts):
        new = F.when(ink, c * darker).otherwise(c + (1 - c) * lighter)
        mixed = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (c * (1 - amount) + new * amount) * 255))).cast("int")
        out.append(F.when(inside & ink.isNotNull(), mixed).otherwise(p))
    return out
