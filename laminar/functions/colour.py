"""Colour conversions (8-bit ranges: H 0-179, S/V/L/a/b/Cb 0-255) and predicates.

Everything is column arithmetic, so colour tests run inside the scan stage
of the pixel table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HSV bands (low, high) tried for the blue reference dot.
BLUE_BANDS = (
    ((100, 80, 40), (130, 255, 255)),
    ((95, 50, 25), (135, 255, 255)),
    ((100, 30, 15), (130, 220, 200)),
    ((85, 35, 50), (145, 255, 255)),
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _shift12(x: Column) -> Column:
    return F.floor((x + 2048) / 4096)


def hsv_columns(r="r", g="g", b="b") -> dict[str, Column]:
    """Hue, saturation and value with the usual 12-bit fixed-point rounding."""
    r, g, b = _c(r), _c(g), _c(b)
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    s = F.when(v == 0, 0).otherwise(_shift12(d * F.rint(F.lit(1044480.0) / v)))
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.when(d == 0, 0).otherwise(_shift12(turn * F.rint(F.lit(122880.0) / d)))
    return {
        "hue": F.when(h < 0, h + 180).otherwise(h).cast("int"),
        "sat": s.cast("int"),
        "val": v.cast("int"),
    }


def hsv(r="r", g="g", b="b") -> Column:
    return F.struct(*[c.alias(n) for n, c in hsv_columns(r, g, b).items()])


def gray(r="r", g="g", b="b") -> Column:
    return F.floor((_c(r) * 9798 + _c(g) * 19235 + _c(b) * 3735 + 16384) / 32768).cast("int")


def cb(r="r", g="g", b="b") -> Column:
    """Blue-difference chroma."""
    r, g, b = _c(r), _c(g), _c(b)
    y = F.floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384)
    raw = F.floor(((b - y) * 9241 + 128 * 16384 + 8192) / 16384)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(255)).cast("int")


def lab_columns(r="r", g="g", b="b") -> dict[str, Column]:
    """CIE L*a*b* (D65), scaled and shifted to 0-255."""

    def linear(c):
        u = _c(c) / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))

    def f(t):
        return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = f((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = f((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    fy = f(y)
    light = F.when(y > 0.008856, 116.0 * F.pow(y, F.lit(1.0 / 3.0)) - 16.0).otherwise(903.3 * y)

    def byte(v):
        return F.least(F.greatest(F.rint(v), F.lit(0)), F.lit(255)).cast("int")

    return {
        "lab_l": byte(light * 255.0 / 100.0),
        "lab_a": byte(500.0 * (x - fy) + 128.0),
        "lab_b": byte(200.0 * (fy - z) + 128.0),
    }


def lab(r="r", g="g", b="b") -> Column:
    return F.struct(*[c.alias(n) for n, c in lab_columns(r, g, b).items()])


def in_band(h, s, v, low, high) -> Column:
    h, s, v = _c(h), _c(s), _c(v)
    return (
        h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])
    )


def is_foliage(h="hue", s="sat", v="val", stressed: bool = False) -> Column:
    """Leaf-like colour: a green band, or any clear chroma."""
    band = in_band(h, s, v, (18, 22, 15), (100, 255, 255)) if stressed else in_band(h, s, v, (25, 28, 20), (95, 255, 255))
    return band | ((_c(s) >= 28) & _c(v).between(25, 250))


def is_green(h="hue", s="sat", v="val") -> Column:
    return in_band(h, s, v, (25, 28, 20), (95, 255, 255))


def is_white(level: int = 250, r="r", g="g", b="b") -> Column:
    return (_c(r) >= level) & (_c(g) >= level) & (_c(b) >= level)


def is_blue(h="hue", s="sat", v="val") -> Column:
    return in_band(h, s, v, (90, 20, 20), (135, 255, 255))


def is_neutral(spread: int = 55, r="r", g="g", b="b") -> Column:
    r, g, b = _c(r), _c(g), _c(b)
    return F.greatest(r, g, b) - F.least(r, g, b) <= spread


def is_dark(level: int = 75, r="r", g="g", b="b") -> Column:
    return gray(r, g, b) <= level


def paper_distance(paper=("paper_r", "paper_g", "paper_b"), r="r", g="g", b="b") -> Column:
    dr, dg, db = (_c(c) - _c(p) for c, p in zip((r, g, b), paper))
    return F.sqrt(dr * dr + dg * dg + db * db)


def is_paper(white: int = 240, h="hue", s="sat", v="val", paper=("paper_r", "paper_g", "paper_b"),
             near: float = 38.0, sat: int = 50, bright: int = 195) -> Column:
    """Background-like colour: near the paper, pale and bright, or white."""
    return (paper_distance(paper) < near) | ((_c(s) < sat) & (_c(v) > bright)) | is_white(white)


def blueness(r="r", g="g", b="b") -> Column:
    """Mean of four blue signals, 0-255."""
    rr, gg, bb = _c(r), _c(g), _c(b)
    parts, hs = lab_columns(r, g, b), hsv_columns(r, g, b)

    def unit(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    away = F.abs(hs["hue"] - 115.0)
    hue_score = unit(1.0 - F.least(away, 180.0 - away) / 35.0) * (hs["sat"] / 255.0)
    chroma = unit((bb - F.greatest(rr, gg)) / (rr + gg + bb + 1e-6) * 4.0)
    fused = (unit((128.0 - parts["lab_b"]) / 60.0) + unit((cb(r, g, b) - 128.0) / 60.0) + hue_score + chroma) / 4.0
    return F.floor(fused * 255.0).cast("int")
