"""Numbers, colours and plane geometry on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def number(x: Column) -> Column:
    """A finite double, or 0 for what is none (null, text, NaN, infinities).

    Strings may have white space around them and may be hexadecimal (``0x1f``); true is 1. A suffix that only Java
    knows (``1d``) makes a string no number.
    """
    text = x.cast("string")
    plain = F.when(~F.substring(text, -1, 1).isin("d", "D", "f", "F"), x.try_cast("double"))
    d = F.coalesce(plain, F.when(text.rlike(r"^\s*0[xX][0-9a-fA-F]{1,15}\s*\z"), F.conv(F.substring(F.trim(text), 3, 15), 16, 10).cast("double")))
    # Infinities become NaN by the product, and NaN becomes 0: so the number is worked out once.
    return F.coalesce(F.nanvl(d + d * 0.0, F.lit(0.0)), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    """The nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def fit(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Both sides scaled so that the larger is ``most`` at most; small ones stay."""
    side = F.greatest(width, height)
    scaled = lambda v: F.when(side > most, half_up(v * F.lit(float(most)) / side)).otherwise(half_up(v)).cast("long")
    return scaled(width), scaled(height)


def _long_hex(h: Column) -> Column:
    h = F.regexp_replace(h, "^#", "")
    return F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)


def channels(h: Column) -> list[Column]:
    """Red, green and blue of a colour of 3 or 6 hex digits."""
    n = F.conv(_long_hex(h), 16, 10).cast("long")
    return [F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]


def mix(a: Column, b: Column, amount: float) -> Column:
    """``a`` moved towards ``b``, as #rrggbb."""
    parts = [F.lpad(F.lower(F.hex(clamp(half_up(x + (y - x) * F.lit(amount)), 0, 255).cast("long"))), 2, "0") for x, y in zip(channels(a), channels(b))]
    return F.concat(F.lit("#"), *parts)


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """left, top, width, height of the box between two corners."""
    return F.struct(F.least(x1, x2).alias("left"), F.least(y1, y2).alias("top"), F.abs(x2 - x1).alias("width"), F.abs(y2 - y1).alias("height"))


def percent_of(pixel: Column, origin: Column, size: Column) -> Column:
    """Where a pixel lies between an origin and its far side, in percent, clamped."""
    return F.when(size > 0, clamp((pixel - origin) * 100.0 / size)).otherwise(F.lit(0.0))


def placed(p: Column, scale: Column, offset: Column) -> Column:
    return p * scale + offset


def ease_out_back(t: Column, overshoot: float = 1.70158) -> Column:
    u = t - 1.0
    return F.lit(1.0) + F.lit(overshoot + 1) * F.pow(u, F.lit(3.0)) + F.lit(overshoot) * F.pow(u, F.lit(2.0))


# Height of a tab as a part of the edge, samples of an edge, and where the tab begins and ends on it.
TAB, SAMPLES, TAB_FROM, TAB_TO = 0.22, 18, 0.34, 0.66


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def edge_points(start: Column, end: Column, sign: Column, across: tuple[float, float]) -> Column:
    """Points of a piece's edge from ``start`` to ``end``: two for a flat one (``sign`` 0), else 19 with a tab.

    The tab is a raised cosine towards ``across`` (sign 1) or away from it (-1).
    """
    dx, dy = end["x"] - start["x"], end["y"] - start["y"]
    long = F.hypot(dx, dy)

    def at(i: Column) -> Column:
        t = i / float(SAMPLES)
        u = (t - TAB_FROM) / (TAB_TO - TAB_FROM)
        off = F.when((t > TAB_FROM) & (t < TAB_TO), sign * F.lit(TAB) * long * 0.5 * (1 - F.cos(F.lit(2 * math.pi) * u))).otherwise(0.0)
        return point(start["x"] + dx * t + F.lit(across[0]) * off, start["y"] + dy * t + F.lit(across[1]) * off)

    return F.when(sign == 0, F.array(start, end)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(SAMPLES)), at))


def ring(top: Column, right: Column, bottom: Column, left: Column) -> Column:
    """One closed line from four edges given left to right and top to bottom; shared corners occur once."""
    after = lambda e: F.slice(e, F.lit(2), F.size(e) - 1)
    back = F.reverse(left)
    return F.concat(top, after(right), after(F.reverse(bottom)), F.slice(back, F.lit(2), F.size(back) - 2))


def piece_shape(row: Column, col: Column, signs: dict[str, Column], width: float, height: float) -> Column:
    """(ring, box, home) of the piece at ``row`` and ``col`` of a board with cells of ``width`` and ``height``."""
    x0, y0 = col * F.lit(float(width)), row * F.lit(float(height))
    tl, tr, br, bl = point(x0, y0), point(x0 + width, y0), point(x0 + width, y0 + height), point(x0, y0 + height)
    outline = ring(edge_points(tl, tr, signs["top"], (0, 1)), edge_points(tr, br, signs["right"], (1, 0)), edge_points(bl, br, signs["bottom"], (0, 1)), edge_points(tl, bl, signs["left"], (1, 0)))
    margin = TAB * max(width, height) + 2
    box = F.struct((x0 - margin).alias("x"), (y0 - margin).alias("y"), F.lit(width + 2 * margin).alias("w"), F.lit(height + 2 * margin).alias("h"))
    return F.struct(outline.alias("ring"), box.alias("box"), point(x0 + width / 2, y0 + height / 2).alias("home"))


def path_of(outline: Column) -> Column:
    """A closed line as path text with two decimals."""
    from .text import fixed

    return F.concat(F.lit("M"), F.array_join(F.transform(outline, lambda p: F.concat_ws(" ", fixed(p["x"], 2), fixed(p["y"], 2))), " L"), F.lit(" Z"))


def random_velocity(u: Column, least: float = 45.0, most: float = 150.0, instead: float = 55.0) -> Column:
    """A velocity from a number of 0 to 1: within half of ``most``, and ``instead`` to either side where it is too slow."""
    v = (u - 0.5) * most
    return F.when(F.abs(v) < least, F.when(v < 0, -instead).otherwise(instead)).otherwise(v)


def stagger(position: Column) -> Column:
    """Seconds before an item of a list appears: 0.05 each, for ten at most."""
    return F.least(position, F.lit(10)) * 0.05


def sway(uid: Column) -> Column:
    """Seconds by which an item's animation is shifted: six steps of 0.35."""
    return (uid % 6) * 0.35


def fade_in(position: Column) -> Column:
    """Seconds before a prop of a scene appears."""
    return F.lit(0.2) + position * 0.15


def zone_layer(image: Column, wrap: Column) -> Column:
    """Where a layer lies that covers ``image`` inside ``wrap``; both have left, top, width, height of the page."""
    return F.struct((image["left"] - wrap["left"]).alias("left"), (image["top"] - wrap["top"]).alias("top"), image["width"].alias("width"), image["height"].alias("height"))


def fragment_life(life: Column, age: Column) -> tuple[Column, Column]:
    """(alive, opacity) of a fragment ``age`` seconds after it came with ``life`` seconds: it fades over the last 0.4."""
    left = life - age
    return left > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / 0.4))


def confetti_ms(duration: Column, delay: Column) -> Column:
    """Milliseconds that a piece of confetti stays."""
    return (duration + delay) * 1000 + 150
