"""Colours as columns: hue, distance, class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_color

#: Fills, the sea, hue cuts in degrees, and authoring colours.
GREY, BROWN, ORANGE, SEA = (190, 190, 190), (200, 161, 140), (255, 193, 131), (209, 240, 255)
HUES = [(15, "red"), (50, "orange"), (80, "yellow"), (165, "green"), (200, "light_blue"), (260, "blue"), (315, "purple"), (345, "pink")]
AUTHORING = {
    "#FF7F7F": "red",
    "#7F7FFF": "blue",
    "#6CC182": "green",
    "#FFFFB3": "yellow",
    "#E8B577": "orange",
    "#66FFFF": "light_blue",
    "#B475C2": "purple",
    "#855C33": "brown",
}


def rgb_distance(r: Column, g: Column, b: Column, to: tuple[int, int, int]) -> Column:
    return F.sqrt(2.0 * (r - to[0]) * (r - to[0]) + 4.0 * (g - to[1]) * (g - to[1]) + 3.0 * (b - to[2]) * (b - to[2]))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Struct of hue in degrees, saturation and value of 0..255 channels."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif((top - low).cast("double"), F.lit(0.0))
    hue = F.when(r == top, (g - b) / span).when(g == top, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    return F.struct(F.coalesce(F.pmod(hue * 60, F.lit(360.0)), F.lit(0.0)).alias("h"), F.coalesce((top - low) / F.nullif(top.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("s"), (top / 255.0).alias("v"))


def _named(p: Column) -> Column:
    """Class of a struct of r, g, b and their hue, saturation and value."""
    r, g, b, h, s, v = p["r"], p["g"], p["b"], p["hsv"]["h"], p["hsv"]["s"], p["hsv"]["v"]
    hue = F.lit("red")
    for cut, name in reversed(HUES):
        hue = F.when(h < cut, name).otherwise(hue)
    brown = (h >= 10) & (h < 45) & (s <= 0.40) & (v <= 0.86) & (rgb_distance(r, g, b, BROWN) < rgb_distance(r, g, b, ORANGE))
    return (
        F.when(v < 0.30, None)
        .when(s < 0.12, F.when(rgb_distance(r, g, b, GREY) <= 60, "grey"))
        .when(rgb_distance(r, g, b, SEA) < 75, None)
        .when(brown, "brown")
        .otherwise(hue)
    )


def classify_rgb(r: Column, g: Column, b: Column) -> Column:
    """Colour name of a map fill; null for outlines, text, paper and sea.

    The hue is worked out once, as the one element of an array, not in each comparison.
    """
    pixel = F.struct(r.alias("r"), g.alias("g"), b.alias("b"), rgb_to_hsv(r, g, b).alias("hsv"))
    return F.get(F.transform(F.array(pixel), _named), 0)


def channels(value: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of ``#RRGGBB`` (the # is optional); null for anything else."""
    digits = F.regexp_extract(F.trim(value), "^#?([0-9a-fA-F]{6})$", 1)
    return tuple(F.conv(F.nullif(F.substring(digits, i, 2), F.lit("")), 16, 10).cast("int") for i in (1, 3, 5))


def color_name_from_hex(value: Column, page_key: Column | None = None) -> Column:
    """The page's own key (name -> hex) first, then the authoring colours, then the hue."""
    v = F.upper(F.trim(value))
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in AUTHORING.items() for x in p]), v)
    own = F.lit(None).cast("string")
    if page_key is not None:
        own = canonical_color(F.try_element_at(F.map_keys(F.map_filter(page_key, lambda _, x: F.upper(x) == v)), F.lit(1)))
    return F.coalesce(own, known, classify_rgb(*channels(v)), F.lit(""))
