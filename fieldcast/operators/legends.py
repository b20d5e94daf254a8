"""Legends of web pages: headings fill down to the matchups below them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import color_name_from_hex
from ..functions.text import canonical_color, clean_game_text, color_key, heading_slot, swatch_number
from .voting import ambiguous_legend

#: Numbered swatches' colours, and the longest text that can be a heading.
SWATCHES = {1: "red", 2: "blue", 3: "green", 4: "yellow", 5: "orange", 6: "light_blue", 7: "purple", 8: "brown"}
HEADING_CHARS = 40
#: A colour's name before a matchup, and what makes a line one.
_LEAD = r"(?i)^\s*(red|blue|green|yellow|orange|purple|pink|gray|grey|brown|light\s*blue|cyan)\s*[:\-–]\s*"
_GAME = r"(?i)\S\s+(?:at|@|vs\.?|versus)\s+\S|no game"
_LINES = {"p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "ul", "ol"}
_SKIP = {"script", "style", "noscript"}


class _Nodes(HTMLParser):
    """Lines of text with the swatch image or colour that stands in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str]] = []
        self.tag, self.words, self.chip, self.hidden = "", [], "", 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text or self.chip:
            self.rows.append((self.tag, text, self.chip))
        self.words, self.chip = [], ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _LINES:
            self.flush()
            self.tag = tag
        self.hidden += tag in _SKIP
        if tag == "img" and "/swatches/" in (a.get("src") or ""):
            self.chip = a["src"]
        m = re.search(r"#[0-9a-fA-F]{6}", a.get("color") or a.get("style") or "")
        if m and not self.chip:
            self.chip = m[0]

    def handle_endtag(self, tag):
        if tag in _LINES:
            self.flush()
            self.tag = ""
        self.hidden = max(0, self.hidden - (tag in _SKIP))

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def page_nodes(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Lines of each page in order: keys, pos, tag, text, chip (image source or colour)."""
    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys) + ", pos int, tag string, text string, chip string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                p = _Nodes()
                p.feed(row[-1] or "")
                p.close()
                p.flush()
                out += [(*row[:-1], i, *n) for i, n in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=[*keys, "pos", "tag", "text", "chip"])

    return pages.select(*keys, html).mapInPandas(run, schema)


def section_fill(nodes: DataFrame, keys: list[str], slot: str = "heading", pos: str = "pos") -> DataFrame:
    """Add ``slot``: the latest ``heading`` at an earlier place of the page."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("slot", F.last(slot, ignorenulls=True).over(w))


def extract_legend(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, slot, color): the game of each colour, or its games where they disagree.

    A matchup's colour is that of its swatch or colour chip, by the page's own colour key
    first, or a leading ``Red:`` in its text.
    """
    nodes = page_nodes(pages, keys, html).join(pages.select(*keys, color_key(F.col(html)).alias("key")), keys)
    short = F.length("text") <= HEADING_CHARS
    nodes = section_fill(nodes.withColumn("heading", F.when(short, heading_slot(F.col("text")))), keys)
    swatch = F.try_element_at(F.create_map(*[F.lit(x) for p in SWATCHES.items() for x in p]), swatch_number(F.col("chip")))
    by_hex = F.when(F.col("chip").startswith("#"), F.nullif(color_name_from_hex(F.col("chip"), F.col("key")), F.lit("")))
    named = F.when(F.col("text").rlike(_LEAD), canonical_color(F.regexp_extract("text", _LEAD, 1)))
    game = clean_game_text(F.regexp_replace("text", _LEAD, ""))
    rows = nodes.select(*keys, "slot", F.coalesce(swatch, by_hex, named).alias("color"), game.alias("game"), F.col("text").rlike(_GAME).alias("_game"))
    rows = rows.filter("_game and color is not null and slot is not null")
    return ambiguous_legend(rows, [*keys, "slot", "color"])
