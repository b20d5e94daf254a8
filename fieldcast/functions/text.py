"""String functions: names, matchups, colours, slots and URLs. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .collections import let

#: Labels of injury codes; others are shown as they are, in title case.
INJURY_LABELS = {
    "ACTIVE": "Healthy",
    "NORMAL": "Healthy",
    "QUESTIONABLE": "Questionable",
    "DOUBTFUL": "Doubtful",
    "OUT": "Out",
    "INJURY_RESERVE": "IR",
    "SUSPENSION": "Suspended",
    "DAY_TO_DAY": "Day-to-day",
    "PROBABLE": "Probable",
}
#: Networks with regional windows, and words of a heading that name a window.
NETWORKS = ("CBS", "FOX")
HEADING_WORDS = [
    ("SPECIAL", ("TUESDAY", "MONDAY", "SATURDAY", "WEDNESDAY")),
    ("EARLY", ("EARLY", "1:00", "1 PM", "1PM")),
    ("LATE", ("LATE", "4:05", "4:25", "4 PM", "4PM")),
    ("SINGLE", ("SINGLE",)),
]
#: Patterns of a matchup, of a window marker, and of a remark at a text's end.
_MATCHUP = r"(?i)([A-Za-z0-9 .'-]+?)\s+(?:at|@|vs\.?|versus)\s+([A-Za-z0-9 .'-]+)"
_MARKER = r"(?i)\s*\(\s*(late|early)\s*\)\s*$"
_REMARK = r"(?i)\s*\((?![^)]*\b(?:late|early)\b\s*\))[^)]*(?:announc|blackout|subject)[^)]*\)\s*$"
#: Patterns of a revision in a file's stem and of a numbered swatch, what is
#: stripped off a game's text, other words for a colour, generation suffixes of names.
_REVISION = r"(?i)(?:^|[-_])V(\d+)(?:\.|[-_]|$)"
_SWATCH = r"(?i)/swatches/(\d+)\.(?:png|gif|jpe?g|webp)"
_DASHES = " -–—:|\t\r\n"
_LIGHT_BLUE = ("cyan", "lightblue", "light_blue")
_GENERATION = r"\b(jr|sr|ii|iii|iv|v)\b\.?"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def name_key(name: Column) -> Column:
    """Lower case without generation suffixes and without anything but a-z and 0-9."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), _GENERATION, ""), "[^a-z0-9]", "")


def clean_game_text(text: Column) -> Column:
    """Single blanks, no blanks or dashes at the ends, no trailing remark; 180 characters."""
    t = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(_DASHES))
    return F.substring(F.regexp_replace(t, _REMARK, ""), 1, 180)


def split_matchup(game: Column) -> Column:
    """Struct ``away``, ``home``; both empty if the text is no matchup."""
    part = lambda i: F.coalesce(F.trim(F.regexp_extract(game, _MATCHUP, i)), F.lit(""))
    return F.struct(part(1).alias("away"), part(2).alias("home"))


def split_window_marker(game: Column) -> Column:
    """Struct ``game`` without a trailing (LATE) or (EARLY), and ``window`` (empty if none)."""
    marked = game.rlike(_MARKER)
    return F.struct(F.when(marked, F.trim(F.regexp_replace(game, _MARKER, ""))).otherwise(game).alias("game"), F.when(marked, F.upper(F.regexp_extract(game, _MARKER, 1))).otherwise("").alias("window"))


def game_teams(game: Column) -> Column:
    """The sides of a game text, split at `` @ `` only, markers removed, empty ones dropped."""
    bare = F.regexp_replace(game, _MARKER, "")
    return F.filter(F.transform(F.split(bare, " @ "), lambda x: F.trim(x)), lambda x: x != "")


def canonical_color(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(F.replace(F.lower(raw), F.lit("gray"), F.lit("grey"))), r"\s+", "_")
    return F.when(s.isin(*_LIGHT_BLUE), "light_blue").otherwise(s)


def injury_label(raw: Column) -> Column:
    code = F.upper(F.coalesce(F.nullif(raw, F.lit("")), F.lit("ACTIVE")))
    return F.coalesce(F.try_element_at(_lookup(INJURY_LABELS), code), F.initcap(F.translate(code, "_", " ")))


def game_label(away: Column, home: Column) -> Column:
    """``Away @ Home``; null if a side is unknown."""
    return F.concat(away, F.lit(" @ "), home)


def league_id(text: Column) -> Column:
    """Digits given alone or in a URL after ``league``/``leagues``/``leagueId``."""
    t = F.trim(text)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?i)leagues?(?:id=|/)(\d+)", 1), F.lit("")))


def username(text: Column) -> Column:
    """Handle given alone (with or without ``@``) or as the last part of a URL."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[?#].*$", ""), r"/+$", "")
    return F.nullif(F.regexp_replace(F.regexp_extract(t, r"([^/]*)$", 1), "^@", ""), F.lit(""))


def network_of(text: Column) -> Column:
    """CBS before FOX, null if neither is named."""
    c = F.lit(None).cast("string")
    for n in reversed(NETWORKS):
        c = F.when(text.contains(n), n).otherwise(c)
    return c


def heading_slot(text: Column) -> Column:
    """Network and window that a heading names; tests in order; null if it names none."""
    t = F.upper(F.regexp_replace(text, r"\s+", " "))
    window = F.lit(None).cast("string")
    for name, words in reversed(HEADING_WORDS):
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | t.contains(w)
        window = F.when(any_word, name).otherwise(window)
    return F.concat(network_of(t), F.lit("_"), window)


def url_name(url: Column) -> Column:
    """Last part of a URL's path."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def url_stem(url: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(url_name(url), r"(?<=.)\.[^.]*$", "")


def revision_from_url(url: Column) -> Column:
    """Number after ``V`` in the stem, else 0."""
    return F.coalesce(F.regexp_extract(url_stem(url), _REVISION, 1).try_cast("int"), F.lit(0))


def normalize_slot(url: Column, context: Column, manifest_slot: Column) -> Column:
    """``NETWORK_WINDOW`` from the file name first, then the context; UNKNOWN if unclear."""
    stem = F.translate(F.upper(F.coalesce(url_stem(url), F.lit(""))), "_", "-")
    around = F.upper(F.coalesce(context, F.lit("")))
    other = F.concat(around, F.lit(" "), F.upper(F.coalesce(manifest_slot, F.lit(""))))

    def window_of(v: Column) -> Column:
        stem, around, other, network = (v[n] for n in ("stem", "around", "other", "network"))
        letter = F.lit(None).cast("string")
        for code, name in reversed((("E", "EARLY"), ("L", "LATE"), ("S", "SINGLE"), ("T", "SPECIAL"))):
            hit = F.lit(False)
            for n in NETWORKS:
                hit = hit | ((network == n) & stem.rlike(rf"(?:^|-)({n})-{code}(?:-|$|\d)"))
            letter = F.when(hit, name).otherwise(letter)
        words = F.when(stem.contains(network), "SINGLE").when(around.contains("EARLY"), "EARLY").when(around.contains("LATE"), "LATE").when(other.contains("SINGLE"), "SINGLE")
        return F.concat(network, F.lit("_"), F.coalesce(letter, words))

    # each text is made once, whatever the number of tests on it
    texts = F.struct(stem.alias("stem"), around.alias("around"), other.alias("other"))
    named = lambda t: F.struct(t["stem"].alias("stem"), t["around"].alias("around"), t["other"].alias("other"), F.coalesce(network_of(t["stem"]), network_of(t["other"])).alias("network"))
    return F.coalesce(let(texts, lambda t: let(named(t), window_of)), F.lit("UNKNOWN"))


def plausible_zip(raw: Column) -> Column:
    """Five digits: the first five characters, shorter numbers padded with 0; else null."""
    z = F.substring(F.trim(raw), 1, 5)
    z = F.when(F.length(z) < 5, F.lpad(z, 5, "0")).otherwise(z)
    return F.when(z.rlike(r"^\d{5}$"), z)


def page_images(html: Column, suffix: str = "png") -> Column:
    """Distinct sorted image file names in ``src`` attributes."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)src\s*=\s*["']([^"']+\.{suffix})["']"""), 1)
    return F.array_sort(F.array_distinct(F.transform(found, url_name)))


def color_key(html: Column) -> Column:
    """Map of name -> #RRGGBB from pairs inside HTML comments; the last of a name holds."""
    comments = F.array_join(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), 1), "\n")
    pair = r"([A-Za-z][A-Za-z _]*?)\s*[:=]\s*(#[0-9A-Fa-f]{6})"
    names = F.transform(F.regexp_extract_all(comments, F.lit(pair), 1), lambda x: canonical_color(x))
    values = F.transform(F.regexp_extract_all(comments, F.lit(pair), 2), lambda x: F.upper(x))
    last = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), x["k"]))
    return F.map_from_entries(last)


def swatch_number(src: Column) -> Column:
    return F.regexp_extract(src, _SWATCH, 1).try_cast("int")
