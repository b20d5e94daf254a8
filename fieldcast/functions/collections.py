"""Arrays, maps and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def first_present(*columns: Column, default: str = "") -> Column:
    """The first that is neither null nor blank, trimmed; else ``default``."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(default))


def first_match(values: Column, test: Callable[[Column], Column]) -> Column:
    """The first element that passes; null if none does."""
    return F.try_element_at(F.filter(values, test), F.lit(1))


def merge_maps(base: Column, override: Column) -> Column:
    """All keys; where both have one, ``override`` holds. Nulls count as empty."""
    b, o = F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(override, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.map_contains_key(o, k)), o)


def sorted_json(values: Column) -> Column:
    """JSON text of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def parse_json(text: Column, schema: DataType | str) -> Column:
    """Typed value of JSON text; null if it does not parse."""
    return F.from_json(text, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
