"""Wall clocks, instants, zones and seasons."""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import NETWORKS

HOME_ZONE = "America/New_York"
#: The zones that viewers' postal codes map to.
ZONES = [
    "America/Adak", "America/Anchorage", "America/Boise", "America/Chicago", "America/Denver", "America/Detroit",
    "America/Indiana/Indianapolis", "America/Indiana/Knox", "America/Indiana/Marengo", "America/Indiana/Petersburg",
    "America/Indiana/Tell_City", "America/Indiana/Vevay", "America/Indiana/Vincennes", "America/Indiana/Winamac",
    "America/Juneau", "America/Kentucky/Louisville", "America/Kentucky/Monticello", "America/Los_Angeles",
    "America/Menominee", "America/Metlakatla", "America/Montreal", "America/New_York", "America/Nome",
    "America/North_Dakota/Beulah", "America/North_Dakota/Center", "America/North_Dakota/New_Salem", "America/Ojinaga",
    "America/Phoenix", "America/Puerto_Rico", "America/Sitka", "America/Toronto", "America/Winnipeg", "America/Yakutat",
    "Pacific/Honolulu",
]
#: Kick-off times of the two Sunday-afternoon windows.
WINDOW_TIMES = {"EARLY": ("1:00 PM",), "LATE": ("4:05 PM", "4:25 PM")}


def parse_et_time(text: Column) -> Column:
    """Minutes after midnight of ``h:mm AM/PM``; null for anything else."""
    shape = r"(?i)^\s*(\d{1,2}):(\d{2})\s*(AM|PM)\s*$"
    h, m = (F.regexp_extract(text, shape, i).try_cast("int") for i in (1, 2))
    pm = F.upper(F.regexp_extract(text, shape, 3)) == "PM"
    return F.when(text.rlike(shape), (h % 12 + F.when(pm, 12).otherwise(0)) * 60 + m)


def wall_clock(date: Column, minutes: Column) -> Column:
    """Timestamp without zone at ``minutes`` after midnight of ``date``."""
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"), F.lit(0))


def et_instant(date: Column, text: Column) -> Column:
    """UTC wall clock (without zone) of an Eastern date and time; null if the time is none."""
    minutes = parse_et_time(text)
    return F.when(minutes.isNotNull() & date.isNotNull(), F.convert_timezone(F.lit(HOME_ZONE), F.lit("UTC"), wall_clock(date, minutes)))


def local_clock(instant: Column, zone: Column) -> Column:
    """Struct ``time`` (h:mm a), ``date`` and ``shifted`` (another date than at home)."""
    z = F.coalesce(zone, F.lit(HOME_ZONE))
    there, home = F.convert_timezone(F.lit("UTC"), z, instant), F.convert_timezone(F.lit("UTC"), F.lit(HOME_ZONE), instant)
    return F.struct(F.date_format(there, "h:mm a").alias("time"), F.to_date(there).alias("date"), (F.to_date(there) != F.to_date(home)).alias("shifted"))


def offset_minutes(instant: Column, zone: Column) -> Column:
    """Minutes east of UTC."""
    there = F.convert_timezone(F.lit("UTC"), zone, instant)
    return F.timestamp_diff("MINUTE", instant, there).cast("int")


_rules: dict[tuple, list[tuple]] = {}


def _periods(zone: str, first: int, last: int) -> list[tuple]:
    """(zone, since, until, minutes, name) of a zone's clocks, in UTC, by the zone database."""
    there = ZoneInfo(zone)
    edge = lambda year: int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())

    def clock(second: int) -> tuple[int, str]:
        at = datetime.fromtimestamp(second, there)
        return int(at.utcoffset().total_seconds()) // 60, at.tzname()

    end, week = edge(last + 1), 7 * 24 * 3600
    rows, since = [], edge(first)
    now = clock(since)
    for probe in [*range(since + week, end, week), end]:
        while clock(probe - 1) != now:  # the first change before the probe, by halving
            lo, hi = max(since, probe - week - 1), probe - 1
            while hi - lo > 1:
                lo, hi = ((lo + hi) // 2, hi) if clock((lo + hi) // 2) == now else (lo, (lo + hi) // 2)
            rows.append((zone, since, hi, *now))
            since, now = hi, clock(hi)
    rows.append((zone, since, end, *now))
    return rows


def zone_rules(spark: SparkSession, zones: tuple[str, ...] = tuple(ZONES), first: int = 1980, last: int = 2050) -> DataFrame:
    """The clocks of ``zones`` from the year ``first`` to ``last``: a row for each period.

    ``since`` to ``until`` is a period in UTC, ``local_since`` to ``local_until`` the wall clocks
    that mean an instant of it: when clocks go forward, those skipped belong to the period
    before; when they go back, those that come twice do too (the earlier instant). So periods
    and wall clocks each have exactly one row. Read from the zone database once in a process; its
    size is some two rows for each zone and year. Names change where only they do.
    """
    key = (zones, first, last)
    if key not in _rules:
        rows = []
        for zone in zones:
            periods = _periods(zone, first, last)
            before = [periods[0][3], *[p[3] for p in periods]]
            starts = [p[1] + 60 * max(p[3], b) for p, b in zip(periods, before)]
            ends = [*starts[1:], periods[-1][2] + 60 * periods[-1][3]]
            rows += [(*p, s, e) for p, s, e in zip(periods, starts, ends)]
        _rules[key] = rows
    df = spark.createDataFrame(_rules[key], "zone string, since long, until long, minutes int, name string, local_since long, local_until long")
    clock = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz") if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(c).cast("timestamp_ntz"))
    return df.withColumns({c: clock(F.col(c)) for c in ("since", "until", "local_since", "local_until")})


def _as_of(df: DataFrame, at: str, zone: Column, rules: DataFrame, since: str, until: str) -> DataFrame:
    """Join each row with the one period of its zone in which ``at`` lies.

    Periods are keyed by zone and year, so a row is compared with the few of its year; the table
    is bounded by its zones and years and small enough for every task.
    """
    years = F.explode(F.sequence(F.year(since), F.year(until))).alias("_year")
    periods = rules.select(F.col("zone").alias("_zone"), years, F.col(since).alias("_since"), F.col(until).alias("_until"), F.col("minutes").alias("_minutes"), F.col("name").alias("_name"))
    on = (zone == F.col("_zone")) & (F.year(at) == F.col("_year")) & (F.col(at) >= F.col("_since")) & (F.col(at) < F.col("_until"))
    return df.join(F.broadcast(periods), on, "left").drop("_zone", "_year", "_since", "_until")


def to_instants(df: DataFrame, wall: str, zone: Column, rules: DataFrame, name: str = "instant") -> DataFrame:
    """Add ``name``: the UTC clock of the wall clock ``wall`` in ``zone``; zones and years that
    are not in ``rules`` take Spark's own."""
    df = _as_of(df, wall, zone, rules, "local_since", "local_until")
    known = F.timestamp_add("MINUTE", -F.col("_minutes"), F.col(wall))
    return df.withColumn(name, F.coalesce(known, F.convert_timezone(zone, F.lit("UTC"), F.col(wall)))).drop("_minutes", "_name")


def in_zones(df: DataFrame, instant: str, zone: Column, rules: DataFrame) -> DataFrame:
    """Add ``there`` (wall clock of ``zone``), ``offset`` (minutes east of UTC) and ``zone_abbr``
    (like EDT; GMT and the hours where there is no name); null for a null instant."""
    df = _as_of(df, instant, zone, rules, "since", "until")
    df = df.withColumn("offset", F.coalesce("_minutes", offset_minutes(F.col(instant), zone)))
    gmt = F.concat(F.lit("GMT"), F.when(F.col("offset") < 0, "-").otherwise("+"), F.floor(F.abs("offset") / 60).cast("string"))
    df = df.withColumn("there", F.timestamp_add("MINUTE", F.col("offset"), F.col(instant)))
    return df.withColumn("zone_abbr", F.coalesce("_name", gmt)).drop("_minutes", "_name")


def zone_abbr(df: DataFrame, instant: str, zone: str, rules: DataFrame | None = None) -> DataFrame:
    """Add ``zone_abbr``; null for a null instant or zone."""
    rules = zone_rules(df.sparkSession) if rules is None else rules
    return in_zones(df, instant, F.col(zone), rules).drop("there", "offset")


def season_of(ts: Column, first_month: int = 7) -> Column:
    """Year in which the season began: the year before, until ``first_month``."""
    return F.year(ts) - (F.month(ts) < first_month).cast("int")


def is_sunday(date: Column) -> Column:
    return F.dayofweek(date) == 1


def broadcast_window(date: Column, network: Column, time: Column) -> Column:
    """``NETWORK_EARLY`` or ``NETWORK_LATE`` of a Sunday-afternoon game, else null."""
    window = F.when(time.isin(*WINDOW_TIMES["EARLY"]), "EARLY").when(time.isin(*WINDOW_TIMES["LATE"]), "LATE")
    return F.when(is_sunday(date) & network.isin(*NETWORKS), F.concat(network, F.lit("_"), window))
