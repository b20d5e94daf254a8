"""Kick-off times in each viewer's zone (C12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time


def kickoff_localised(schedule: DataFrame, day: str, text: str, zone: str, rules: DataFrame | None = None) -> DataFrame:
    """Add ``instant``, ``local_time``, ``zone_abbr``, ``label`` (both), ``local_date``, ``shifted``
    (another date than at home) and ``at_home`` (told in home time).

    Without a zone the home zone's words stay as they are; so do those of a time that is none
    (TBD), with no instant and an empty ``zone_abbr``.
    """
    rules = time.zone_rules(schedule.sparkSession) if rules is None else rules
    home = F.lit(time.HOME_ZONE)
    df = schedule.withColumn("_wall", time.wall_clock(F.col(day), time.parse_et_time(F.col(text))))
    df = time.to_instants(df, "_wall", home, rules).drop("_wall")
    df = time.in_zones(df, "instant", F.coalesce(F.col(zone), home), rules)
    told = F.col(zone).isNotNull() & F.col("instant").isNotNull()
    local = F.when(told, F.date_format("there", "h:mm a")).otherwise(F.col(text))
    df = df.withColumn("local_time", local).withColumn("zone_abbr", F.coalesce("zone_abbr", F.lit("")))
    date = F.when(told, F.to_date("there")).otherwise(F.col(day))
    df = df.withColumn("label", F.rtrim(F.concat_ws(" ", "local_time", "zone_abbr"))).withColumn("local_date", date)
    df = df.withColumn("shifted", F.coalesce(F.col("local_date") != F.col(day), F.lit(False))).withColumn("at_home", ~told | (F.col(zone) == home))
    return df.select(*schedule.columns, "instant", "local_time", "zone_abbr", "label", "local_date", "shifted", "at_home")
