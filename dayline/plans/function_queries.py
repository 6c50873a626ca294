"""The scalar functions over whole tables, on values of every kind that they tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import columns as C
from dayline.plans.fixtures import events, table, with_
from dayline.sources.readers import local_time

#: Zones of the cases and their hours from UTC in January; the second is none.
ZONES = {"America/New_York": -5, "Nowhere/Land": 0, "Asia/Tokyo": 9}


def q_number_functions(spark: SparkSession, d: str) -> DataFrame:
    """Clipped values, hours as clock times, clock times as minutes, cells of a grid."""
    e = events(spark, d)
    value = F.when(F.col("k") % 5 > 0, F.col("value"))
    clock = C.clock(F.round("value", 3) / 10)
    text = F.when(F.col("k") % 7 == 0, F.substring(clock, 2, 4)).when(F.col("k") % 11 == 0, F.concat(clock, F.lit(" "))).otherwise(clock)
    column, row = C.grid_cell(F.col("k") % 20)
    return e.select("event_id", F.round(C.clip(value, 20.0, F.col("k") + 30.0), 6).alias("clipped"), clock.alias("clock"), C.minutes_of(text).alias("minutes"), column.alias("grid_column"), row.cast("int").alias("grid_row"))


def q_time_functions(spark: SparkSession, d: str) -> DataFrame:
    """Epochs as local times; ISO texts with Z, with an offset, without one and broken, in zones of which one is unknown."""
    e = events(spark, d)
    zone = F.element_at(F.array(*map(F.lit, ZONES)), F.col("k") % 3 + 1)
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("k") % 4 == 0, F.concat(plain, F.lit("Z"))).when(F.col("k") % 4 == 1, F.concat(plain, F.lit("+02:00"))).when(F.col("k") % 4 == 2, F.concat(F.lit(" "), plain)).otherwise("not a time")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select("event_id", local_time(seconds).alias("local"), C.valid_zone(zone).alias("zone"), C.iso_local(iso, zone).alias("wall"), C.behavioural_day(F.col("ts")).alias("behavioural_day"))


def q_text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut with dots, and JSON objects found in fences, between words or not at all."""
    t = table(spark, d, "documents").select("doc_id", "text")
    held = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("say ```json\n"), F.to_json(F.struct("doc_id", "text")), F.lit("\n``` so"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x {"), F.replace("text", F.lit("}"), F.lit("")), F.lit("} y"))).otherwise(F.translate("text", "{}", ""))
    found = C.json_object(held)
    return t.select("doc_id", C.shortened(F.col("text"), 90).alias("short"), F.length(found).alias("chars"), F.when(F.col("doc_id") % 3 == 1, F.md5(found.cast("binary"))).alias("digest"), F.get_json_object(found, "$.doc_id").try_cast("long").alias("inner_id"))


QUERIES = {k[2:]: v for k, v in globals().items() if k.startswith("q_")}

_HOURS = " ".join(f"when {i} then to_hours({h})" for i, h in enumerate(ZONES.values()))
SQL = {
    "number_functions": with_(
        ["ev"],
        """select event_id, case when k % 5 > 0 then round(greatest(20.0, least(value, k + 30.0)), 6)::double end as clipped, c as clock,
      case when k % 7 = 0 or k % 11 = 0 then null else left(c, 2)::int * 60 + right(c, 2)::int end as minutes,
      case when k % 20 between 1 and 16 then (k % 20 - 1) % 4 + 1 end as grid_column, case when k % 20 between 1 and 16 then (k % 20 - 1) // 4 + 1 end as grid_row
      from (select *, lpad(((w + (m = 60)::int) % 24)::varchar, 2, '0') || ':' || lpad((m % 60)::varchar, 2, '0') as c from (
        select *, floor(h)::int as w, round_even((h - floor(h)) * 60, 0)::int as m from (select *, x - floor(x / 24) * 24 as h from (select *, round(value, 3) / 10 as x from ev))))""",
    ),
    "time_functions": with_(
        ["ev"],
        f"""select event_id, t - interval 4 hours as local, replace({list(ZONES)}[k % 3 + 1], 'Nowhere/Land', 'UTC') as zone,
      case k % 4 when 0 then t + z when 1 then t - interval 2 hours + z when 2 then t end as wall, (ts - interval 4 hours)::date as behavioural_day
      from (select *, date_trunc('second', ts) as t, case k % 3 {_HOURS} end as z from ev)""",
    ),
    "text_functions": r"""
select doc_id, case when length(text) <= 90 then text else rtrim(left(text, 87), ' ') || '...' end as short,
  case doc_id % 3 when 0 then length(to_json({'doc_id': doc_id, 'text': text})::varchar) when 1 then length(replace(text, '}', '')) + 2 end as chars,
  case when doc_id % 3 = 1 then md5('{' || replace(text, '}', '') || '}') end as digest, case when doc_id % 3 = 0 then doc_id end as inner_id
from documents""",
}
