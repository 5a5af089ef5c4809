"""The public test tables in the roles of this library's inputs.

events are observation series: user_id the field, ts cut to the hour (so that instants repeat), value in whole cents,
missing for every 17th event; event_type 'error' is a POOR observation. Whole numbers keep sums exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ts_us
from ..shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    value = F.when(F.col("event_id") % 17 != 0, F.round(F.col("value") * 100))
    return e.select("event_id", "user_id", "event_type", ts_us(hour).alias("ts_us"), F.to_date("ts").alias("day"), value.alias("v"), (F.col("event_type") != "error").alias("ok"))


OBS = """o as (
    select event_id, user_id, event_type, epoch_us(date_trunc('hour', ts)) as ts_us, cast(ts as date) as day,
           case when event_id % 17 <> 0 then round(value * 100) end as v, event_type <> 'error' as ok
    from events
)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: events, whole-cent total (NULL if a value is missing), greatest value."""
    o = observations(spark, sf_dir)
    return o.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("v") == F.count(F.lit(1)), F.sum("v")).alias("total"), F.max("v").alias("top"))


DAILY = OBS + """, d as (
    select user_id, day, count(*) as n, case when count(v) = count(*) then sum(v) end as total, max(v) as top from o group by all
)"""


def spectra(spark: SparkSession, sf_dir: str, told: tuple[str, str] | None = None) -> DataFrame:
    """Line items as band values in [0, 1): exact ratios of small whole numbers. told: names for each row's file and its number there."""
    li = read(spark, sf_dir, "lineitem")
    place = [F.col(f"_metadata.{k}").alias(n) for k, n in zip(("file_path", "row_index"), told, strict=True)] if told else []
    band = lambda k: F.pmod(F.col("l_orderkey") * k + F.col("l_partkey") * (k + 4) + F.col("l_linenumber"), F.lit(97)).cast("double") / 128
    return li.select("l_orderkey", "l_linenumber", *[band(k).alias(n) for k, n in enumerate(("b02", "b04", "b06", "b07", "b08", "b8a", "b11", "b12"), 1)], F.pmod("l_partkey", F.lit(50)).alias("n_valid"), F.pmod("l_suppkey", F.lit(30)).alias("n_cloud"), *place)


SPECTRA = "b as (select l_orderkey, l_linenumber, " + ", ".join(f"((l_orderkey * {k} + l_partkey * {k + 4} + l_linenumber) % 97)::double / 128 as {n}" for k, n in enumerate(("b02", "b04", "b06", "b07", "b08", "b8a", "b11", "b12"), 1)) + ", l_partkey % 50 as n_valid, l_suppkey % 30 as n_cloud from lineitem)"


def points(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """Rows of a register at whole-number places of a square of 1000."""
    t = read(spark, sf_dir, table)
    return t.select(F.col(key).alias("id"), F.pmod(F.col(key) * 7919, F.lit(1000)).cast("double").alias("x"), F.pmod(F.col(key) * 104729, F.lit(997)).cast("double").alias("y"))


def points_sql(table: str, key: str) -> str:
    return f"select {key} as id, ({key} * 7919 % 1000)::double as x, ({key} * 104729 % 997)::double as y from {table}"
