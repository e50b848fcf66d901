"""The driver's ``events`` table as raw behavioural events, by one fixed projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.columns import text_ms

#: What a query over the driver's data takes for the present.
NOW = "2024-01-31 00:00:00"


def _pick(n: str, k: int, **texts: str | None):
    """By ``n % k``: the text given for ``_0``, ``_1`` ...; the default for the rest."""
    out = F.expr(texts.pop("default"))
    for at, value in texts.items():
        out = F.when(F.expr(f"{n} % {k} = {at[1:]}"), F.lit(value)).otherwise(out)
    return out


def project(events: DataFrame) -> DataFrame:
    """The 16 raw columns, event_ts (wall clock, whole milliseconds) and seq (arrival order)."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("event_ts", F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    kind = {"view": "page_view", "purchase": "login", "error": "feature_used"}
    event_type = F.col("event_type")
    for old, new in kind.items():
        event_type = F.when(F.col("event_type") == old, new).otherwise(event_type)
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        event_type.alias("event_type"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        text_ms("event_ts").alias("event_time"),
        F.concat(F.lit("dev-"), (F.col("user_id") % 50).cast("string"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("anonymous_id"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("u-"), F.col("user_id").cast("string"))).when(F.col("event_id") % 4 == 1, F.lit("")).alias("user_id"),
        F.when(F.col("k") % 23 == 0, F.lit(None)).when(F.col("k") % 23 == 1, F.lit("")).otherwise(F.concat(F.lit("s-"), (F.col("user_id") % 10).cast("string"))).alias("session_id"),
        _pick("k", 7, _0=None, _1="", default="concat('/page-', cast(k % 7 as string))").alias("page_url"),
        _pick("k", 6, _0=None, default="concat('https://ref-', cast(k % 6 as string), '.example')").alias("referrer"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("btn-"), (F.col("k") % 9).cast("string"))).alias("element_id"),
        _pick("k", 5, _0=None, _1="", default="concat('feature-', cast(k % 5 as string))").alias("feature_name"),
        _pick("k", 3, _0="desktop", _1="mobile", default="'tablet'").alias("device_type"),
        _pick("k", 4, _0="chrome", _1="firefox", _2="safari", default="''").alias("browser"),
        _pick("k", 3, _0="linux", _1="ios", default="'windows'").alias("os"),
        _pick("k", 8, _0=None, _1="", default="concat('C', cast(k % 8 as string))").alias("country"),
        F.col("props").alias("properties"),
        "event_ts",
        F.col("event_id").alias("seq"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same projection for DuckDB.
SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'login' WHEN 'error' THEN 'feature_used' ELSE event_type END AS event_type,
  'tenant-' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
  strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS event_time,
  'dev-' || CAST(user_id % 50 AS VARCHAR) || '-' || CAST(event_id % 3 AS VARCHAR) AS anonymous_id,
  CASE WHEN event_id % 4 = 0 THEN 'u-' || CAST(user_id AS VARCHAR) WHEN event_id % 4 = 1 THEN '' END AS user_id,
  CASE WHEN k % 23 = 0 THEN NULL WHEN k % 23 = 1 THEN '' ELSE 's-' || CAST(user_id % 10 AS VARCHAR) END AS session_id,
  CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '/page-' || CAST(k % 7 AS VARCHAR) END AS page_url,
  CASE k % 6 WHEN 0 THEN NULL ELSE 'https://ref-' || CAST(k % 6 AS VARCHAR) || '.example' END AS referrer,
  CASE WHEN event_type = 'click' THEN 'btn-' || CAST(k % 9 AS VARCHAR) END AS element_id,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'feature-' || CAST(k % 5 AS VARCHAR) END AS feature_name,
  CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device_type,
  CASE k % 4 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' WHEN 2 THEN 'safari' ELSE '' END AS browser,
  CASE k % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'ios' ELSE 'windows' END AS os,
  CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'C' || CAST(k % 8 AS VARCHAR) END AS country,
  props AS properties, date_trunc('millisecond', ts) AS event_ts, event_id AS seq
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
