"""Synthetic raw events by hashing a row number: any range of rows can be made anywhere, again and alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.columns import text_ms
from corvane.functions.schemas import DeviceType, EventType

#: Shares of a hundred: how a visit's events are spread.
KINDS = ((60, EventType.PAGE_VIEW), (82, EventType.CLICK), (94, EventType.FEATURE_USED), (98, EventType.LOGIN), (100, EventType.SIGNUP))
PAGES = ("/", "/pricing", "/docs", "/dashboard", "/settings", "/reports", "/billing")
FEATURES = ("export", "share", "filter", "alert", "import")
COUNTRIES = ("US", "DE", "FR", "GB", "IN", "BR", "JP")


def synthetic(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00", days: int = 7, tenants: int = 5, people: int = 1000, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` raw events over ``days``: each person has two devices and signs in on some visits; visits last up to 20 minutes."""

    def draw(what: str, *of: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *of), F.lit(1_000_003))

    def pick(values: tuple, x: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (x % len(values) + 1).cast("int"))

    i = F.col("id")
    visit = F.floor(i / 6)  # six events a visit
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    rows = rows.select(i, visit.alias("visit"), (draw("person", visit) % people).alias("person"))
    rows = rows.withColumns({"device": draw("device", F.col("visit")) % 2, "second": draw("start", F.col("visit")) % (days * 86_400) + draw("gap", i) % 1200})
    ts = F.timestamp_add("SECOND", F.col("second"), F.lit(start).cast("timestamp_ntz"))
    x = draw("kind", i) % 100
    kind = F.lit(KINDS[-1][1].value)
    for share, name in reversed(KINDS[:-1]):
        kind = F.when(x < share, F.lit(name.value)).otherwise(kind)
    person = F.col("person").cast("string")
    signed_in = draw("signed", F.col("visit")) % 3 == 0
    return rows.withColumn("event_type", kind).select(
        F.concat(F.lit("e-"), i.cast("string")).alias("event_id"), "event_type", F.concat(F.lit("tenant-"), (F.col("person") % tenants).cast("string")).alias("tenant_id"), text_ms(ts).alias("event_time"),
        F.concat(F.lit("anon-"), F.substring(F.sha2(F.concat_ws("|", person, F.col("device").cast("string")), 256), 1, 16)).alias("anonymous_id"),
        F.when(signed_in, F.concat(F.lit("user-"), person)).alias("user_id"), F.concat(F.lit("session-"), F.col("visit").cast("string")).alias("session_id"),
        pick(PAGES, draw("page", i)).alias("page_url"), F.lit(None).cast("string").alias("referrer"), F.when(F.col("event_type") == "click", pick(("save", "open", "close"), draw("element", i))).alias("element_id"),
        F.when(F.col("event_type") == "feature_used", pick(FEATURES, draw("feature", i))).alias("feature_name"), pick(tuple(d.value for d in DeviceType), draw("type", F.col("person"), F.col("device"))).alias("device_type"),
        pick(("chrome", "firefox", "safari"), draw("browser", F.col("person"))).alias("browser"), pick(("windows", "linux", "ios"), draw("os", F.col("person"))).alias("os"), pick(COUNTRIES, draw("country", F.col("person"))).alias("country"),
        F.to_json(F.struct(F.col("visit").alias("visit"))).alias("properties"),
    )
