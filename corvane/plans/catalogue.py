"""The API's query catalogue: typed functions over the stored tables; arguments are checked, then bound as literals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import validate as V
from corvane.functions.columns import bucket_label, epoch_ms, one_decimal
from corvane.functions.schemas import PROFILE_RELEASE, DeviceType, Dimension, EventType, Metric, Order, ProfileSort, TimeRange
from corvane.operators.store import HLL_LOG2M, display
from corvane.operators.stored import Stored

EVENT_VIEW = ["event_id", "event_type", "tenant_id", "event_time", "canonical_id", "user_id", "session_id", "page_url", "device_type", "browser", "country"]
PROFILE_VIEW = [f.name for f in PROFILE_RELEASE.fields if f.name != "action"]
TOP = 10


@dataclass
class Tables:
    """Stored tables: events and sessions with their date and hour columns, profiles upserted, the two cubes.

    source has a method for each, called when a query names the table.
    """

    source: Stored
    now: str

    @property
    def events(self) -> DataFrame:
        return self.source.events()

    @property
    def sessions(self) -> DataFrame:
        return self.source.sessions()

    @property
    def profiles(self) -> DataFrame:
        return self.source.profiles()

    @property
    def event_cube(self) -> DataFrame:
        return self.source.event_cube()

    @property
    def session_cube(self) -> DataFrame:
        return self.source.session_cube()


def cutoff(now: str, span: TimeRange) -> datetime:
    """now less the range, floored to the hour for a day and to the day otherwise."""
    at = datetime.fromisoformat(now) - timedelta(days=span.days)
    return at.replace(minute=0, second=0, microsecond=0) if span.hourly else at.replace(hour=0, minute=0, second=0, microsecond=0)


def _since(prefix: str, now: str, span: TimeRange) -> Column:
    """On the derived text column, so that partitions by date are pruned."""
    at = cutoff(now, span)
    days = F.col(f"{prefix}_date") >= at.strftime("%Y-%m-%d")
    return days & (F.col(f"{prefix}_hour") >= at.strftime("%Y-%m-%d %H")) if span.hourly else days


def _bucket(prefix: str, span: TimeRange) -> str:
    return f"{prefix}_hour" if span.hourly else f"{prefix}_date"


def tenants(t: Tables, tenant_id: str | None = None) -> DataFrame:
    """Events and persons by tenant, most events first."""
    events, profiles = t.events, t.profiles
    if tenant_id is not None:
        V.identifier(tenant_id)
        events, profiles = events.where(F.col("tenant_id") == tenant_id), profiles.where(F.col("tenant_id") == tenant_id)
    counts = events.groupBy("tenant_id").agg(F.count("*").alias("event_count"))
    users = profiles.where("first_seen IS NOT NULL").groupBy("tenant_id").agg(F.count("*").alias("user_count"))
    return counts.join(users, "tenant_id", "left").withColumn("user_count", F.coalesce("user_count", F.lit(0))).orderBy(F.desc("event_count"), "tenant_id")


def _page(profiles: DataFrame, sort: ProfileSort, order: Order, limit: int, offset: int) -> DataFrame:
    by = F.col(sort.value).desc() if order is Order.DESC else F.col(sort.value).asc()
    total = profiles.agg(F.count("*").alias("total_count"))
    page = profiles.select(*PROFILE_VIEW).orderBy(by, "tenant_id", "canonical_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def users(t: Tables, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return _page(t.profiles.where("first_seen IS NOT NULL"), ProfileSort.FIRST_SEEN, Order.DESC, V.users_limit(limit), V.offset(offset))


def tenant_users(t: Tables, tenant_id: str, limit: int | None = None, offset: int | None = None, sort: str = "last_seen", order: str = "desc") -> DataFrame:
    rows = t.profiles.where((F.col("tenant_id") == V.identifier(tenant_id)) & F.col("first_seen").isNotNull())
    return _page(rows, V.choice(ProfileSort, sort), V.choice(Order, order), V.users_limit(limit), V.offset(offset))


def _newest(events: DataFrame, limit: int) -> DataFrame:
    return display(events.select(*EVENT_VIEW).orderBy(F.desc("event_time"), "event_id").limit(limit))


def events(t: Tables, limit: int | None = None, event_type: str | None = None, device_type: str | None = None) -> DataFrame:
    rows = t.events
    if (kind := V.choice(EventType, event_type)) is not None:
        rows = rows.where(F.col("event_type") == kind.value)
    if (device := V.choice(DeviceType, device_type)) is not None:
        rows = rows.where(F.col("device_type") == device.value)
    return _newest(rows, V.events_limit(limit))


def event(t: Tables, tenant_id: str, event_id: str, event_date_hint: str | None = None) -> DataFrame:
    rows = t.events.where((F.col("tenant_id") == V.identifier(tenant_id)) & (F.col("event_id") == V.identifier(event_id)))
    if hint := V.date_hint(event_date_hint):
        rows = rows.where(F.col("event_date") == hint)
    return _newest(rows, 1)


def events_by_id(t: Tables, event_ids: list[str]) -> DataFrame:
    return t.events.where(F.col("event_id").isin([V.identifier(x) for x in event_ids])).select(*EVENT_VIEW)


def live_profile(t: Tables, tenant_id: str, canonical_id: str) -> DataFrame:
    return t.profiles.where((F.col("tenant_id") == V.identifier(tenant_id)) & (F.col("canonical_id") == V.identifier(canonical_id))).select(*PROFILE_VIEW).limit(1)


def tenant_events(t: Tables, tenant_id: str, limit: int | None = None, canonical_id: str | None = None, event_type: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = t.events.where(F.col("tenant_id") == V.identifier(tenant_id))
    if canonical_id is not None:
        rows = rows.where(F.col("canonical_id") == V.identifier(canonical_id))
    if (kind := V.choice(EventType, event_type)) is not None:
        rows = rows.where(F.col("event_type") == kind.value)
    # The date column bounds the partitions, the text time the rows.
    if start is not None:
        rows = rows.where((F.col("event_time") >= V.timestamp_text(start)) & (F.col("event_date") >= start[:10]))
    if end is not None:
        rows = rows.where((F.col("event_time") <= V.timestamp_text(end)) & (F.col("event_date") <= end[:10]))
    return _newest(rows, V.tenant_events_limit(limit))


def recent_events(t: Tables, tenant_id: str, canonical_id: str, limit: int | None = None) -> DataFrame:
    rows = t.events.where((F.col("tenant_id") == V.identifier(tenant_id)) & (F.col("canonical_id") == V.identifier(canonical_id)))
    return _newest(rows, V.recent_limit(limit))


def recent_events_of_page(t: Tables, people: DataFrame, per_person: int = 5) -> DataFrame:
    """The newest events of every person of a page: the nested lookup as one join and a rank."""
    from pyspark.sql import Window as W

    keys = people.select("tenant_id", "canonical_id")
    rows = t.events.join(keys, ["tenant_id", "canonical_id"], "left_semi")
    rank = F.row_number().over(W.partitionBy("tenant_id", "canonical_id").orderBy(F.desc("event_time"), "event_id"))
    return display(rows.withColumn("rank", rank).where(F.col("rank") <= per_person).select("rank", *EVENT_VIEW))


def tenant_summary(t: Tables, tenant_id: str) -> DataFrame:
    return t.events.where(F.col("tenant_id") == V.identifier(tenant_id)).groupBy("event_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "event_type")


def tenant_aggregate(t: Tables, tenant_id: str, group_by: str, metric: str = "count", limit: int = 100, exact: bool = False) -> DataFrame:
    dim, kind = V.choice(Dimension, group_by), V.choice(Metric, metric)
    rows = t.events.where((F.col("tenant_id") == V.identifier(tenant_id)) & (F.col(dim.value) != ""))
    if kind is Metric.COUNT:
        value = F.count("*")
    else:
        column = "session_id" if kind is Metric.UNIQUE_SESSIONS else "canonical_id"
        value = F.count_distinct(column) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(F.col(column), F.lit(HLL_LOG2M)))
    return rows.groupBy(F.col(dim.value).alias("label")).agg(value.alias("value")).orderBy(F.desc("value"), "label").limit(limit)


def dashboard_stats(t: Tables) -> DataFrame:
    """Two scalar counts in one plan."""
    people = t.profiles.where("first_seen IS NOT NULL").agg(F.count("*").alias("total_users"))
    return people.crossJoin(F.broadcast(t.events.agg(F.count("*").alias("total_events"))))  # one row each


def analytics_summary(t: Tables, span: TimeRange) -> DataFrame:
    after = F.to_timestamp(F.lit(cutoff(t.now, span).strftime("%Y-%m-%d %H:%M:%S"))).cast("timestamp_ntz")
    people = t.profiles.where(F.col("last_seen") > epoch_ms(after)).agg(F.count("*").alias("users"))
    sessions = t.sessions.where(_since("session", t.now, span)).agg(F.count("*").alias("sessions"), F.avg(F.when(F.col("duration_sec") > 0, F.col("duration_sec"))).alias("avg_session_duration"))
    seen = t.events.where(_since("event", t.now, span)).agg(F.count("*").alias("events"))
    one = people.crossJoin(F.broadcast(sessions)).crossJoin(F.broadcast(seen))  # one row each
    return one.select("users", "sessions", "events", F.coalesce("avg_session_duration", F.lit(0.0)).alias("avg_session_duration"), F.when(F.col("sessions") == 0, 0.0).otherwise(F.col("events") / F.col("sessions")).alias("events_per_session"))


def _weekly(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Dates to ISO weeks; the real date is kept until the label is made, so years don't mix."""
    week = F.date_format(F.date_trunc("week", F.to_date("bucket")), "yyyy-MM-dd")
    return rows.groupBy(week.alias("bucket"), *keys).agg(value.alias(name))


def _series(rows: DataFrame, span: TimeRange, keys: list[str], name: str, weekly: Column, compat_limit: bool, limit: int) -> DataFrame:
    rows = rows.orderBy("bucket", *keys).limit(limit) if compat_limit else rows
    rows = _weekly(rows, keys, weekly, name) if span is TimeRange.QUARTER else rows
    return rows.select("bucket", bucket_label("bucket").alias("label"), *keys, name).orderBy("bucket", *keys)


def events_over_time(t: Tables, span: TimeRange, compat_limit: bool = False) -> DataFrame:
    rows = t.events.where(_since("event", t.now, span)).groupBy(F.col(_bucket("event", span)).alias("bucket"), "event_type").agg(F.count("*").alias("count"))
    return _series(rows, span, ["event_type"], "count", F.sum("count"), compat_limit, 20 * span.limit)


def users_over_time(t: Tables, span: TimeRange, exact: bool = False, compat_limit: bool = False) -> DataFrame:
    """Persons by bucket; a quarter adds up its days' counts by week, as the API does."""
    value = F.count_distinct("canonical_id") if exact else F.hll_sketch_estimate(F.hll_sketch_agg(F.col("canonical_id"), F.lit(HLL_LOG2M)))
    rows = t.events.where(_since("event", t.now, span)).groupBy(F.col(_bucket("event", span)).alias("bucket")).agg(value.alias("count"))
    return _series(rows, span, [], "count", F.sum("count"), compat_limit, span.limit)


def sessions_over_time(t: Tables, span: TimeRange, compat_limit: bool = False) -> DataFrame:
    rows = t.sessions.where(_since("session", t.now, span)).groupBy(F.col(_bucket("session", span)).alias("bucket")).agg(F.count("*").alias("count"))
    return _series(rows, span, [], "count", F.sum("count"), compat_limit, span.limit)


def avg_session_duration(t: Tables, span: TimeRange, compat_limit: bool = False) -> DataFrame:
    """Mean of positive durations, one decimal; a quarter's weeks are the unweighted means of their days."""
    rows = t.sessions.where(_since("session", t.now, span) & (F.col("duration_sec") > 0)).groupBy(F.col(_bucket("session", span)).alias("bucket")).agg(one_decimal(F.avg("duration_sec")).alias("value"))
    return _series(rows, span, [], "value", one_decimal(F.avg("value")), compat_limit, span.limit)


def breakdown(t: Tables, span: TimeRange, column: str, limit: int | None = TOP) -> DataFrame:
    """Events by a present value of a column, most first."""
    rows = t.events.where(_since("event", t.now, span) & (F.col(column) != "")).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
    return rows.limit(limit) if limit else rows


def top_pages(t: Tables, span: TimeRange) -> DataFrame:
    return breakdown(t, span, "page_url")


def browser_breakdown(t: Tables, span: TimeRange) -> DataFrame:
    return breakdown(t, span, "browser")


def country_breakdown(t: Tables, span: TimeRange) -> DataFrame:
    return breakdown(t, span, "country")


def device_breakdown(t: Tables, span: TimeRange) -> DataFrame:
    return breakdown(t, span, "device_type", None)


def event_rate_rolling(t: Tables, samples: int = 10) -> DataFrame:
    """Events an hour and the mean of the last ``samples`` hours that had any."""
    from pyspark.sql import Window as W

    hourly = t.events.groupBy("event_hour").agg(F.count("*").alias("events"))
    # An hour's row is one of at most 24 a day of retention, so one task orders them all.
    return hourly.withColumn("rolling", F.avg("events").over(W.orderBy("event_hour").rowsBetween(-(samples - 1), 0)))


def explain_path(dims: list[str], where: list[str], grain: list[str]) -> str:
    """How a grouped count would be answered: from the rollup, in part, or by a full scan."""
    named = {*dims, *where}
    return "STAR_TREE" if named <= {*grain} else "PARTIAL" if named & {*grain} else "FULL_SCAN"
