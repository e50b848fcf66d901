"""Profiles: one wide row a person, built from branches that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.columns import epoch_ms, last_value, present
from corvane.functions.schemas import PROFILE_RELEASE, WINDOWS_DAYS
from corvane.operators import sessions as S

KEY = ["tenant_id", "canonical_id"]
TOP_PAGES, TOP_FEATURES = 5, 3
#: Compared to tell which fields of a profile changed, and what a new profile tells instead.
COMPARED = (
    "total_events", "total_sessions", "last_seen", "page_views", "clicks", "logins", "feature_uses",
    "last_page", "last_country", "last_device", "last_browser", "avg_session_duration_sec",
)
ON_CREATE = ("canonical_id", "tenant_id", "total_events", "first_seen", "last_seen")


def reference_date(events: DataFrame) -> DataFrame:
    """A single row: the date of the event that arrived last; not the largest date."""
    return events.agg(F.max_by(F.to_date("event_ts"), "seq").alias("today"))


def lifetime(events: DataFrame) -> DataFrame:
    kinds = {"page_views": "page_view", "clicks": "click", "logins": "login", "feature_uses": "feature_used"}
    return events.groupBy(*KEY).agg(
        epoch_ms(F.min("event_ts")).alias("first_seen"),
        epoch_ms(F.max("event_ts")).alias("last_seen"),
        F.count("*").alias("total_events"),
        *(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()),
    )


def last_values(events: DataFrame) -> DataFrame:
    names = {"user_id": "user_id", "last_page": "page_url", "last_country": "country", "last_device": "device_type", "last_browser": "browser"}
    return events.groupBy(*KEY).agg(*(last_value(v, "event_ts", "seq").alias(k) for k, v in names.items()))


def calendar(events: DataFrame, today: Column) -> DataFrame:
    """Events of the last 1, 7, 30, 90 days up to and with ``today``; later dates don't count."""
    day = F.to_date("event_ts")
    return events.groupBy(*KEY).agg(*(F.count_if(day.between(F.date_sub(today, n - 1), today)).alias(f"events_{n}d") for n in WINDOWS_DAYS))


def core(events: DataFrame, today: Column) -> DataFrame:
    """lifetime, last_values and calendar in one aggregation."""
    day = F.to_date("event_ts")
    kinds = {"page_views": "page_view", "clicks": "click", "logins": "login", "feature_uses": "feature_used"}
    names = {"user_id": "user_id", "last_page": "page_url", "last_country": "country", "last_device": "device_type", "last_browser": "browser"}
    return events.groupBy(*KEY).agg(
        epoch_ms(F.min("event_ts")).alias("first_seen"),
        epoch_ms(F.max("event_ts")).alias("last_seen"),
        F.count("*").alias("total_events"),
        *(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()),
        *(last_value(v, "event_ts", "seq").alias(k) for k, v in names.items()),
        *(F.count_if(day.between(F.date_sub(today, n - 1), today)).alias(f"events_{n}d") for n in WINDOWS_DAYS),
    )


def top_items(events: DataFrame, item: str, k: int, into: str) -> DataFrame:
    """The ``k`` most used present values of ``item``, whatever the event type; ties in lexical order."""
    uses = events.where(present(item)).groupBy(*KEY, F.col(item).alias("item")).agg(F.count("*").alias("uses"))
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("uses"), "item"))
    best = uses.withColumn("r", rank).where(F.col("r") <= k)
    return best.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias(into))


def assemble(core_rows: DataFrame, pages: DataFrame, features: DataFrame, closed: DataFrame, how: str = "left") -> DataFrame:
    """Branches joined on the key; absent lists are empty, an absent average is null."""
    none = F.array().cast("array<string>")
    joined = core_rows.join(pages, KEY, how).join(features, KEY, how).join(closed.select(*KEY, "avg_session_duration_sec"), KEY, "left")
    return joined.withColumns({"top_pages": F.coalesce("top_pages", none), "top_features": F.coalesce("top_features", none)})


def assemble_union(core_rows: DataFrame, pages: DataFrame, features: DataFrame, closed: DataFrame) -> DataFrame:
    """The same by tagged UNION ALL and one aggregation: a single shuffle over rows that are already aggregated."""
    none = F.array().cast("array<string>")
    tagged = core_rows.withColumn("kind", F.lit("core"))
    for df, kind in ((pages, "pages"), (features, "features"), (closed.select(*KEY, "avg_session_duration_sec"), "closed")):
        tagged = tagged.unionByName(df.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    of = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    plain = [c for c in core_rows.columns if c not in KEY]
    out = tagged.groupBy(*KEY).agg(
        F.count_if(F.col("kind") == "core").alias("cores"), *(of(c, "core").alias(c) for c in plain),
        F.coalesce(of("top_pages", "pages"), none).alias("top_pages"), F.coalesce(of("top_features", "features"), none).alias("top_features"), of("avg_session_duration_sec", "closed").alias("avg_session_duration_sec"),
    )
    return out.where("cores > 0").drop("cores")


def snapshot_at(events: DataFrame, today: DataFrame, watermark: DataFrame, union: bool = True) -> DataFrame:
    """The 21 fields of every person in ``events``, as of a date and a watermark (single rows) that may be those of more events."""
    dated = events.crossJoin(F.broadcast(today))  # one row
    mark = watermark.toDF("_mark")
    closed = S.windows(events).crossJoin(F.broadcast(mark)).where(F.col("window_end") <= F.col("_mark"))  # one row
    build = assemble_union if union else assemble
    tops = (top_items(events, "page_url", TOP_PAGES, "top_pages"), top_items(events, "feature_name", TOP_FEATURES, "top_features"))
    rows = build(core(dated, F.col("today")), *tops, S.closed_metrics(closed))
    return rows.select(*[f.name for f in PROFILE_RELEASE.fields if f.name != "action"])


def snapshot(events: DataFrame, union: bool = True) -> DataFrame:
    """The 21 fields of every person after all of ``events`` (admitted, with canonical_id, event_ts and seq)."""
    return snapshot_at(events, reference_date(events), S.watermark_of(events), union)


def with_action(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """new with action: update where ``old`` has the key, else create."""
    if old is None:
        return new.withColumn("action", F.lit("create"))
    known = old.select(*KEY).distinct().withColumn("_known", F.lit(True))
    return new.join(known, KEY, "left").withColumn("action", F.when(F.col("_known"), "update").otherwise("create")).drop("_known")


def with_sessions(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Profiles with total_sessions, the sessions started along ``events``."""
    started = S.start_counts(events, F.current_date()).select(*KEY, "total_sessions")
    return rows.join(started, KEY, "left").withColumn("total_sessions", F.coalesce("total_sessions", F.lit(0).cast("long")))


def changed_fields(new: DataFrame, old: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """tenant_id, canonical_id, action, changed_fields; a profile without a change has an empty list.

    Both have the 21 fields and total_sessions (see with_sessions).
    """
    before = old.select(*KEY, F.struct(*compared).alias("_o"))
    joined = new.join(before, KEY, "left")
    names = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_o.{c}")), F.lit(c)) for c in compared)))
    created = F.array(*map(F.lit, ON_CREATE))
    return joined.select(*KEY, F.when(F.col("_o").isNull(), "create").otherwise("update").alias("action"), F.when(F.col("_o").isNull(), created).otherwise(names).alias("changed_fields"))
