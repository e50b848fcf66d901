"""Every query over the driver's tables, and the SQL that it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import display as D
from corvane.functions.columns import event_date, event_hour, text_ms
from corvane.functions.display import COUNTRIES
from corvane.functions.schemas import PROFILE_RELEASE, UNIFIED_EVENT, TimeRange
from corvane.operators import admission, identity, profiles, sessions, store
from corvane.operators.state import shared_folder
from corvane.operators.stored import Stored
from corvane.plans import catalogue as C
from corvane.plans.oracles import label, over, since
from corvane.sinks import writers
from corvane.sources import readers
from corvane.sources.driver_events import NOW, raw_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TENANT = "tenant-1"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unified(identity.resolve(raw_events(spark, sf_dir)))


def stored(spark: SparkSession, sf_dir: str) -> Stored:
    """The tables built from the driver's events; the first query that asks builds them, the others read."""
    return Stored(spark, f"{sf_dir}/events.parquet", lambda: raw_events(spark, sf_dir))


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified events as they are stored: identity is resolved once, and each branch reads its own columns only."""
    return stored(spark, sf_dir).events()


def tables(spark: SparkSession, sf_dir: str) -> C.Tables:
    return C.Tables(stored(spark, sf_dir), NOW)


def joined(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that values compare alike in any engine."""
    return df.select(*[joined(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])


# --- identity and admission -------------------------------------------------------------------------------------------

COLUMNS17 = ", ".join(store.EVENT_COLUMNS)


@query("identity_unified", over(f"SELECT {COLUMNS17} FROM capture", "capture"))
def _(spark, sf_dir):
    return unified(spark, sf_dir).select(*store.EVENT_COLUMNS)


@query("identity_merges", over("SELECT merge_old AS old_canonical_id, canonical_id, tenant_id, event_time AS merged_at FROM capture WHERE merge_old IS NOT NULL", "capture"))
def _(spark, sf_dir):
    return identity.merges(identity.resolve(raw_events(spark, sf_dir)))


def _disordered(events: DataFrame) -> DataFrame:
    """Arrivals out of time order: an order made of the event's number, ties by the number."""
    n = F.col("seq")
    return events.withColumn("seq", (n + (n % 7) * 3) * 100 + n % 7)


@query(
    "admission_gate",
    over(
        """SELECT event_id, tenant_id, event_time FROM (SELECT *, max(event_ts) OVER (ORDER BY (seq + (seq % 7) * 3) * 100 + seq % 7 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM raw)
WHERE seen IS NULL OR event_ts >= seen - INTERVAL 5 SECOND""",
        "raw",
    ),
)
def _(spark, sf_dir):
    return admission.admit(_disordered(raw_events(spark, sf_dir))).select("event_id", "tenant_id", "event_time")


@query("dedup_events", over("SELECT event_id, tenant_id, event_time FROM raw", "raw"))
def _(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    again = raw.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("event_time", F.lit("late copy"))
    return store.dedup_events(raw.unionByName(again)).select("event_id", "tenant_id", "event_time")


# --- sessions ---------------------------------------------------------------------------------------------------------

TIMES = "strftime(start_ts, '%Y-%m-%d %H:%M:%S.%g') AS start_time"


@query(
    "sessions_summary",
    over(
        f"""SELECT session_id, canonical_id, tenant_id, {TIMES}, strftime(end_ts, '%Y-%m-%d %H:%M:%S.%g') AS end_time, CAST(duration_ms // 1000 AS BIGINT) AS duration_sec, CAST(event_count AS INTEGER) AS event_count,
  array_to_string(pages, ',') AS pages, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) FROM types t WHERE t.tenant_id = s.tenant_id AND t.session_id = s.session_id AND t.sn = s.sn) AS event_types, device_type, browser, country FROM sess s""",
        "sess", "types",
    ),
)
def _(spark, sf_dir):
    rows = sessions.summaries(sessions.windows(unified(spark, sf_dir)))
    pairs = F.transform(F.array_sort(F.map_entries("event_types")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return rows.withColumn("event_types", F.array_join(pairs, ",")).withColumn("pages", F.array_join("pages", ","))


@query("session_event_types", over(f"SELECT t.tenant_id, t.session_id, {TIMES}, event_type, CAST(n AS INTEGER) AS n FROM types t JOIN sess USING (tenant_id, session_id, sn)", "sess", "types"))
def _(spark, sf_dir):
    return sessions.event_type_counts(sessions.windows(unified(spark, sf_dir)))


@query(
    "json_event_types",
    over(f"""SELECT tenant_id, session_id, {TIMES}, js AS event_types, js AS fragments FROM sess JOIN (SELECT tenant_id, session_id, sn, '{{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS js FROM types GROUP BY ALL) USING (tenant_id, session_id, sn)""", "sess", "types"),
)
def _(spark, sf_dir):
    return sessions.event_types_json(sessions.windows(unified(spark, sf_dir)))


@query("session_pages", over(f"SELECT tenant_id, session_id, {TIMES}, unnest(pages) AS page FROM sess", "sess"))
def _(spark, sf_dir):
    return sessions.windows(unified(spark, sf_dir)).select("tenant_id", "session_id", text_ms("start_ts").alias("start_time"), F.explode("pages").alias("page"))


@query(
    "closed_session_metrics",
    over("SELECT tenant_id, canonical_id, count(*) AS completed_sessions, CAST(sum(duration_ms) // count(*) // 1000 AS BIGINT) AS avg_duration_sec, sum(duration_ms) / count(*) / 1000.0 AS avg_session_duration_sec FROM done GROUP BY ALL", "done"),
)
def _(spark, sf_dir):
    return sessions.closed_metrics(sessions.closed_by_stream(written(spark, sf_dir)))


@query("completed_average", over("SELECT tenant_id, canonical_id, sum(duration_ms) / count(*) / 1000.0 AS avg_session_duration_sec FROM done GROUP BY ALL", "done"))
def _(spark, sf_dir):
    return sessions.closed_metrics(sessions.closed_by_stream(written(spark, sf_dir))).select("tenant_id", "canonical_id", "avg_session_duration_sec")


#: The date of the event that arrived last.
TODAY = "(SELECT CAST(arg_max(event_ts, seq) AS DATE) FROM unified)"


def _dated(rows: DataFrame, of: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(profiles.reference_date(of)))  # one row


def _ranges(day: str, value: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {day} BETWEEN {TODAY} - {n - 1} AND {TODAY} THEN {value} ELSE 0 END), 0) AS BIGINT) AS sessions_{n}d" for n in (1, 7, 30, 90))


@query("closed_calendar", over(f"SELECT tenant_id, canonical_id, count(*) AS total_sessions, {_ranges('CAST(start_ts AS DATE)', '1')} FROM done GROUP BY tenant_id, canonical_id", "done"))
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    return sessions.closed_calendar(_dated(sessions.closed_by_stream(rows), rows), F.col("today"))


@query(
    "session_start_counts",
    over(
        f"""SELECT tenant_id, canonical_id, CAST(sum(begins) AS BIGINT) AS total_sessions, {_ranges('CAST(event_ts AS DATE)', 'begins')} FROM (
  SELECT *, CASE WHEN session_id <> '' AND session_id IS DISTINCT FROM last_value(nullif(session_id, '') IGNORE NULLS) OVER (PARTITION BY tenant_id, canonical_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS begins FROM unified) GROUP BY tenant_id, canonical_id""",
        "unified",
    ),
)
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    return sessions.start_counts(_dated(rows, rows), F.col("today"))


@query("current_sessions", over("SELECT tenant_id, session_id, canonical_id, CAST(duration_ms // 1000 AS BIGINT) AS duration_sec FROM sess WHERE end_ts + INTERVAL 30 MINUTE > (SELECT max(event_ts) - INTERVAL 5 SECOND FROM unified)", "sess"))
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    mark = sessions.watermark_of(rows)
    return sessions.windows(rows).crossJoin(F.broadcast(mark)).where("window_end > watermark").select("tenant_id", "session_id", "canonical_id", F.expr("duration_ms div 1000").alias("duration_sec"))


# --- profiles ---------------------------------------------------------------------------------------------------------

PROFILE21 = [f.name for f in PROFILE_RELEASE.fields if f.name != "action"]
LISTED = ", ".join(f"array_to_string({c}, ',') AS {c}" if c.startswith("top_") else c for c in PROFILE21)


def _cols(*names: str) -> str:
    return "tenant_id, canonical_id, " + ", ".join(names)


LIFETIME = ("first_seen", "last_seen", "total_events", "page_views", "clicks", "logins", "feature_uses")


@query("profile_lifetime", over(f"SELECT {_cols(*LIFETIME)} FROM profiles", "profiles"))
def _(spark, sf_dir):
    return profiles.lifetime(unified(spark, sf_dir))


@query("profile_last_values", over(f"SELECT {_cols('user_id', 'last_page', 'last_country', 'last_device', 'last_browser')} FROM profiles", "profiles"))
def _(spark, sf_dir):
    return profiles.last_values(unified(spark, sf_dir))


@query("profile_calendar", over(f"SELECT {_cols('events_1d', 'events_7d', 'events_30d', 'events_90d')} FROM profiles", "profiles"))
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    return profiles.calendar(rows.crossJoin(F.broadcast(profiles.reference_date(rows))), F.col("today"))


@query("profile_top_pages", over("SELECT tenant_id, canonical_id, array_to_string(top_pages, ',') AS top_pages FROM profiles WHERE len(top_pages) > 0", "profiles"))
def _(spark, sf_dir):
    return flat(profiles.top_items(unified(spark, sf_dir), "page_url", profiles.TOP_PAGES, "top_pages"))


@query("profile_top_features", over("SELECT tenant_id, canonical_id, array_to_string(top_features, ',') AS top_features FROM profiles WHERE len(top_features) > 0", "profiles"))
def _(spark, sf_dir):
    return flat(profiles.top_items(unified(spark, sf_dir), "feature_name", profiles.TOP_FEATURES, "top_features"))


def _early(rows: DataFrame) -> DataFrame:
    return rows.where("event_ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'")


KNOWN = "LEFT JOIN (SELECT tenant_id, canonical_id, TRUE AS known FROM early_profiles) USING (tenant_id, canonical_id)"


@query("profile_release", over(f"SELECT {LISTED}, CASE WHEN known THEN 'update' ELSE 'create' END AS action FROM profiles {KNOWN}", "profiles", "early_profiles"))
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    return flat(profiles.with_action(profiles.snapshot(rows), profiles.lifetime(_early(rows))))


def _started(source: str) -> str:
    return f"""SELECT tenant_id, canonical_id, sum(begins) AS total_sessions FROM (
  SELECT *, CASE WHEN session_id <> '' AND session_id IS DISTINCT FROM last_value(nullif(session_id, '') IGNORE NULLS) OVER (PARTITION BY tenant_id, canonical_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS begins FROM {source}) GROUP BY tenant_id, canonical_id"""


# The fields that are compared, in the order told.
CHANGES = """total_events total_sessions last_seen page_views clicks logins feature_uses last_page last_country last_device last_browser avg_session_duration_sec""".split()


@query(
    "profile_changed_fields",
    over(
        "SELECT p.tenant_id, p.canonical_id, CASE WHEN e.tenant_id IS NULL THEN 'create' ELSE 'update' END AS action, CASE WHEN e.tenant_id IS NULL THEN 'canonical_id,tenant_id,total_events,first_seen,last_seen' ELSE concat_ws(',', "
        + ", ".join(f"CASE WHEN p.{c} IS DISTINCT FROM e.{c} THEN '{c}' END" for c in CHANGES)
        + f") END AS changed_fields FROM (SELECT * FROM profiles JOIN ({_started('unified')}) USING (tenant_id, canonical_id)) p LEFT JOIN (SELECT * FROM early_profiles JOIN ({_started('early')}) USING (tenant_id, canonical_id)) e USING (tenant_id, canonical_id)",
        "profiles", "early_profiles", "early",
    ),
)
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    of = lambda events: profiles.with_sessions(profiles.snapshot(events), events)
    return flat(profiles.changed_fields(of(rows), of(_early(rows))))


def _branches(rows: DataFrame):
    dated = rows.crossJoin(F.broadcast(profiles.reference_date(rows)))
    return (
        profiles.core(dated, F.col("today")), profiles.top_items(rows, "page_url", 5, "top_pages"), profiles.top_items(rows, "feature_name", 3, "top_features"),
        sessions.closed_metrics(sessions.closed_by_stream(rows)),
    )


@query("profile_join_left", over(f"SELECT {LISTED} FROM profiles", "profiles"))
def _(spark, sf_dir):
    return flat(profiles.assemble(*_branches(written(spark, sf_dir))).select(*PROFILE21))


@query("profile_join_inner", over(f"SELECT {LISTED} FROM profiles WHERE len(top_pages) > 0 AND len(top_features) > 0", "profiles"))
def _(spark, sf_dir):
    return flat(profiles.assemble(*_branches(written(spark, sf_dir)), how="inner").select(*PROFILE21))


@query("profile_union_all", over(f"SELECT {LISTED} FROM profiles", "profiles"))
def _(spark, sf_dir):
    return flat(profiles.assemble_union(*_branches(written(spark, sf_dir))).select(*PROFILE21))


@query(
    "profile_sessions_25",
    over(
        f"""SELECT p.tenant_id, p.canonical_id, p.total_events, c.total_sessions, c.sessions_1d, c.sessions_7d, c.sessions_30d, c.sessions_90d FROM profiles p JOIN (SELECT tenant_id, canonical_id, CAST(sum(begins) AS BIGINT) AS total_sessions, {_ranges('CAST(event_ts AS DATE)', 'begins')} FROM (
  SELECT *, CASE WHEN session_id <> '' AND session_id IS DISTINCT FROM last_value(nullif(session_id, '') IGNORE NULLS) OVER (PARTITION BY tenant_id, canonical_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS begins FROM unified) GROUP BY tenant_id, canonical_id) c USING (tenant_id, canonical_id) WHERE c.total_sessions > 0""",
        "profiles",
    ),
)
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    counted = sessions.start_counts(_dated(rows, rows), F.col("today")).where("total_sessions > 0")
    return profiles.lifetime(rows).select("tenant_id", "canonical_id", "total_events").join(counted, profiles.KEY)


@query(
    "merge_returning",
    over("SELECT p.tenant_id, p.canonical_id, CASE WHEN e.tenant_id IS NULL THEN 'insert' ELSE 'update' END AS action, coalesce(e.total_events, -1) AS old_total, p.total_events AS new_total FROM profiles p LEFT JOIN early_profiles e USING (tenant_id, canonical_id)", "profiles", "early_profiles"),
)
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    out = store.merge_returning(profiles.lifetime(_early(rows)), profiles.lifetime(rows))
    return out.select("tenant_id", "canonical_id", "action", F.coalesce("old.total_events", F.lit(-1)).alias("old_total"), F.col("new.total_events").alias("new_total"))


@query(
    "cdc_chain",
    over(
        """SELECT tenant_id, canonical_id, CASE WHEN e.n IS NULL THEN 'c' WHEN f.n IS NULL THEN 'd' ELSE 'u' END AS op, coalesce(e.n, -1) AS before_total, coalesce(f.n, -1) AS after_total
FROM (SELECT tenant_id, canonical_id, count(*) AS n FROM early GROUP BY ALL) e FULL JOIN (SELECT tenant_id, canonical_id, count(*) AS n FROM unified WHERE event_ts >= TIMESTAMP '2024-01-08' GROUP BY ALL) f USING (tenant_id, canonical_id)
WHERE e.n IS DISTINCT FROM f.n""",
        "early",
    ),
)
def _(spark, sf_dir):
    rows = written(spark, sf_dir)
    count = lambda df: df.groupBy(*profiles.KEY).agg(F.count("*").alias("n"))
    out = store.cdc(count(_early(rows)), count(rows.where("event_ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00'")))
    return out.select("tenant_id", "canonical_id", "op", F.coalesce("before.n", F.lit(-1)).alias("before_total"), F.coalesce("after.n", F.lit(-1)).alias("after_total"))


@query(
    "cdc_messages",
    over(
        """SELECT tenant_id, canonical_id, CASE WHEN e.n IS NULL THEN 'c' WHEN f.n IS NULL THEN 'd' ELSE 'u' END AS op, e.n AS before_total, f.n AS after_total, CASE WHEN f.n IS NULL THEN NULL ELSE canonical_id END AS after_id
FROM (SELECT tenant_id, canonical_id, count(*) AS n FROM early GROUP BY ALL) e FULL JOIN (SELECT tenant_id, canonical_id, count(*) AS n FROM unified WHERE event_ts >= TIMESTAMP '2024-01-08' GROUP BY ALL) f USING (tenant_id, canonical_id)
WHERE e.n IS DISTINCT FROM f.n""",
        "early",
    ),
)
def _(spark, sf_dir):
    """Change messages, written as JSON lines and read back."""
    rows = written(spark, sf_dir)
    count = lambda df: df.groupBy(*profiles.KEY).agg(F.count("*").alias("n"))
    changes = store.cdc(count(_early(rows)), count(rows.where("event_ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00'")))
    path = f"{shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    store.debezium(changes).select("value").write.text(path)
    said = lambda p: F.get_json_object("value", f"$.{p}")
    either = lambda c: F.coalesce(said(f"after.{c}"), said(f"before.{c}")).alias(c)
    return spark.read.text(path).select(
        either("tenant_id"), either("canonical_id"), said("op").alias("op"), said("before.n").cast("long").alias("before_total"), said("after.n").cast("long").alias("after_total"), said("after.canonical_id").alias("after_id")
    )


@query("json_sink", over(f"SELECT {COLUMNS17} FROM unified", "unified"))
def _(spark, sf_dir):
    """Unified events as JSON lines, read back by the declared schema."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    writers.write_json(written(spark, sf_dir).select(*store.EVENT_COLUMNS), path)
    return readers.json_events(spark, path, UNIFIED_EVENT).select(*store.EVENT_COLUMNS)


@query("keyed_records", over("SELECT canonical_id AS key, event_id, event_type, coalesce(page_url, 'none') AS page_url FROM unified", "unified"))
def _(spark, sf_dir):
    """What the keyed sink sends: the person as key, the event as JSON."""
    said = writers.records(written(spark, sf_dir).select(*store.EVENT_COLUMNS), "canonical_id")
    of = lambda c: F.get_json_object("value", f"$.{c}")
    return said.select("key", of("event_id").alias("event_id"), of("event_type").alias("event_type"), F.coalesce(of("page_url"), F.lit("none")).alias("page_url"))


@query(
    "session_closure_reset",
    over(
        """SELECT tenant_id, canonical_id, CASE WHEN end_ts + INTERVAL 30 MINUTE <= (SELECT max(event_ts) - INTERVAL 5 SECOND FROM unified) THEN NULL ELSE session_id END AS session_id
FROM sess QUALIFY row_number() OVER (PARTITION BY tenant_id, canonical_id ORDER BY start_ts DESC, session_id DESC) = 1""",
        "sess",
    ),
)
def _(spark, sf_dir):
    """The last session of each person, null once it is closed."""
    rows = written(spark, sf_dir)
    last = stored(spark, sf_dir).windows().groupBy("tenant_id", "canonical_id").agg(F.max(F.struct("start_ts", "session_id")).alias("s"))
    current = last.select("tenant_id", "canonical_id", "s.session_id", "s.start_ts")
    return sessions.reset_closed(current, sessions.closed_by_stream(rows)).drop("start_ts")


@query(
    "display_columns",
    over(
        f"""SELECT event_id, CASE WHEN length(anonymous_id) > 8 THEN substr(anonymous_id, 1, 8) || '...' ELSE anonymous_id END AS short_id,
  CASE upper(country) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items())} ELSE 'Unknown' END AS country,
  chr(127397 + ascii(upper(country))) || chr(127397 + ascii(substr(upper(country), 2))) AS flag,
  CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' ELSE substr(event_time, 1, 10) END AS ago
FROM (SELECT *, CAST(trunc((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(event_ts)) / 1000) AS BIGINT) AS s FROM raw) WHERE length(country) = 2""",
        "raw",
    ),
)
def _(spark, sf_dir):
    rows = raw_events(spark, sf_dir).where("length(country) = 2")
    now = F.lit(NOW).cast("timestamp_ntz")
    return rows.select("event_id", D.short_id("anonymous_id").alias("short_id"), D.country_name("country").alias("country"), D.country_flag("country").alias("flag"), D.relative_time("event_time", now).alias("ago"))


@query("upsert_latest", over("SELECT tenant_id, canonical_id, arg_max(event_id, seq) AS event_id, max(seq) AS version FROM unified GROUP BY tenant_id, canonical_id", "unified"))
def _(spark, sf_dir):
    rows = unified(spark, sf_dir).select("tenant_id", "canonical_id", "event_id", F.col("seq").alias("version"))
    return store.upsert(rows, "version")


@query("retention", over("SELECT event_id, tenant_id FROM raw WHERE event_ts >= TIMESTAMP '2024-01-15'", "raw"))
def _(spark, sf_dir):
    return store.retain(raw_events(spark, sf_dir), "2024-01-22 00:00:00", days=7).select("event_id", "tenant_id")


# --- catalogue --------------------------------------------------------------------------------------------------------

VIEW = ", ".join(f"coalesce({c}, '') AS {c}" if c in ("user_id", "session_id", "page_url", "device_type", "browser", "country") else c for c in C.EVENT_VIEW)


def _newest(where: str, n: int) -> str:
    return over(f"SELECT {VIEW} FROM unified WHERE {where} ORDER BY event_time DESC, event_id LIMIT {n}", "unified")


TENANTS = "SELECT u.tenant_id, count(*) AS event_count, count(DISTINCT canonical_id) AS user_count FROM unified u {where} GROUP BY u.tenant_id"


@query("tenants", over(TENANTS.format(where=""), "unified"))
def _(spark, sf_dir):
    return C.tenants(tables(spark, sf_dir))


@query("tenant", over(TENANTS.format(where=f"WHERE tenant_id = '{TENANT}'"), "unified"))
def _(spark, sf_dir):
    return C.tenants(tables(spark, sf_dir), TENANT)


TOTAL = "(SELECT count(*) FROM profiles {where}) AS total_count"


@query("users_page", over(f"SELECT {LISTED}, {TOTAL.format(where='')} FROM profiles ORDER BY first_seen DESC, tenant_id, canonical_id LIMIT 25 OFFSET 10", "profiles"))
def _(spark, sf_dir):
    return flat(C.users(tables(spark, sf_dir), None, 10))


@query("tenant_users_page", over(f"SELECT {LISTED}, {TOTAL.format(where=f'''WHERE tenant_id = '{TENANT}' ''')} FROM profiles WHERE tenant_id = '{TENANT}' ORDER BY total_events DESC, tenant_id, canonical_id LIMIT 7 OFFSET 3", "profiles"))
def _(spark, sf_dir):
    return flat(C.tenant_users(tables(spark, sf_dir), TENANT, 7, 3, "total_events", "desc"))


@query("events_filtered", _newest("event_type = 'click' AND device_type = 'mobile'", 100))
def _(spark, sf_dir):
    return C.events(tables(spark, sf_dir), None, "click", "mobile")


@query("event_lookup", _newest("tenant_id = 'tenant-3' AND event_id = '1234'", 1))
def _(spark, sf_dir):
    return C.event(tables(spark, sf_dir), "tenant-3", "1234", "not-a-date")


@query("events_by_id", over(f"SELECT {', '.join(C.EVENT_VIEW)} FROM unified WHERE event_id IN ('5', '17', '999')", "unified"))
def _(spark, sf_dir):
    return C.events_by_id(tables(spark, sf_dir), ["5", "17", "999"])


PERSON = "(SELECT canonical_id FROM unified WHERE event_id = '0')"


def _person(t: C.Tables) -> tuple[str, str]:
    r = t.events.where("event_id = '0'").select("tenant_id", "canonical_id").first()
    return r["tenant_id"], r["canonical_id"]


@query("live_profile", over(f"SELECT {LISTED} FROM profiles WHERE canonical_id = {PERSON}", "profiles"))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return flat(C.live_profile(t, *_person(t)))


@query("recent_events", _newest(f"canonical_id = {PERSON}", 50))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.recent_events(t, *_person(t))


@query(
    "recent_events_of_page",
    over(f"""SELECT CAST(rank AS INTEGER) AS rank, {VIEW} FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, canonical_id ORDER BY event_time DESC, event_id) AS rank FROM unified
WHERE canonical_id IN (SELECT canonical_id FROM (SELECT tenant_id, canonical_id, min(event_ts) AS f FROM unified GROUP BY ALL) ORDER BY f DESC, tenant_id, canonical_id LIMIT 25)) WHERE rank <= 5""", "unified"),
)
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    people = t.profiles.orderBy(F.desc("first_seen"), "tenant_id", "canonical_id").limit(25)
    return C.recent_events_of_page(t, people)


@query("tenant_events_filtered", _newest(f"tenant_id = '{TENANT}' AND event_type = 'page_view' AND event_time >= '2024-01-10 00:00:00.000' AND event_time <= '2024-01-12 00:00:00.000'", 50))
def _(spark, sf_dir):
    return C.tenant_events(tables(spark, sf_dir), TENANT, None, None, "page_view", "2024-01-10 00:00:00.000", "2024-01-12 00:00:00.000")


@query("tenant_summary", over(f"SELECT event_type, count(*) AS count FROM raw WHERE tenant_id = '{TENANT}' GROUP BY event_type", "raw"))
def _(spark, sf_dir):
    return C.tenant_summary(tables(spark, sf_dir), TENANT)


def _aggregates() -> None:
    for dim in C.Dimension:
        for metric, value, exact in (("count", "count(*)", False), ("unique_sessions", "count(DISTINCT session_id)", True)):
            sql = over(f"SELECT {dim.value} AS label, {value} AS value FROM raw WHERE tenant_id = '{TENANT}' AND {dim.value} <> '' GROUP BY 1 ORDER BY value DESC, label LIMIT 100", "raw")
            query(f"tenant_aggregate_{dim.value}_{metric}", sql)(lambda spark, sf_dir, d=dim.value, m=metric, e=exact: C.tenant_aggregate(tables(spark, sf_dir), TENANT, d, m, exact=e))
    query("tenant_aggregate_unique_sessions_hll")(lambda spark, sf_dir: C.tenant_aggregate(tables(spark, sf_dir), TENANT, "country", "unique_sessions"))


_aggregates()


@query("dashboard_stats", over("SELECT count(DISTINCT tenant_id || canonical_id) AS total_users, count(*) AS total_events FROM unified", "unified"))
def _(spark, sf_dir):
    return C.dashboard_stats(tables(spark, sf_dir))


def _over_ranges() -> None:
    for span in C.TimeRange:
        n, name = span.days, span.name.lower()
        bucket = "hour" if span.hourly else "date"
        week = span is TimeRange.QUARTER
        floor = f"date_trunc('{'hour' if span.hourly else 'day'}', TIMESTAMP '{NOW}' - INTERVAL {n} DAY)"
        query(
            f"analytics_summary_{name}",
            over(
                f"""SELECT u.n AS users, s.n AS sessions, e.n AS events, coalesce(s.d, 0.0) AS avg_session_duration, CASE WHEN s.n = 0 THEN 0.0 ELSE e.n / s.n END AS events_per_session
FROM (SELECT count(*) AS n FROM (SELECT max(event_ts) AS m FROM unified GROUP BY tenant_id, canonical_id) WHERE m > {floor}) u,
(SELECT count(*) AS n, avg(duration_sec) FILTER (duration_sec > 0) AS d FROM stored WHERE {since('session', n)}) s, (SELECT count(*) AS n FROM unified WHERE {since('event', n)}) e""",
                "stored",
            ),
        )(lambda spark, sf_dir, span=span: C.analytics_summary(tables(spark, sf_dir), span))

        def series(source: str, prefix: str, value: str, weekly: str, col: str, keys: str = "", where: str = "TRUE", n=n, bucket=bucket, week=week) -> str:
            by = f", {keys}" if keys else ""
            daily = f"SELECT {prefix}_{bucket} AS bucket{by}, {value} AS {col} FROM {source} WHERE {since(prefix, n)} AND {where} GROUP BY ALL"
            if week:
                daily = f"SELECT strftime(date_trunc('week', CAST(bucket AS DATE)), '%Y-%m-%d') AS bucket{by}, {weekly} AS {col} FROM ({daily}) GROUP BY ALL"
            return over(f"SELECT bucket, {label(n)} AS label{by}, {col} FROM ({daily})", "stored" if prefix == "session" else "unified")

        query(f"events_over_time_{name}", series("unified", "event", "count(*)", "CAST(sum(count) AS BIGINT)", "count", "event_type"))(lambda spark, sf_dir, span=span: C.events_over_time(tables(spark, sf_dir), span))
        query(f"users_over_time_{name}", series("unified", "event", "count(DISTINCT canonical_id)", "CAST(sum(count) AS BIGINT)", "count"))(lambda spark, sf_dir, span=span: C.users_over_time(tables(spark, sf_dir), span, exact=True))
        query(f"sessions_over_time_{name}", series("stored", "session", "count(*)", "CAST(sum(count) AS BIGINT)", "count"))(lambda spark, sf_dir, span=span: C.sessions_over_time(tables(spark, sf_dir), span))
        query(f"avg_session_duration_{name}", series("stored", "session", "round(avg(duration_sec), 1)", "round(avg(value), 1)", "value", where="duration_sec > 0"))(lambda spark, sf_dir, span=span: C.avg_session_duration(tables(spark, sf_dir), span))
    for what, column, f, limit in (("top_pages", "page_url", C.top_pages, "LIMIT 10"), ("browser_breakdown", "browser", C.browser_breakdown, "LIMIT 10"), ("country_breakdown", "country", C.country_breakdown, "LIMIT 10"), ("device_breakdown", "device_type", C.device_breakdown, "")):
        for span in C.TimeRange:
            sql = over(f"SELECT {column} AS label, count(*) AS count FROM (SELECT *, strftime(event_ts, '%Y-%m-%d') AS event_date, strftime(event_ts, '%Y-%m-%d %H') AS event_hour FROM raw) WHERE {since('event', span.days)} AND {column} <> '' GROUP BY 1 ORDER BY count DESC, label {limit}", "raw")
            query(f"{what}_{span.name.lower()}", sql)(lambda spark, sf_dir, f=f, span=span: f(tables(spark, sf_dir), span))


_over_ranges()


@query("hll_daily_users")
def _(spark, sf_dir):
    return C.users_over_time(tables(spark, sf_dir), TimeRange.MONTH)


@query("event_rate_rolling", over("SELECT event_hour, n AS events, avg(n) OVER (ORDER BY event_hour ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling FROM (SELECT strftime(event_ts, '%Y-%m-%d %H') AS event_hour, count(*) AS n FROM raw GROUP BY 1)", "raw"))
def _(spark, sf_dir):
    return C.event_rate_rolling(tables(spark, sf_dir))


# --- store ------------------------------------------------------------------------------------------------------------


@query("events_rollup_cube", over(f"SELECT {', '.join(store.EVENT_DIMS)}, count(*) AS events, count(*) AS event_count FROM unified GROUP BY ALL", "unified"))
def _(spark, sf_dir):
    return tables(spark, sf_dir).event_cube.drop("sessions_hll", "users_hll")


@query("sessions_rollup_cube", over(f"SELECT {', '.join(store.SESSION_DIMS)}, count(*) AS sessions, CAST(sum(duration_sec) AS BIGINT) AS duration_sec, CAST(sum(event_count) AS BIGINT) AS event_count FROM stored GROUP BY ALL", "stored"))
def _(spark, sf_dir):
    return tables(spark, sf_dir).session_cube


@query("rollup_routed_query", over("SELECT country, event_type, count(*) AS count FROM raw WHERE tenant_id = 'tenant-1' GROUP BY ALL", "raw"))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return store.routed_count(t.events, t.event_cube, ["country", "event_type"], {"tenant_id": TENANT})[0]


@query("rollup_full_scan", over("SELECT os, count(*) AS count FROM raw GROUP BY ALL", "raw"))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return store.routed_count(t.events, t.event_cube, ["os"])[0]


@query("rollup_users_hll")
def _(spark, sf_dir):
    return store.users_from_cube(tables(spark, sf_dir).event_cube, ["tenant_id", "event_date"])


def _near(exact: DataFrame, estimated: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The exact rows, and near: whether the sketch's estimate is within five standard errors, or 2, of the value."""
    estimate = estimated.select(*keys, F.col(value).alias("estimate"))
    allowed = F.greatest(F.lit(2.0), F.col(value) * (5 * 1.04 / 2 ** (store.HLL_LOG2M / 2)))
    near = F.coalesce(F.abs(F.col("estimate") - F.col(value)) <= allowed, F.lit(False)).alias("near")
    return exact.join(estimate, keys, "left").select(*keys, value, near)


def _near_sql(sql: str) -> str:
    return f"SELECT *, TRUE AS near FROM ({sql})"


@query("hll_daily_users_bounds", _near_sql(ORACLES["users_over_time_month"]))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    return _near(C.users_over_time(t, TimeRange.MONTH, exact=True), C.users_over_time(t, TimeRange.MONTH), ["bucket", "label"], "count")


@query("rollup_users_hll_bounds", _near_sql(over("SELECT tenant_id, strftime(event_ts, '%Y-%m-%d') AS event_date, count(DISTINCT canonical_id) AS users FROM unified GROUP BY ALL", "unified")))
def _(spark, sf_dir):
    t, keys = tables(spark, sf_dir), ["tenant_id", "event_date"]
    exact = t.events.groupBy(*keys).agg(F.count_distinct("canonical_id").alias("users"))
    return _near(exact, store.users_from_cube(t.event_cube, keys), keys, "users")


@query("tenant_aggregate_unique_sessions_hll_bounds", _near_sql(ORACLES["tenant_aggregate_country_unique_sessions"]))
def _(spark, sf_dir):
    t = tables(spark, sf_dir)
    exact, estimated = (C.tenant_aggregate(t, TENANT, "country", "unique_sessions", exact=e) for e in (True, False))
    return _near(exact, estimated, ["label"], "value")


@query("lake_partitioned_roundtrip", over(f"SELECT {COLUMNS17} FROM capture", "capture"))
def _(spark, sf_dir):
    path = f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}"
    store.write_lake(unified(spark, sf_dir), path)
    return store.read_lake(spark, path)


@query("ingestion_columns", over("SELECT event_id, strftime(event_ts, '%Y-%m-%d') AS event_date, strftime(event_ts, '%Y-%m-%d %H') AS event_hour, CAST(1 AS INTEGER) AS event_count FROM raw", "raw"))
def _(spark, sf_dir):
    return raw_events(spark, sf_dir).select("event_id", event_date("event_ts").alias("event_date"), event_hour("event_ts").alias("event_hour"), F.lit(1).alias("event_count"))


@query("string_agg_fragments", over("""SELECT tenant_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT tenant_id, event_type, count(*) AS n FROM raw GROUP BY ALL) GROUP BY tenant_id""", "raw"))
def _(spark, sf_dir):
    counts = raw_events(spark, sf_dir).groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("tenant_id").agg(F.expr("listagg(concat(event_type, '=', cast(n as string)), ',') WITHIN GROUP (ORDER BY event_type)").alias("counts"))


# --- the operators above, on the star schema -----------------------------------------------------------------------------


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("star_left_join_default", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(spark, sf_dir):
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("star_inner_join", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, sf_dir):
    # Nations are a closed list; counted before the join, one row a nation is joined.
    counts = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return counts.join(_t(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "customers")


@query("star_union_all", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def _(spark, sf_dir):
    of = lambda name, key: _t(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "nation", "n")
    return of("customer", "c_nationkey").unionByName(of("supplier", "s_nationkey"))


@query("star_top_k_per_group", "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return _t(spark, sf_dir, "orders").withColumn("r", rank).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("star_page", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).offset(40).limit(20)


@query("star_arrays", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.count("*").alias("n"))


@query("star_filtered_aggregates", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS large, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("star_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) > 5")
def _(spark, sf_dir):
    out = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return out.where("f > 0 AND n > 5").drop("f")


@query("star_distinct_from", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "orders").where(~F.col("o_orderstatus").eqNullSafe("F")).select("o_orderkey")
