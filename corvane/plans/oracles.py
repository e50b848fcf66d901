"""DuckDB SQL by common table expressions: each name below reads those it lists, down to the driver's tables."""

from __future__ import annotations

from corvane.sources.driver_events import NOW
from corvane.sources.driver_events import SQL as RAW_SQL

COLUMNS16 = "event_id, event_type, tenant_id, event_time, anonymous_id, user_id, session_id, page_url, referrer, element_id, feature_name, device_type, browser, os, country, properties"


def _last(column: str) -> str:
    return f"coalesce(arg_max({column}, seq) FILTER ({column} <> ''), '')"


def _core(source: str) -> str:
    """Counters, last values and calendar counts of a person; the last arrival's date is the reference."""
    ranges = ", ".join(f"count(*) FILTER (CAST(event_ts AS DATE) BETWEEN today - {n - 1} AND today) AS events_{n}d" for n in (1, 7, 30, 90))
    return f"""SELECT tenant_id, canonical_id, epoch_ms(min(event_ts)) AS first_seen, epoch_ms(max(event_ts)) AS last_seen, count(*) AS total_events,
  count(*) FILTER (event_type = 'page_view') AS page_views, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'login') AS logins, count(*) FILTER (event_type = 'feature_used') AS feature_uses,
  {_last('user_id')} AS user_id, {_last('page_url')} AS last_page, {_last('country')} AS last_country, {_last('device_type')} AS last_device, {_last('browser')} AS last_browser,
  {ranges}
FROM {source}, (SELECT CAST(arg_max(event_ts, seq) AS DATE) AS today FROM {source}) GROUP BY tenant_id, canonical_id"""


def _top(source: str, item: str, k: int, into: str) -> str:
    return f"""SELECT tenant_id, canonical_id, list(item ORDER BY uses DESC, item) AS {into} FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, canonical_id ORDER BY uses DESC, item) AS r FROM (
    SELECT tenant_id, canonical_id, {item} AS item, count(*) AS uses FROM {source} WHERE {item} <> '' GROUP BY ALL)) WHERE r <= {k} GROUP BY tenant_id, canonical_id"""


def _profiles(source: str, sess: str) -> str:
    return f"""SELECT c.*, coalesce(p.top_pages, []) AS top_pages, coalesce(f.top_features, []) AS top_features, m.avg_session_duration_sec FROM ({_core(source)}) c
LEFT JOIN ({_top(source, 'page_url', 5, 'top_pages')}) p USING (tenant_id, canonical_id)
LEFT JOIN ({_top(source, 'feature_name', 3, 'top_features')}) f USING (tenant_id, canonical_id)
LEFT JOIN (SELECT tenant_id, canonical_id, sum(duration_ms) / count(*) / 1000.0 AS avg_session_duration_sec FROM {sess}
  WHERE end_ts + INTERVAL 30 MINUTE <= (SELECT max(event_ts) - INTERVAL 5 SECOND FROM {source}) GROUP BY ALL) m USING (tenant_id, canonical_id)"""


def _sess(source: str) -> str:
    return f"""SELECT tenant_id, session_id, sn, arg_min(canonical_id, seq) AS canonical_id, min(event_ts) AS start_ts, max(event_ts) AS end_ts, count(*) AS event_count,
  coalesce(list_sort(list(DISTINCT page_url) FILTER (page_url <> '')), []) AS pages,
  {_last('device_type')} AS device_type, {_last('browser')} AS browser, {_last('country')} AS country,
  epoch_ms(max(event_ts)) - epoch_ms(min(event_ts)) AS duration_ms
FROM (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, session_id ORDER BY seq) AS sn FROM (
  SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY tenant_id, session_id ORDER BY seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM {source} WHERE session_id <> '')) GROUP BY tenant_id, session_id, sn"""


CTES = {
    "raw": RAW_SQL,
    "placed": """SELECT *, last_value(nullif(user_id, '') IGNORE NULLS) OVER (PARTITION BY tenant_id, anonymous_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user,
  first_value(event_id) OVER (PARTITION BY tenant_id, anonymous_id ORDER BY seq) AS device_first,
  row_number() OVER (PARTITION BY tenant_id, anonymous_id ORDER BY seq) = 1 AS is_first FROM raw""",
    "people": """SELECT tenant_id, user_id AS usr, seq AS first_seq, prev_user, device_first FROM placed WHERE user_id <> ''
QUALIFY row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY seq) = 1""",
    "canon": """SELECT tenant_id, usr, first_seq, substr(sha256(tenant_id || '|' || device_first), 1, 32) AS canon FROM people WHERE prev_user IS NULL
UNION ALL SELECT p.tenant_id, p.usr, p.first_seq, c.canon FROM people p JOIN canon c ON p.tenant_id = c.tenant_id AND p.prev_user = c.usr""",
    "capture": """SELECT p.*, coalesce(own.canon, before_id, device_id) AS canonical_id,
  CASE WHEN p.user_id <> '' AND before_id IS NOT NULL AND own.first_seq < p.seq AND before_id <> own.canon THEN before_id END AS merge_old
FROM (SELECT placed.*, coalesce(past.canon, CASE WHEN NOT is_first THEN substr(sha256(placed.tenant_id || '|' || device_first), 1, 32) END) AS before_id,
    substr(sha256(placed.tenant_id || '|' || device_first), 1, 32) AS device_id
  FROM placed LEFT JOIN canon past ON placed.tenant_id = past.tenant_id AND placed.prev_user = past.usr) p
LEFT JOIN canon own ON p.tenant_id = own.tenant_id AND p.user_id = own.usr""",
    "unified": f"SELECT {COLUMNS16}, canonical_id, event_ts, seq, strftime(event_ts, '%Y-%m-%d') AS event_date, strftime(event_ts, '%Y-%m-%d %H') AS event_hour FROM capture",
    "sess": _sess("unified"),
    "types": """SELECT tenant_id, session_id, sn, event_type, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id, session_id ORDER BY seq) AS sn FROM (
  SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY tenant_id, session_id ORDER BY seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM unified WHERE session_id <> '')) GROUP BY ALL""",
    "stored": "SELECT *, CAST(duration_ms // 1000 AS BIGINT) AS duration_sec, strftime(start_ts, '%Y-%m-%d') AS session_date, strftime(start_ts, '%Y-%m-%d %H') AS session_hour FROM sess",
    "done": "SELECT * FROM sess WHERE end_ts + INTERVAL 30 MINUTE <= (SELECT max(event_ts) - INTERVAL 5 SECOND FROM unified)",
    "profiles": _profiles("unified", "sess"),
    "early": "SELECT * FROM unified WHERE event_ts < TIMESTAMP '2024-01-16'",
    "early_sess": _sess("early"),
    "early_profiles": _profiles("early", "early_sess"),
}
NEEDS = {
    "raw": [], "placed": ["raw"], "people": ["placed"], "canon": ["people"], "capture": ["placed", "canon"], "unified": ["capture"], "sess": ["unified"], "types": ["unified"], "stored": ["sess"], "done": ["sess"],
    "profiles": ["sess"], "early": ["unified"], "early_sess": ["early"], "early_profiles": ["early_sess"],
}


def over(sql: str, *names: str) -> str:
    """``sql`` after the common table expressions that ``names`` need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + sql


def since(prefix: str, days: int) -> str:
    if days == 1:
        return f"{prefix}_hour >= strftime(TIMESTAMP '{NOW}' - INTERVAL 1 DAY, '%Y-%m-%d %H')"
    return f"{prefix}_date >= strftime(TIMESTAMP '{NOW}' - INTERVAL {days} DAY, '%Y-%m-%d')"


def label(days: int, column: str = "bucket") -> str:
    return f"strftime(strptime({column}, '%Y-%m-%d %H'), '%H:00')" if days == 1 else f"strftime(CAST({column} AS DATE), '%b %d')"
