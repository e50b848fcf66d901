"""Declared schemas and domains; nothing is inferred from data."""

from __future__ import annotations

from enum import Enum

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

S, L = StringType(), LongType()


def _struct(required: str, optional: str = "", **other) -> StructType:
    return StructType([StructField(c, S, False) for c in required.split()] + [StructField(c, S) for c in optional.split()] + [StructField(c, t) for c, t in other.items()])


#: 16 text columns; five can't be null.
RAW_EVENT = _struct("event_id event_type tenant_id event_time anonymous_id", "user_id session_id page_url referrer element_id feature_name device_type browser os country properties")
UNIFIED_EVENT = StructType([*RAW_EVENT.fields, StructField("canonical_id", S, False)])
IDENTITY_MERGE = _struct("old_canonical_id canonical_id tenant_id merged_at")
SESSION_SUMMARY = _struct("session_id canonical_id tenant_id start_time end_time", "", duration_sec=L, event_count=IntegerType(), pages=ArrayType(S), event_types=MapType(S, IntegerType()), device_type=S, browser=S, country=S)
PROFILE_RELEASE = StructType(
    [
        *(StructField(c, S, False) for c in ("tenant_id", "canonical_id")),
        *(StructField(c, L, False) for c in ("first_seen", "last_seen", "total_events", "page_views", "clicks", "logins", "feature_uses")),
        *(StructField(c, S, False) for c in ("user_id", "last_page", "last_country", "last_device", "last_browser")),
        *(StructField(c, L, False) for c in ("events_1d", "events_7d", "events_30d", "events_90d")),
        *(StructField(c, ArrayType(S), False) for c in ("top_pages", "top_features")),
        StructField("avg_session_duration_sec", DoubleType()),
        StructField("action", S, False),
    ]
)
#: The older generation's profile: the release with a whole-second average, and eleven more.
PROFILE_FULL = StructType(
    [f if f.name != "avg_session_duration_sec" else StructField(f.name, L) for f in PROFILE_RELEASE.fields]
    + [
        StructField("updated_at", S),
        *(StructField(c, L) for c in ("total_sessions", "sessions_1d", "sessions_7d", "sessions_30d", "sessions_90d")),
        StructField("current_session_active", BooleanType()),
        StructField("current_session_duration_sec", L),
        StructField("changed_fields", ArrayType(S)),
        StructField("timestamp", S),
        StructField("trigger", S),
    ]
)
WINDOWS_DAYS = (1, 7, 30, 90)


class EventType(str, Enum):
    PAGE_VIEW, CLICK, SIGNUP, LOGIN, FEATURE_USED = "page_view", "click", "signup", "login", "feature_used"


class DeviceType(str, Enum):
    DESKTOP, MOBILE, TABLET = "desktop", "mobile", "tablet"


class TimeRange(Enum):
    """Days looked back, and buckets shown at most."""

    DAY, WEEK, MONTH, QUARTER = (1, 24), (7, 7), (30, 30), (90, 90)

    @property
    def days(self) -> int:
        return self.value[0]

    @property
    def limit(self) -> int:
        return self.value[1]

    @property
    def hourly(self) -> bool:
        return self is TimeRange.DAY


class Dimension(str, Enum):
    COUNTRY, DEVICE_TYPE, BROWSER, OS, EVENT_TYPE, PAGE_URL = "country", "device_type", "browser", "os", "event_type", "page_url"


class Metric(str, Enum):
    COUNT, UNIQUE_SESSIONS, UNIQUE_USERS = "count", "unique_sessions", "unique_users"


class ProfileSort(str, Enum):
    FIRST_SEEN, LAST_SEEN, TOTAL_EVENTS = "first_seen", "last_seen", "total_events"


class Order(str, Enum):
    ASC, DESC = "asc", "desc"
