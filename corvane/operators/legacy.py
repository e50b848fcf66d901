"""The older generation's semantics (mode="legacy"): arrival order, timers, decay and 33 profile fields.

Both reducers are plain state machines over a JSON-able dict, so that tests can drive their clocks; the streaming
processors keep that dict as keyed state. Times are epoch milliseconds, dates ISO text in UTC.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta

from corvane.functions.schemas import WINDOWS_DAYS
from corvane.operators.profiles import COMPARED, ON_CREATE, TOP_FEATURES, TOP_PAGES

GAP_MS, DAY_MS = 30 * 60_000, 86_400_000
#: How far ahead of the clock a time may be, and how many days behind; beyond, the clock's own time is taken.
AHEAD_MS, BEHIND_DAYS = 60_000, 91
DECAYS = {"window_decay_1d": 1, "window_decay_7d": 7, "window_decay_30d": 30}


def text(ms: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat(" ", "milliseconds")


def day(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).date().isoformat()


def sane_time(ms: int, clock: int) -> int:
    return clock if ms > clock + AHEAD_MS or ms < clock - BEHIND_DAYS * DAY_MS else ms


@dataclass
class Session:
    """Keyed by session id alone: first arrival names it, the latest time extends it, one timer closes it."""

    state: dict = field(default_factory=dict)

    def add(self, e: dict, ms: int) -> int:
        """Takes an event; returns the time at which the session closes unless more comes."""
        s = self.state
        if not s:
            s.update(session_id=e["session_id"], canonical_id=e["canonical_id"], tenant_id=e["tenant_id"], start=ms, last=ms, count=0, pages=[], types={}, device_type="", browser="", country="")
        s["last"] = max(s["last"], ms)
        s["count"] += 1
        if e.get("page_url") and e["page_url"] not in s["pages"]:
            s["pages"].append(e["page_url"])
        s["types"][e["event_type"]] = s["types"].get(e["event_type"], 0) + 1
        for c in ("device_type", "browser", "country"):
            s[c] = e.get(c) or s[c]
        return s["last"] + GAP_MS

    def close(self) -> dict:
        s, self.state = self.state, {}
        return {
            "session_id": s["session_id"], "canonical_id": s["canonical_id"], "tenant_id": s["tenant_id"], "start_time": text(s["start"]), "end_time": text(s["last"]), "duration_sec": (s["last"] - s["start"]) // 1000,
            "event_count": s["count"], "pages": s["pages"], "event_types": s["types"], "device_type": s["device_type"], "browser": s["browser"], "country": s["country"],
        }


def _top(counts: dict[str, int], k: int) -> list[str]:
    """Most used first; the older generation leaves ties open, here they are lexical."""
    return sorted(counts, key=lambda x: (-counts[x], x))[:k]


@dataclass
class Profile:
    """Keyed by canonical id. timers: name to event time; the caller keeps them in step with its timer service."""

    state: dict = field(default_factory=dict)

    @property
    def timers(self) -> dict[str, int]:
        return self.state.setdefault("timers", {})

    def add(self, e: dict, event_ms: int, clock: int) -> bool:
        """Takes an event; True if it made the profile."""
        s, ms = self.state, sane_time(event_ms, clock)
        made = "canonical_id" not in s
        if made:
            s.update(canonical_id=e["canonical_id"], tenant_id=e["tenant_id"], first_seen=ms, last_seen=ms, total=0, kinds={}, days={}, session_days={}, sessions=0, session=None, closed=0, closed_ms=0, pages={}, features={}, told=None)
            s.update(user_id="", last_page="", last_country="", last_device="", last_browser="")
        today = day(ms)
        s["last_seen"] = max(s["last_seen"], ms)
        s["total"] += 1
        s["kinds"][e["event_type"]] = s["kinds"].get(e["event_type"], 0) + 1
        s["days"][today] = s["days"].get(today, 0) + 1
        for into, c in (("user_id", "user_id"), ("last_page", "page_url"), ("last_country", "country"), ("last_device", "device_type"), ("last_browser", "browser")):
            s[into] = e.get(c) or s[into]
        for into, c in (("pages", "page_url"), ("features", "feature_name")):
            if e.get(c):
                s[into][e[c]] = s[into].get(e[c], 0) + 1
        if sid := e.get("session_id"):
            # A timeout forgets the id, so the same one coming back is a new session.
            if s["session"] is None or sid != s["session"]["id"]:
                s["sessions"] += 1
                s["session_days"][today] = s["session_days"].get(today, 0) + 1
                s["session"] = {"id": sid, "start": ms}
        self._prune(clock)
        # Activity calls off what was due; the session's deadline counts from this event, even an older one.
        s["timers"] = {"session": ms + GAP_MS}
        return made

    def _prune(self, clock: int) -> None:
        oldest = day(clock - BEHIND_DAYS * DAY_MS)
        for name in ("days", "session_days"):
            self.state[name] = {d: n for d, n in self.state[name].items() if d >= oldest}

    def fire(self, ms: int, clock: int) -> list[dict]:
        """What the timers due at ``ms`` publish."""
        out = []
        for name, due in sorted(self.timers.items(), key=lambda x: x[1]):
            if due > ms or self.timers.get(name) != due:
                continue
            del self.timers[name]
            s = self.state
            if name == "session":
                if s["session"] is None:
                    continue  # no session to close: nothing to tell, and nothing decays
                s["closed"] += 1
                # Events without a session id lengthen the session too.
                s["closed_ms"] += max(0, s["last_seen"] - s["session"]["start"])
                s["session"] = None
                self.timers.update({d: s["last_seen"] + n * DAY_MS for d, n in DECAYS.items()})
                out.append(self.publish("update", "session_timeout", day(ms), clock))
            else:
                out.append(self.publish("update", name, day(due), clock))
        return out

    def publish(self, action: str, trigger: str, today: str, clock: int) -> dict:
        """The 33 fields, as of the date ``today``."""
        s = self.state
        first = {n: (date.fromisoformat(today) - timedelta(days=n - 1)).isoformat() for n in WINDOWS_DAYS}
        within = lambda days, n: sum(v for d, v in days.items() if first[n] <= d <= today)
        kind = lambda k: s["kinds"].get(k, 0)
        out = {
            "tenant_id": s["tenant_id"], "canonical_id": s["canonical_id"], "first_seen": s["first_seen"], "last_seen": s["last_seen"], "total_events": s["total"],
            "page_views": kind("page_view"), "clicks": kind("click"), "logins": kind("login"), "feature_uses": kind("feature_used"),
            **{c: s[c] for c in ("user_id", "last_page", "last_country", "last_device", "last_browser")},
            **{f"events_{n}d": within(s["days"], n) for n in WINDOWS_DAYS},
            "top_pages": _top(s["pages"], TOP_PAGES), "top_features": _top(s["features"], TOP_FEATURES),
            "avg_session_duration_sec": s["closed_ms"] // s["closed"] // 1000 if s["closed"] else 0,
            "action": action, "updated_at": text(clock), "total_sessions": s["sessions"],
            **{f"sessions_{n}d": within(s["session_days"], n) for n in WINDOWS_DAYS},
            "current_session_active": s["session"] is not None,
            "current_session_duration_sec": (clock - s["session"]["start"]) // 1000 if s["session"] else 0,
        }
        told = s["told"]
        out["changed_fields"] = list(ON_CREATE) if action == "create" or told is None else [c for c in COMPARED if told[c] != out[c]]
        out |= {"timestamp": text(clock), "trigger": trigger}
        s["told"] = {c: out[c] for c in COMPARED}
        return out
