"""What a query did: its text, the path taken, time, files and rows scanned, for display next to its result."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Row


@dataclass
class QueryStats:
    """segments are the files of the tables read: all there are, and those left after pruning."""

    sql: str
    backend: str
    path: str | None = None
    elapsed_ms: float | None = None
    segments_total: int | None = None
    segments_read: int | None = None
    rows_scanned: int | None = None
    rows: int | None = None

    def as_dict(self) -> dict:
        return asdict(self)


class Collector:
    """Statistics of the queries of one request; threads may share it."""

    def __init__(self) -> None:
        self._lock, self._held = threading.Lock(), []

    def push(self, stats: QueryStats) -> None:
        with self._lock:
            self._held.append(stats)

    def take(self) -> list[QueryStats]:
        with self._lock:
            out, self._held = self._held, []
        return out


def _scans(plan) -> Iterator:
    """The file scans of an executed plan, through adaptive execution's stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        yield plan
    elif kind == "AdaptiveSparkPlanExec":
        yield from _scans(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
    elif kind == "ReusedExchangeExec":
        return
    else:
        children = plan.children()
        for k in range(children.size()):
            yield from _scans(children.apply(k))


def _metric(scan, name: str) -> int:
    found = scan.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def run(df: DataFrame, path: str | None = "FULL_SCAN", most: int = 10_000, sql: str | None = None, into: Collector | None = None) -> tuple[list[Row], QueryStats]:
    """Collects at most ``most`` rows, as an API page does, and tells what it took."""
    page = df.limit(most)
    began = time.perf_counter()
    rows = page.collect()
    spent = (time.perf_counter() - began) * 1000
    execution = page._jdf.queryExecution()
    scans = list(_scans(execution.executedPlan()))
    stats = QueryStats(
        sql or execution.optimizedPlan().toString(), "spark", path, round(spent, 3), len(df.inputFiles()),
        sum(_metric(s, "numFiles") for s in scans), sum(_metric(s, "numOutputRows") for s in scans), len(rows),
    )
    if into:
        into.push(stats)
    return rows, stats
