"""Figures of a running stream: counters of its rows, and how long its batches take."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Batches whose times are kept for the quantiles.
KEPT = 10_000


def counted(df: DataFrame, name: str, parts: dict[str, Column]) -> DataFrame:
    """df with counters of its rows, observed by batch under `name`: all, and for each part those
    that fulfil it. Nothing is computed twice: the counts ride on the rows."""
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in parts.items()]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


class Figures(StreamingQueryListener):
    """Collects what counted() observes in the queries of a session, and their batches' times:
    sums of counters by name, and quantiles of seconds by stage of a batch. Register it with
    spark.streams.addListener()."""

    def __init__(self) -> None:
        self.counters: dict[str, Counter[str]] = {}
        self.seconds: dict[str, list[float]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows and not p.observedMetrics:
            return
        for name, row in p.observedMetrics.items():
            self.counters.setdefault(name, Counter()).update({k: v for k, v in row.asDict().items() if v is not None})
        for stage, ms in p.durationMs.items():
            times = self.seconds.setdefault(stage, [])
            times.append(ms / 1000)
            del times[:-KEPT]

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception

    def latency(self, stage: str = "triggerExecution") -> dict[str, float]:
        """count, median, p95 and max of a stage's seconds; empty before the first batch."""
        times = sorted(self.seconds.get(stage, []))
        if not times:
            return {}
        at = lambda q: times[min(len(times) - 1, int(q * len(times)))]
        return {"count": len(times), "median": at(0.5), "p95": at(0.95), "max": times[-1]}
