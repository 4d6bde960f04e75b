"""Health and run metrics of streaming queries, from what Spark reports of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.sources.sinks import health

METRICS = "query string, batch long, at string, rows long, rows_per_second double, batch_ms long, ingest_ms long, state_rows long"


class HealthListener(StreamingQueryListener):
    """Hands a health document on at every report of a query, and keeps its latest reports for run_metrics.

    write gets the document; where it goes (a file, a table) is the caller's.
    """

    def __init__(self, write: Callable[[dict], None], component: str = "stream", keep: int = 10_000) -> None:
        self.write, self.component, self.keep = write, component, keep
        self.last: dict | None = None
        self.reports: list[tuple] = []
        self.observed: list[tuple] = []

    def _tell(self, status: str, now: str, error: Exception | None = None) -> None:
        self.last = health(status, now, self.component, self.last, error)
        self.write(self.last)

    def onQueryStarted(self, event) -> None:
        self._tell("ok", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = dict(p.durationMs)
        self.reports = [*self.reports, (str(p.id), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0.0), took.get("triggerExecution", 0), took.get("addBatch", 0), sum(s.numRowsTotal for s in p.stateOperators))][-self.keep :]
        for name, row in (p.observedMetrics or {}).items():
            self.observed = [*self.observed, *((str(p.id), p.batchId, p.timestamp, name, k, int(v or 0)) for k, v in row.asDict().items())][-16 * self.keep :]
        self._tell("ok", p.timestamp)

    def onQueryIdle(self, event) -> None:
        self._tell("ok", event.timestamp)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._tell("warning", (self.last or {}).get("last_heartbeat_utc") or "", RuntimeError(event.exception))


def run_metrics(spark: SparkSession, listener: HealthListener) -> DataFrame:
    """Per query and hour of the reports: rows, mean microseconds a row, mean milliseconds a batch, the most state rows."""
    df = spark.createDataFrame(listener.reports, METRICS)
    per_row = F.round(1000 * F.sum("ingest_ms") / F.greatest(F.sum("rows"), F.lit(1)), 1)
    return df.groupBy("query", F.substring("at", 1, 13).alias("hour")).agg(F.sum("rows").alias("items"), per_row.alias("avg_ingest_us"), F.round(F.avg("batch_ms"), 1).alias("avg_batch_ms"), F.max("state_rows").alias("state_rows"))


def observed_counts(spark: SparkSession, listener: HealthListener) -> DataFrame:
    """Per query and observation (cleaning.observed): each metric summed over the micro-batches reported so far, a batch that was reported twice once."""
    df = spark.createDataFrame(listener.observed, "query string, batch long, at string, name string, metric string, n long")
    return df.groupBy("query", "name", "batch", "metric").agg(F.max_by("n", "at").alias("n")).groupBy("query", "name", "metric").agg(F.sum("n").alias("n"))


def banner(last: dict, now: float, stale: float = 900.0) -> str:
    """ok, warning, or stale where the last heartbeat (ISO, UTC) is older than `stale` seconds."""
    from datetime import datetime

    beat = datetime.fromisoformat(last["last_heartbeat_utc"].replace("Z", "+00:00")).timestamp()
    return "stale" if now - beat > stale else last["status"]
