"""Writers of archives, exports and alerts."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import utc


def write_archive(rows: DataFrame, path: str) -> None:
    """Anomalies or candidates as Parquet by day and channel; a day that is written again replaces itself.

    Rows are dealt by folder, so that a folder has few files; adaptive execution
    splits a folder that is too large for a task.
    """
    dated = rows.withColumn("date", utc(F.col("window_end"), "yyyy-MM-dd"))
    dated.hint("rebalance", "date", "channel").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "channel").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """Tracked events as JSON lines, replacing what is there."""
    events.write.mode("overwrite").json(path)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def export_csv(tables: dict[str, DataFrame], path: str) -> None:
    """Each report as CSV with a header; nulls are blank. Reports are aggregates, small enough for a file each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{path}/{name}", header=True, nullValue="", emptyValue="")


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    """Each table as Parquet in a folder of its name under path."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


#: What alerts say and look like.
ALERT_TITLE, ALERT_FOOTER, ALERT_COLOUR, ALERT_KEYWORDS = "Surge Detected — ", "Surge Detection Engine", 0xE53935, 8


def payload(style: str) -> Column:
    """An alert's JSON for a webhook (discord, slack or plain) from channel, window_end, count, z_score and keywords."""
    words = F.when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, ALERT_KEYWORDS), ", ")).otherwise("—")
    when = F.date_format(F.timestamp_seconds("window_end"), "MMM dd HH:mm 'UTC'")
    z, n = F.format_string("%.2f", F.col("z_score").cast("double")), F.col("count").cast("string")
    told = [("Channel", F.col("channel"), True), ("Time", when, True), ("Count", n, True), ("Z-Score", z, True), ("Keywords", words, False)]
    if style == "discord":
        fields = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value"), F.lit(s).alias("inline")) for k, v, s in told])
        embed = F.struct(F.concat(F.lit(ALERT_TITLE), "channel").alias("title"), F.lit(ALERT_COLOUR).alias("color"), fields.alias("fields"), F.struct(F.lit(ALERT_FOOTER).alias("text")).alias("footer"))
        return F.to_json(F.struct(F.array(embed).alias("embeds")))
    if style == "slack":
        fields = F.array(*[F.struct(F.lit(k).alias("title"), v.alias("value"), F.lit(s).alias("short")) for k, v, s in told])
        part = F.struct(F.lit(f"#{ALERT_COLOUR:06X}").alias("color"), fields.alias("fields"), F.lit(ALERT_FOOTER).alias("footer"))
        return F.to_json(F.struct(F.concat(F.lit(f"*{ALERT_TITLE}"), "channel", F.lit("*")).alias("text"), F.array(part).alias("attachments")))
    return F.to_json(F.struct(F.concat(F.lit("SURGE | "), "channel", F.lit(" | "), when, F.lit(" | count="), n, F.lit(" z="), z, F.lit(" | "), words).alias("text")))


def style_of(url: str) -> str:
    return "discord" if "discord.com" in url else "slack" if "hooks.slack.com" in url else "plain"


def post(url: str, body: str, timeout: float = 5.0) -> None:
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
    urllib.request.urlopen(request, timeout=timeout).close()


def send_alerts(events: DataFrame, url: str | None, send: Callable[[str, str], None] = post) -> int:
    """Post every start to a webhook, row by row as they come; without a url nothing is sent. Failures do not stop the batch. Returns how many went out."""
    if not url:
        return 0
    sent = 0
    for row in events.where("event_type = 'start'").select(payload(style_of(url)).alias("body")).toLocalIterator():
        try:
            send(url, row["body"])
            sent += 1
        except OSError:
            continue
    return sent


def health(status: str, now: str, component: str, before: dict | None = None, error: Exception | None = None) -> dict:
    """A health document; the last success outlives later failures."""
    good = status == "ok"
    return {
        "status": status, "component": component, "last_heartbeat_utc": now, "last_successful_fetch_utc": now if good else (before or {}).get("last_successful_fetch_utc"),
        "last_error_utc": None if good else now, "last_error_type": type(error).__name__ if error else None, "last_error_message": str(error) if error else None,
    }
