"""Stateful operators: weeks, event coalescing, quotas, rate limits; batch and Structured Streaming forms."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"none": 0, "soft": 1, "hard": 2}


_RULE = re.compile(r"\s*([0-9]+)\s*(?:req(?:uest)?s?)?\s*(?:/|per)\s*(second|minute|hour|day)s?\s*", re.IGNORECASE)
_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def parse_rules(text: str | None) -> list[tuple[int, float]]:
    """(count, seconds) of each rule in a text such as "200 per hour, 50/minute"; parts that are no rules, and counts of 0, are left out."""
    found = [_RULE.fullmatch(part) for part in (text or "").split(",")]
    return [(int(m[1]), _SECONDS[m[2].lower()]) for m in found if m and int(m[1]) > 0]


def weekly(rows: DataFrame, ts: str = "first_seen") -> DataFrame:
    """Rows a week from Monday, half-open; works on batch and streaming frames."""
    w = F.window(ts, "7 days", "7 days", "4 days")
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("week"), "n")


def coalesce_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of events as generation, highest severity, reasons in the order of their first event.

    Reasons are reduced to their first times before they are gathered, so a hot key
    gathers as many rows as there are reasons, not events.
    """
    reasons = events.groupBy(*keys, "reason").agg(F.count("*").alias("n"), F.max("rank").alias("rank"), F.min(F.struct("ts", "event_id")).alias("first"))
    return reasons.groupBy(*keys).agg(F.sum("n").alias("generation"), F.max("rank").alias("rank"), F.transform(F.array_sort(F.collect_list(F.struct("first", "reason"))), lambda x: x["reason"]).alias("reasons"))


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` events of a user and day are allowed."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return events.withColumn("day", F.to_date("ts")).withColumn("allowed", F.row_number().over(w) <= limit)


def rate_limit(events: DataFrame, rules: list[tuple[int, float]]) -> DataFrame:
    """Sliding windows (count, seconds): an event passes if each rule has room; a refused one uses none.

    The state of a user is what was let through, which a window frame can't express.  Sorted
    partitions are read in batches and only the times within the longest window are kept, so
    a user with very many events needs no more memory than another.
    """
    span = max(s for _, s in rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, passed = None, deque()
        for frame in frames:
            allowed = []
            for u, t in zip(frame["user_id"], frame["ts"].astype("datetime64[ns]").astype("int64") / 1e9):
                if u != user:
                    user, passed = u, deque()
                while passed and t - passed[0] >= span:
                    passed.popleft()
                ok = all(sum(t - p < s for p in passed) < n for n, s in rules)
                if ok:
                    passed.append(t)
                allowed.append(ok)
            yield frame.assign(allowed=allowed)

    rows = events.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return rows.mapInPandas(run, "event_id long, user_id long, ts timestamp, allowed boolean")


def first_arrivals(rows: DataFrame, key: str = "sha256", order: str = "ts") -> DataFrame:
    """The first row of each content hash."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def stream_merge(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a merge for each micro-batch of a stream; replays of a batch come with its id."""
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")




def context_window(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of each conversation whose tokens add up to at most the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("used", F.sum("token_count").over(w)).filter(F.col("used") <= budget)


def rate_limit_stream(events: DataFrame, rules: list[tuple[int, float]]) -> DataFrame:
    """The sliding-window limiter over a stream; a user's state is the times let through within the longest window."""
    span = max(s for _, s in rules)

    def step(key, frames, state):
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9:
            passed = [p for p in passed if t - p < span]
            ok = all(sum(t - p < s for p in passed) < n for n, s in rules)
            if ok:
                passed.append(t)
            allowed.append(ok)
        state.update((passed,))
        yield rows.assign(allowed=allowed)[["event_id", "user_id", "ts", "allowed"]]

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, ts timestamp, allowed boolean", "passed array<double>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; a window closes once the watermark has passed it, later rows are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def first_in_stream(rows: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key, remembered for ``delay``: replays and copies within it are dropped."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
