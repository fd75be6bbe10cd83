"""Streaming budgets, approvals and metrics.

Stateless operators need no streaming form: policies, gates, text and argument scans are
projections and joins with static tables, and run on a streaming frame as they are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callwarden.constants import DEFAULT_APPROVAL_TIMEOUT_S
from callwarden.operators import audit, joins
from callwarden.operators.budgets import Limits, with_day

LONG_MAX = 2**63 - 1

BUDGET_OUTPUT = (
    "ts timestamp, call_id string, cost bigint, scope string, exceeded string, used bigint, cap bigint, "
    "requested bigint"
)
BUDGET_STATE = "calls bigint, spent bigint"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


#: A judged call as the state's step hands it on, with its time in microseconds.
JUDGED = Row("at", "call_id", "cost", "scope", "exceeded", "used", "cap", "requested")


class Charge(StatefulProcessor):
    """Counters of one scope, charged a trigger at a time; ended by a timer in event time.

    `day` is the place of the UTC day among the keys, if it is one of them: its scope ends with the day.  `idle_ms`
    ends other scopes so long after their last call.  Scopes are many and their calls in a trigger few, so rows are
    taken as they are: a data frame for each scope takes several times as long.
    """

    def __init__(self, limits: Limits, day: int | None, idle_ms: int | None):
        self.limits, self.day, self.idle_ms = limits, day, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", BUDGET_STATE)

    def _end(self, key: tuple, last_ms: int | None) -> int | None:
        """When the scope ends, in milliseconds; None for never."""
        if self.day is not None:
            return ((key[self.day] - dt.date(1970, 1, 1)).days + 1) * DAY_MS
        return None if self.idle_ms is None else last_ms + self.idle_ms

    def _set_end(self, end: int | None) -> None:
        if end is not None:
            for timer in list(self.handle.listTimers()):
                if timer != end:
                    self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.spent.update((initialState["calls"], initialState["cost"]))
        self._set_end(self._end(key, initialState["last_ms"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # One trigger's rows of one scope; `maxFilesPerTrigger` and the like bound them.  Nulls come last.
        calls_in = [(r["at"] is None, r["at"], r["call_id"] is None, r["call_id"], r["cost"]) for r in rows]
        calls_in.sort(key=lambda c: (c[0], c[1] or 0, c[2], c[3] or ""))
        scope = "/".join(str(k) for k in key)
        end = self._end(key, max((c[1] // 1000 for c in calls_in if c[1] is not None), default=None))
        if self.day is not None and timerValues.getCurrentWatermarkInMs() >= end:
            # The day is closed and its counters are gone: nothing can be metered against it.
            return iter([JUDGED(at, i, cost, scope, "unavailable", None, None, None) for _, at, _, i, cost in calls_in])
        calls, spent = self.spent.get() or (0, 0)
        max_calls, max_cost = self.limits.max_calls, self.limits.max_cost
        judged = []
        for _, at, _, call_id, cost in calls_in:
            if max_calls is not None and calls >= max_calls:
                verdict = ("max_calls", calls, max_calls, 1)
            elif max_cost is not None and cost > max_cost - spent:
                verdict = ("max_cost", spent, max_cost, cost)
            else:
                verdict = (None, None, None, None)
                calls, spent = calls + 1, min(LONG_MAX, spent + cost)
            judged.append(JUDGED(at, call_id, cost, scope, *verdict))
        self.spent.update((calls, spent))
        self._set_end(end)
        return iter(judged)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.spent.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_budget(
    calls: DataFrame, limits: Limits, initial: DataFrame | None = None, delay: str = "1 minute", idle_s: int | None = None
) -> DataFrame:
    """Charge chargeable calls of a stream; `exceeded` is NULL for calls that fit.

    State is one counter pair per scope and survives restarts through the query's checkpoint.  `initial` gives
    counters to start with: the scope's keys, `calls` and `cost`, as `budgets.spend` returns them, and `ts`, the
    time of the last call (needed for `idle_s` only).  It counts in the first run of a checkpoint.

    A daily scope holds the UTC day among its keys, so the reset needs no clock.  Its counters are removed once
    the watermark, `delay` behind the latest call, has passed the day's end; later calls of that day are refused as
    `daily.unavailable` (`exceeded` is "unavailable").  Other scopes are kept for ever, or until `idle_s` seconds after
    their last call where the caller knows that they have ended by then.  Within a trigger calls are charged in
    (ts, call_id) order; across triggers in order of arrival.  `calls` has no watermark yet.  Sets the session's state
    store to RocksDB, which timers and initial state need.
    """
    spark = calls.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = calls.withWatermark("ts", delay)
    ready = with_day(timed) if "day" in limits.keys and "day" not in calls.columns else timed
    # A copy of the time: rows behind the watermark are judged here, and not dropped unseen.
    narrow = ready.where("chargeable").select(
        *[F.col(k) for k in limits.keys], F.unix_micros("ts").alias("at"), F.col("call_id").cast("string").alias("call_id"),
        F.greatest(F.col("cost"), F.lit(0)).cast("bigint").alias("cost"),
    )
    if initial is not None:
        last = F.unix_millis("ts") if "ts" in initial.columns else F.lit(0).cast("bigint")
        initial = initial.select(*[F.col(k) for k in limits.keys], "calls", "cost", last.alias("last_ms")).groupBy(*limits.keys)
    process = Charge(limits, limits.keys.index("day") if "day" in limits.keys else None, None if idle_s is None else idle_s * 1000)
    judged = narrow.groupBy(*limits.keys).transformWithState(process, BUDGET_OUTPUT.replace("ts timestamp", "at bigint"), "append", "eventTime", initial)
    return judged.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def stream_approvals(
    decided: DataFrame, answers: DataFrame, delay: str = "1 minute", longest_s: int = DEFAULT_APPROVAL_TIMEOUT_S
) -> DataFrame:
    """Settle calls that need approval by the answers that arrive within their rule's time limit.

    A left outer interval join of two streams: the watermark releases unanswered requests as
    timed out.  `longest_s` is the largest limit of any rule and bounds the state; each request is
    held to its own limit.  Of several answers to a request the first to arrive counts, so that there
    is one output row per request.
    """
    left = decided.where("decision.verdict = 'require_approval'").withWatermark("ts", delay).alias("c")
    right = (
        answers.select(
            F.col("request_id").cast("string").alias("request_id"), F.col("ts").alias("answered"), F.col("outcome").alias("answer")
        )
        .withWatermark("answered", delay)
        .dropDuplicatesWithinWatermark(["request_id"])
        .alias("a")
    )
    within = F.expr(
        f"CAST(c.call_id AS STRING) = a.request_id AND a.answered >= c.ts "
        f"AND a.answered <= c.ts + INTERVAL {int(longest_s)} SECONDS "
        f"AND unix_micros(a.answered) <= unix_micros(c.ts) + 1000000L * "
        f"coalesce(c.decision.approval.timeout_s, {DEFAULT_APPROVAL_TIMEOUT_S})"
    )
    return joins.settle(left.join(right, within, "leftOuter")).drop("request_id", "answered", "answer")


def stream_metrics(records: DataFrame, window: str = "1 minute", delay: str = "2 minutes") -> dict[str, DataFrame]:
    """Live call, denial, approval and duration counts under tumbling windows."""
    timed = records.withWatermark("ts", delay)
    return {
        "calls": audit.call_counts(timed, window),
        "denials": audit.denial_counts(timed, window),
        "approvals": audit.approval_counts(timed, window),
        "durations": audit.duration_histogram(timed, window=window),
    }


#: Counts of the live log and the metric each holds.
METRICS = {"calls": audit.call_counts, "denials": audit.denial_counts, "approvals": audit.approval_counts, "durations": audit.duration_histogram}
SUMMED = ("calls", "denials", "approvals", "total_ms")


def stream_log(records: DataFrame, path: str, checkpoint: str, window: str = "1 minute", **trigger):
    """Write a stream of audit records as JSON lines by day, and its four metrics, in one query.

    Each trigger writes folders that bear its number, and a repeated one replaces them, so that nothing is lost or counted
    twice.  Metrics are written as counts of that trigger by window; `read_metrics` adds them up, so late records
    count in their own window and nothing waits for a watermark.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("dt", F.to_date("ts")).write.mode("overwrite").partitionBy("dt").json(f"{path}/log/trigger={number}")
        for name, counts in METRICS.items():
            counts(batch, window=window).write.mode("overwrite").parquet(f"{path}/{name}/trigger={number}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_metrics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of METRICS as `stream_log` wrote it so far: a row per window and keys."""
    parts = spark.read.parquet(f"{path}/{name}").drop("trigger")
    summed = [c for c in parts.columns if c in SUMMED]
    return parts.groupBy(*[c for c in parts.columns if c not in summed]).agg(*[F.sum(c).alias(c) for c in summed])
