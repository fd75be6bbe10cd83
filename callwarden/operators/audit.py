"""Audit records and what is counted over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callwarden import constants as C
from callwarden.functions.base import is_true
from callwarden.operators.arguments import redact_arguments
from callwarden.sources.schemas import AUDIT_COLUMNS


def error_type() -> Column:
    """The exception's name, else `tool_error` for a failed result of a call that was let through."""
    blocked = F.col("decision").isin("deny", "require_approval")
    name = F.regexp_extract("error", r"^([^:]+):", 1)
    return F.when(F.col("error").isNotNull(), F.when(name == "", F.col("error")).otherwise(name)).when(
        is_true(F.col("is_error")) & ~is_true(blocked), F.lit(C.TOOL_ERROR)
    )


def metric_tool() -> Column:
    """Unresolved names come from callers; they share one label."""
    return F.when(F.col("server").isNull(), F.lit(C.OTHER_TOOL)).otherwise(F.col("tool"))


def _calls(audit: DataFrame) -> DataFrame:
    return audit.where("event = 'tool_call'").withColumns({"metric_tool": metric_tool(), "error_type": error_type()})


def _window(size: str | None) -> list:
    return [F.window("ts", size).alias("window")] if size else []


def call_counts(audit: DataFrame, window: str | None = None) -> DataFrame:
    return _calls(audit).groupBy(*_window(window), "metric_tool", "server", "decision", "error_type").agg(
        F.count(F.lit(1)).alias("calls")
    )


def denial_counts(audit: DataFrame, window: str | None = None) -> DataFrame:
    blocked = F.col("decision").isin("deny", "require_approval")
    return (
        _calls(audit).where(blocked)
        .groupBy(*_window(window), "metric_tool", "server", "decision_source", "rule")
        .agg(F.count(F.lit(1)).alias("denials"))
    )


def approval_counts(audit: DataFrame, window: str | None = None) -> DataFrame:
    return (
        _calls(audit).where(F.col("approval").isNotNull())
        .groupBy(*_window(window), "metric_tool", "server", "rule", "approval")
        .agg(F.count(F.lit(1)).alias("approvals"))
    )


def duration_bucket(seconds: Column) -> Column:
    """Upper bound of the histogram bucket; `+Inf` past the last."""
    chosen = None
    for bound in C.DURATION_BOUNDS_S:
        test = seconds <= bound
        chosen = F.when(test, F.lit(f"{bound:g}")) if chosen is None else chosen.when(test, F.lit(f"{bound:g}"))
    return chosen.otherwise(F.lit("+Inf"))


def duration_histogram(audit: DataFrame, keys: Sequence[str] = ("metric_tool",), window: str | None = None) -> DataFrame:
    return (
        _calls(audit)
        .withColumn("le", duration_bucket(F.col("duration_ms") / 1000))
        .groupBy(*_window(window), *keys, "le")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"))
    )


def duration_percentiles(audit: DataFrame, keys: Sequence[str] = ("metric_tool",), points=(0.5, 0.95, 0.99)) -> DataFrame:
    return _calls(audit).groupBy(*keys).agg(
        F.percentile_approx("duration_ms", list(points)).alias("percentiles")
    )


def who_called_what(audit: DataFrame) -> DataFrame:
    return audit.where("event = 'tool_call'").groupBy("principal", "tool", "decision").agg(
        F.count(F.lit(1)).alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def servers_used(audit: DataFrame) -> DataFrame:
    """Servers connected per capture, with how they were launched."""
    return audit.where("event = 'upstream_connected'").select("ts", "server", "transport", "identity")


def would_block(audit: DataFrame) -> DataFrame:
    """What blocking on argument hits would have refused."""
    return audit.where(F.size("argument_hits") > 0).select(
        "ts", "tool", F.array_join("argument_hits", ",").alias("hits")
    )


def slow_or_failing(audit: DataFrame, slow_ms: float) -> DataFrame:
    return audit.where((F.col("duration_ms") >= slow_ms) | is_true(F.col("is_error"))).select(
        "ts", "tool", "duration_ms", "is_error", "error"
    )


def classifier_reliability(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("classifier").isNotNull()).groupBy("classifier").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if((F.size("scanner_hits") > 0) & (F.col("classifier") == "benign")).alias("disagreements"),
    )


def number_sessions(audit: DataFrame, start_event: str = "upstream_connected", chunk: str = "day", host: str = "host") -> DataFrame:
    """Add `session_no` per host: it goes up at every first connect after other events.

    Starts are counted per (host, chunk) first; each chunk then continues from the sum of the
    chunks before it, so a busy host is not ordered in one task.
    """
    pieces = audit.withColumn("_chunk", F.date_trunc(chunk, "ts"))
    inside = W.partitionBy(host, "_chunk").orderBy("ts", "seq")
    is_start = F.col("event") == start_event
    edges = (
        pieces.groupBy(host, "_chunk")
        .agg(F.max_by("event", F.struct("ts", "seq")).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(W.partitionBy(host).orderBy("_chunk")))
        .select(host, "_chunk", "_carry")
    )
    marked = (
        pieces.join(edges, [host, "_chunk"])
        .withColumn("_prev", F.coalesce(F.lag("event").over(inside), "_carry"))
        .withColumn("_new", (is_start & (F.col("_prev").isNull() | (F.col("_prev") != start_event))).cast("int"))
    )
    before = (
        marked.groupBy(host, "_chunk").agg(F.sum("_new").alias("_n"))
        .withColumn(
            "_base",
            F.coalesce(
                F.sum("_n").over(W.partitionBy(host).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select(host, "_chunk", "_base")
    )
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.withColumn("_run", F.sum("_new").over(upto))
        .join(before, [host, "_chunk"])
        .withColumn("session_no", F.col("_base") + F.col("_run"))
        .drop("_chunk", "_carry", "_prev", "_new", "_run", "_base")
    )


def to_audit(decided: DataFrame) -> DataFrame:
    """One audit record per call, refused ones included, in the column order of the log.

    Arguments are logged masked; calls that were not masked before are masked here.
    """
    if "arguments_redacted" not in decided.columns:
        decided = redact_arguments(decided)
    d = F.col("decision")
    have = set(decided.columns)
    opt = lambda c, t="string": F.col(c) if c in have else F.lit(None).cast(t)
    hits = lambda c: F.when(F.size(opt(c, "array<string>")) > 0, opt(c, "array<string>"))
    detectors = (
        F.when(F.size("argument_hits") > 0, F.col("argument_hits.detector"))
        if "argument_hits" in have
        else F.lit(None).cast("array<string>")
    )
    values = {
        "ts": F.col("ts"),
        "event": F.lit("tool_call"),
        "tool": F.col("tool"),
        "server": opt("server"),
        "downstream_tool": opt("downstream_tool"),
        "principal": opt("principal"),
        "arguments": opt("arguments_redacted"),
        "decision": d["verdict"],
        "decision_source": d["source"],
        "rule": d["rule"],
        "decision_reason": d["reason"],
        "approval": d["approval_result"],
        "approval_channel": F.when(
            d["approval_result"].isNotNull(), F.coalesce(d["approval"]["mode"], F.lit("in_band"))
        ),
        "scanner_hits": hits("hits"),
        "scanner_action": opt("effect"),
        "scanner_structured_content_withheld": opt("structured_withheld", "boolean"),
        "classifier": opt("classifier"),
        "classifier_truncated": opt("classifier_truncated", "boolean"),
        "classifier_error": opt("classifier_error"),
        "result_secrets": hits("result_secrets"),
        "result_secrets_action": opt("result_secrets_action"),
        "argument_secrets": hits("argument_secrets"),
        "argument_secrets_action": opt("argument_secrets_action"),
        "argument_hits": detectors,
        "argument_hits_action": opt("argument_hits_action"),
        "duration_ms": F.coalesce(opt("duration_ms", "double"), F.lit(0.0)),
        "is_error": F.coalesce(opt("is_error", "boolean"), F.lit(False)) | (d["verdict"] != "allow"),
        "error": opt("error"),
    }
    return decided.select(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in AUDIT_COLUMNS.items()]
    )
