"""Traces as tables: events of a request in order, spans, fallbacks, errors and the manifest that closes them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import safe_name

VERSION = "1.0"


@dataclass(frozen=True)
class Settings:
    """Whether and how much is traced; from settings such as those of an environment."""

    enabled: bool = False
    level: str = "full"
    folder: str = ""

    @staticmethod
    def of(env: dict[str, str], folder: str = "") -> "Settings":
        on = str(env.get("TRACE_ENABLED", "")).strip().lower() in ("1", "true", "yes", "on")
        return Settings(on, str(env.get("TRACE_LEVEL", "full")).strip().lower() or "full", env.get("TRACE_DIR", folder) or folder)


def event(component: Column, stage: Column, kind: Column, status: Column | None = None, payload: Column | None = None, span: Column | None = None, parent: Column | None = None, elapsed: Column | None = None, sensitivity: str = "internal") -> Column:
    """One event of a trace, without its place and time."""
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(
        component.alias("component"), stage.alias("stage"), kind.alias("event_type"), (status if status is not None else F.lit("success")).alias("status"), text(span).alias("span_id"), text(parent).alias("parent_span_id"),
        (elapsed if elapsed is not None else F.lit(None)).cast("double").alias("elapsed_ms"), F.coalesce(text(payload), F.lit("{}")).alias("payload"), F.lit(sensitivity).alias("sensitivity"),
    )


def fallback(component: Column, stage: Column, wanted: Column, used: Column, reason: Column) -> Column:
    """The event of a strategy that gave way to another."""
    body = F.to_json(F.struct(wanted.alias("requested_strategy"), used.alias("effective_strategy"), reason.alias("reason_code")))
    return event(component, stage, F.lit("fallback"), F.lit("degraded"), body)


def events(rows: DataFrame, request: str, order: str, at: str, settings: Settings = Settings(True)) -> DataFrame:
    """Trace events (schema_version, request_id, seq, timestamp, event fields) of rows with an ``event`` column, numbered by
    ``order`` within their request. A trace that is off has none."""
    own = Window.partitionBy(request).orderBy(order)
    out = rows.select(F.lit(VERSION).alias("schema_version"), F.col(request).alias("request_id"), F.row_number().over(own).alias("seq"), F.col(at).alias("timestamp"), "event.*")
    return out if settings.enabled else out.filter("false")


def spans(rows: DataFrame) -> DataFrame:
    """(request_id, span_id, parent_span_id, component, stage, started, ended, status) of paired start and end events; an error ends a span as failed."""
    own = rows.filter("span_id is not null")
    last = F.max(F.when(F.col("event_type").isin("end", "error"), F.struct("seq", "timestamp", "event_type")))
    out = own.groupBy("request_id", "span_id").agg(F.min(F.when(F.col("event_type") == "start", F.struct("seq", "timestamp", "component", "stage", "parent_span_id"))).alias("s"), last.alias("e"))
    return out.select("request_id", "span_id", "s.parent_span_id", "s.component", "s.stage", F.col("s.timestamp").alias("started"), F.col("e.timestamp").alias("ended"), F.when(F.col("e.event_type") == "error", "failed").when(F.col("e.event_type") == "end", "success").otherwise("open").alias("status"))


def manifest(rows: DataFrame, settings: Settings = Settings(True)) -> DataFrame:
    """A row for each request: first and last time, events, fallbacks, errors, status, and the folder its files go to."""
    failed = F.count(F.when(F.col("event_type") == "error", 1))
    out = rows.groupBy("request_id").agg(F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").alias("event_count"), F.count(F.when(F.col("event_type") == "fallback", 1)).alias("fallbacks"), failed.alias("errors"))
    folder = safe_name(F.col("request_id").cast("string"), 120, "trace", dots=True)
    return out.select(F.lit(VERSION).alias("schema_version"), "*", F.when(F.col("errors") > 0, "failed").otherwise("success").alias("status"), F.lit(settings.level).alias("trace_level"), folder.alias("folder"))


def write(rows: DataFrame, path: str, settings: Settings) -> None:
    """Appends events as JSON lines; nothing where the trace is off."""
    if settings.enabled:
        rows.write.mode("append").json(path)
