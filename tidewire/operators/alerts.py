"""Findings to alerts: suppression, deduplication, workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.detect import local_hour

OPEN, ACKNOWLEDGED, RESOLVED = "open", "acknowledged", "resolved"
ALERT_LIMIT = 5000


def suppress(findings: DataFrame, suppressions: DataFrame, *, zone: str = "UTC") -> DataFrame:
    """Findings that no suppression (rule, client_id, subject, hour_from, hour_to, expires_at) covers.

    Null in a suppression matches anything; an hour window may wrap over midnight; an expired one does nothing.
    """
    s = suppressions.select(*[F.col(c).alias(f"s_{c}") for c in ("rule", "client_id", "subject", "hour_from", "hour_to", "expires_at")])
    hour = local_hour(F.col("at"), zone)
    inside = F.when(F.col("s_hour_from") <= F.col("s_hour_to"), (hour >= F.col("s_hour_from")) & (hour < F.col("s_hour_to"))).otherwise((hour >= F.col("s_hour_from")) | (hour < F.col("s_hour_to")))
    on = (
        (F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule")))
        & (F.col("s_client_id").isNull() | (F.col("s_client_id") == F.col("client_id")))
        & (F.col("s_subject").isNull() | (F.col("s_subject") == F.col("subject")))
        & (F.col("s_hour_from").isNull() | F.col("s_hour_to").isNull() | inside)
        & (F.col("s_expires_at").isNull() | (F.col("s_expires_at") > F.col("at")))
    )
    return findings.join(s, on, "left_anti")


def deduplicate(findings: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Alerts after recording findings: one row for each dedupe key that is open or acknowledged, counting occurrences;
    the newest finding's evidence and references replace the older. A resolved alert stays as it is, and the
    next finding of its key opens a new one."""
    newest = F.max(F.struct("at", "severity", "client_id", "subject", F.map_entries("evidence").alias("evidence"), "flow_ids", "event_ids"))
    new = findings.groupBy("dedupe_key").agg(F.first("rule").alias("rule"), F.count(F.lit(1)).alias("occurrences"), F.min("at").alias("first_occurrence"), F.max("at").alias("last_occurrence"), newest.alias("f"))
    new = new.select("dedupe_key", "rule", "occurrences", "first_occurrence", "last_occurrence", "f.severity", "f.client_id", "f.subject", F.map_from_entries("f.evidence").alias("evidence"), "f.flow_ids", "f.event_ids", F.lit(OPEN).alias("state"), F.lit(None).cast("bigint").alias("resolved_at"))
    if alerts is None:
        return new
    live = alerts.where(F.col("state").isin(OPEN, ACKNOWLEDGED)).alias("o")
    both = live.join(new.alias("n"), "dedupe_key", "full")
    newer = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    merged = both.select(
        "dedupe_key", F.coalesce("o.rule", "n.rule").alias("rule"), (F.coalesce("o.occurrences", F.lit(0)) + F.coalesce("n.occurrences", F.lit(0))).alias("occurrences"),
        F.least("o.first_occurrence", "n.first_occurrence").alias("first_occurrence"), F.greatest("o.last_occurrence", "n.last_occurrence").alias("last_occurrence"),
        *[newer(c) for c in ("severity", "client_id", "subject", "evidence", "flow_ids", "event_ids")], F.coalesce("o.state", "n.state").alias("state"), F.lit(None).cast("bigint").alias("resolved_at"),
    )
    return merged.unionByName(alerts.where(F.col("state") == RESOLVED))


def set_state(alerts: DataFrame, key: str, state: str, now: int) -> DataFrame:
    """A new state for the live alert of a key; resolving stamps the time, reopening clears it."""
    if state not in (OPEN, ACKNOWLEDGED, RESOLVED):
        raise ValueError(state)
    hit = F.col("dedupe_key") == key
    resolved = F.lit(now).cast("bigint") if state == RESOLVED else F.lit(None).cast("bigint")
    return alerts.withColumns({"resolved_at": F.when(hit, resolved).otherwise(F.col("resolved_at")), "state": F.when(hit, state).otherwise(F.col("state"))})


def list_alerts(alerts: DataFrame, *, states: list[str] = (), severities: list[int] = (), client_id: int | None = None, min_severity: int | None = None, limit: int = 200) -> DataFrame:
    rows = alerts
    if states:
        rows = rows.where(F.col("state").isin(list(states)))
    if severities:
        rows = rows.where(F.col("severity").isin(list(severities)))
    if client_id is not None:
        rows = rows.where(F.col("client_id") == client_id)
    if min_severity is not None:
        rows = rows.where(F.col("severity") >= min_severity)
    return rows.orderBy(F.desc("last_occurrence"), "dedupe_key").limit(max(1, min(limit, ALERT_LIMIT)))


def counts_by_state(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("state").count()


def with_notes(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts with their notes (dedupe_key, at, text), oldest first."""
    own = notes.groupBy("dedupe_key").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("notes"))
    return alerts.join(own, "dedupe_key", "left")
