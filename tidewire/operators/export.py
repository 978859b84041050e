"""Redaction and flattening of records, and CSV, JSON and Markdown output."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import ACTION, DIRECTION, EVENT_TYPE, PROTOCOL, SEVERITY, label
from tidewire.functions.netaddr import V4_PATTERN

PRODUCT = "tidewire"


@dataclass(frozen=True)
class Redaction:
    """What is hidden. Tokens of one salt are the same for the same address, so that records stay comparable."""

    internal_addresses: bool = False
    external_addresses: bool = False
    macs: bool = False
    hostnames: bool = False
    usernames: bool = False
    raw: bool = False
    free_text: bool = False
    notes: bool = False
    salt: str = ""

    def summary(self) -> str:
        hidden = [n.replace("_", " ") for n, v in vars(self).items() if v is True]
        return "redacted: " + ", ".join(hidden) if hidden else "none"


NONE = Redaction()


def sharing(salt: str) -> Redaction:
    return Redaction(True, False, True, True, True, True, True, True, salt)


def token(value: Column, salt: str) -> Column:
    """ip- and twelve hex digits of the salted digest."""
    return F.concat(F.lit("ip-"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit("|"), value), 256), 1, 12))


def redact_address(value: Column, internal: Column, policy: Redaction) -> Column:
    hide = (F.coalesce(internal, F.lit(False)) & F.lit(policy.internal_addresses)) | (~F.coalesce(internal, F.lit(False)) & F.lit(policy.external_addresses))
    return F.when(value.isNull(), F.lit("")).when(hide, token(value, policy.salt)).otherwise(value)


def placeholder(value: Column, hide: bool, text: str) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.lit(text) if hide else value)


def redact_text(value: Column, policy: Redaction) -> Column:
    """Addresses within free text become tokens: runs of hex digits, dots and colons are cut out, without the signs that
    end a sentence, and those that are IPv4 addresses, or hold two colons and look like IPv6, are replaced. JVM
    expressions only."""
    if not policy.free_text:
        return value
    marked = F.regexp_replace(value, r"((?:::)?[0-9A-Fa-f](?:[0-9A-Fa-f.:]*[0-9A-Fa-f])?(?:::)?)", "\u0001$1\u0001")
    v6 = r"^(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$"
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.rlike(V4_PATTERN) | p.rlike(v6), token(p, policy.salt)).otherwise(p))
    return F.array_join(parts, "")


def iso(micros: Column) -> Column:
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def flatten_flows(flows: DataFrame, policy: Redaction = NONE) -> DataFrame:
    inside = lambda end: F.coalesce(_opt(flows, f"{end}_internal", "boolean"), F.col(f"{end}_v4").between(167772160, 184549375) | F.col(f"{end}_v4").between(3232235520, 3232301055))
    return flows.select(
        F.col("flow_id").alias("id"), iso(F.col("start_time")).alias("start"), iso(F.col("end_time")).alias("end"), redact_address(F.col("src_ip"), inside("src"), policy).alias("source"), redact_address(F.col("dst_ip"), inside("dst"), policy).alias("destination"),
        F.col("src_port").alias("sourcePort"), F.col("dst_port").alias("destinationPort"), F.coalesce(label(F.col("protocol"), PROTOCOL), F.col("protocol").cast("string")).alias("protocol"), label(F.col("direction"), DIRECTION, "unknown").alias("direction"),
        "packets", F.col("octets").alias("bytes"), F.coalesce("service", F.lit("")).alias("service"), F.coalesce("dst_country", F.lit("")).alias("country"), F.col("dst_asn").alias("asn"), F.col("src_vlan").alias("sourceVlan"), F.col("dst_vlan").alias("destinationVlan"),
        F.col("src_client_id").alias("sourceClient"), F.col("dst_client_id").alias("destinationClient"), F.col("exporter_addr").alias("exporter"), (F.col("sampling_interval") > 1).alias("sampled"),
    )


def flatten_events(events: DataFrame, policy: Redaction = NONE) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), iso(F.col("received_at")).alias("received"), F.coalesce(iso(F.col("event_time")), F.lit("")).alias("time"), label(F.col("event_type"), EVENT_TYPE, "other").alias("type"), label(F.col("action"), ACTION, "").alias("action"),
        label(F.col("severity"), SEVERITY, "").alias("severity"), redact_address(F.col("src_ip"), F.lit(True), policy).alias("source"), redact_address(F.col("dst_ip"), F.lit(True), policy).alias("destination"), F.col("dst_port").alias("destinationPort"),
        placeholder(F.col("hostname"), policy.hostnames, "[host]").alias("hostname"), placeholder(_opt(events, "username"), policy.usernames, "[user]").alias("username"), F.coalesce("rule_name", F.lit("")).alias("rule"),
        F.coalesce("ids_signature", F.lit("")).alias("signature"), redact_text(F.coalesce("message", F.lit("")), policy).alias("message"), (F.lit("") if policy.raw else F.coalesce(_opt(events, "raw"), F.lit(""))).alias("raw"),
    )


def flatten_alerts(alerts: DataFrame, policy: Redaction = NONE) -> DataFrame:
    return alerts.select(
        F.col("dedupe_key").alias("id"), "rule", "state", "severity", iso(F.col("first_occurrence")).alias("first"), iso(F.col("last_occurrence")).alias("last"), "occurrences", F.col("client_id").alias("client"),
        redact_text(F.coalesce("subject", F.lit("")), policy).alias("subject"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("evidence")))).alias("evidence"), F.size("flow_ids").alias("flows"), F.size("event_ids").alias("events"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed, quoted where needed, quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_line(df: DataFrame) -> DataFrame:
    """One CSV line for each row, as a column: values with a comma, quote or line break are quoted."""
    cells = []
    for c in df.columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        cells.append(F.when(v.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))).otherwise(v))
    return df.select(F.concat_ws(",", *cells).alias("line"))


def json_envelope(df: DataFrame, kind: str, generated_at: str, policy: Redaction = NONE, limit: int = 10_000) -> str:
    """A document around at most ``limit`` records, keys sorted. An export is a page, not a table."""
    records = [json.loads(r["j"]) for r in df.limit(limit).select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).collect()]
    body = {"format": 1, "product": PRODUCT, "generatedAt": generated_at, "kind": kind, "redaction": policy.summary(), "count": len(records), "records": records}
    return json.dumps(body, indent=2, sort_keys=True)


def incident_markdown(alert: dict, entries: list[dict], policy: Redaction = NONE) -> str:
    """A report of one alert and its timeline, from collected rows."""
    lines = [f"# {alert['rule']}", "", f"- State: {alert['state']}", f"- Severity: {alert['severity']}", f"- Occurrences: {alert['occurrences']}", f"- Redaction: {policy.summary()}", "", "## Evidence", ""]
    lines += [f"- {k}: {v}" for k, v in sorted((alert.get("evidence") or {}).items())]
    lines += ["", "## Timeline", "", "| Time | Kind | What |", "|---|---|---|"]
    lines += [f"| {e['time']} | {e['kind']} | {str(e['title']).replace('|', '/')} |" for e in entries]
    return "\n".join(lines) + "\n"
