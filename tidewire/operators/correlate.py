"""Investigation timelines: flows, events, alerts, notes and gaps around an anchor, in one order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import ACTION, EVENT_TYPE, label
from tidewire.operators.filters import EVENTS, RecordFilter, compile_filter, overlaps

MAIN_LIMIT, EXTRA_LIMIT = 2000, 1000
SECOND = 1_000_000


@dataclass(frozen=True)
class Anchor:
    """What is investigated: a client, addresses, a record or alert, or just a range."""

    start: int
    end: int
    at: int | None = None
    client_id: int | None = None
    addresses: tuple[str, ...] = ()
    flow_ids: tuple[int, ...] = ()
    event_ids: tuple[int, ...] = ()
    alert_key: str | None = None


def scope(anchor: Anchor) -> RecordFilter:
    """By client where one is known, else by the only address, else by the range alone."""
    base = RecordFilter(start=anchor.start, end=anchor.end)
    if anchor.client_id is not None:
        return replace(base, client_id=anchor.client_id)
    return replace(base, any_ip=anchor.addresses[0]) if len(anchor.addresses) == 1 else base


def relations(anchor: Anchor, time: Column, clients: list[Column], addresses: list[Column]) -> Column:
    """Plain facts that tie an entry to the anchor; never a cause."""
    parts = []
    if anchor.client_id is not None:
        same = F.lit(False)
        for c in clients:
            same = same | (c == anchor.client_id)
        parts.append(F.when(same, F.lit("same client")))
    if anchor.addresses:
        wanted = F.array(*[F.lit(a) for a in sorted(anchor.addresses)])
        shared = F.array_intersect(wanted, F.array(*addresses)) if addresses else F.array().cast("array<string>")
        parts.append(F.when(F.size(shared) > 0, F.concat(F.lit("same address: "), F.array_join(F.array_sort(shared), ", "))))
    if anchor.at is not None:
        gap = F.abs(time - anchor.at)
        parts.append(F.when(gap <= 5 * SECOND, F.concat(F.lit("within "), F.ceil(gap / SECOND).cast("string"), F.lit(" s of anchor"))).when(gap <= 60 * SECOND, F.lit("within a minute of anchor")))
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")


_COLUMNS = ("time", "kind", "id", "title", "relations", "is_anchor")


def timeline(anchor: Anchor, flows: DataFrame, events: DataFrame, alerts: DataFrame | None = None, notes: DataFrame | None = None, gaps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, truncated): the entries in order of time, and whether flows or events had more than their limit."""
    f = scope(anchor)
    main = flows.where(compile_filter(f))
    kept = main.orderBy("start_time", "flow_id").limit(MAIN_LIMIT)
    picked = kept
    for address in sorted(anchor.addresses)[1:]:
        extra = flows.where(compile_filter(RecordFilter(start=anchor.start, end=anchor.end, any_ip=address))).orderBy("start_time", "flow_id").limit(EXTRA_LIMIT)
        picked = picked.unionByName(extra)
    if len(anchor.addresses) > 1:
        picked = picked.dropDuplicates(["flow_id"])
    listed = lambda ids, c: c.isin(list(ids)) if ids else F.lit(False)
    parts = [
        picked.select(
            F.col("start_time").alias("time"), F.lit("flow").alias("kind"), F.col("flow_id").cast("string").alias("id"),
            F.concat_ws(" ", F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port").cast("string")), F.lit("to"), F.concat(F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"))).alias("title"),
            relations(anchor, F.col("start_time"), [F.col("src_client_id"), F.col("dst_client_id")], [F.col("src_ip"), F.col("dst_ip")]).alias("relations"), listed(anchor.flow_ids, F.col("flow_id")).alias("is_anchor"),
        )
    ]
    ef = replace(f, client_id=None) if "dst_client_id" not in events.columns else f
    rows = events.where(compile_filter(ef, EVENTS, numeric=False))
    if "dst_client_id" not in events.columns and f.client_id is not None:
        rows = rows.where(F.col("src_client_id") == f.client_id)
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    title = F.concat_ws(" · ", label(F.col("action"), ACTION), F.coalesce(has("rule_name"), has("ids_signature")), has("username"))
    clients = [F.col(c) for c in ("src_client_id", "dst_client_id") if c in events.columns]
    parts.append(
        rows.orderBy("received_at", "event_id").limit(MAIN_LIMIT).select(
            F.coalesce("event_time", "received_at").alias("time"), label(F.col("event_type"), EVENT_TYPE, "other").alias("kind"), F.col("event_id").cast("string").alias("id"),
            F.when(title != "", title).otherwise(label(F.col("event_type"), EVENT_TYPE, "other")).alias("title"),
            relations(anchor, F.coalesce("event_time", "received_at"), clients, [F.col("src_ip"), F.col("dst_ip")]).alias("relations"), listed(anchor.event_ids, F.col("event_id")).alias("is_anchor"),
        )
    )
    if alerts is not None:
        hit = (F.col("last_occurrence") >= anchor.start) & (F.col("first_occurrence") <= anchor.end)
        if anchor.client_id is not None or anchor.addresses or anchor.alert_key:
            tied = F.lit(False)
            if anchor.client_id is not None:
                tied = tied | (F.col("client_id") == anchor.client_id)
            if anchor.addresses:
                tied = tied | F.contains(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.col("dedupe_key")), F.lit(anchor.addresses[0]))
            if anchor.alert_key:
                tied = tied | (F.col("dedupe_key") == anchor.alert_key)
            hit = hit & tied
        parts.append(alerts.where(hit).select(F.col("first_occurrence").alias("time"), F.lit("alert").alias("kind"), F.col("dedupe_key").alias("id"), F.col("rule").alias("title"), relations(anchor, F.col("first_occurrence"), [F.col("client_id")], [F.col("subject")]).alias("relations"), (F.col("dedupe_key") == F.lit(anchor.alert_key or "")).alias("is_anchor")))
    if notes is not None:
        parts.append(notes.where(F.col("at").between(anchor.start, anchor.end)).select(F.col("at").alias("time"), F.lit("annotation").alias("kind"), F.col("note_id").cast("string").alias("id"), F.col("text").alias("title"), F.array().cast("array<string>").alias("relations"), F.lit(False).alias("is_anchor")))
    if gaps is not None:
        parts.append(gaps.where(overlaps(F.col("start_ts"), F.col("end_ts"), anchor.start, anchor.end)).select(F.col("start_ts").alias("time"), F.lit("gap").alias("kind"), F.col("gap_id").cast("string").alias("id"), F.col("reason").alias("title"), F.array().cast("array<string>").alias("relations"), F.lit(False).alias("is_anchor")))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    over = main.limit(MAIN_LIMIT + 1).agg((F.count(F.lit(1)) > MAIN_LIMIT).alias("a")).join(rows.limit(MAIN_LIMIT + 1).agg((F.count(F.lit(1)) > MAIN_LIMIT).alias("b")), F.lit(True))
    return entries.select(*_COLUMNS).orderBy("time", "kind", "id"), over.select((F.col("a") | F.col("b")).alias("truncated"))
