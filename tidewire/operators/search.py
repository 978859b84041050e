"""Record search, top lists, time series, counts and totals."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.filters import EVENTS, FLOWS, RecordFilter, compile_filter, overlaps

MINUTE = 60_000_000
PAGE_LIMIT, TOP_LIMIT, COUNT_LIMIT, GAP_LIMIT = 10_000, 1000, 200, 1000

FLOW_SORTS = {
    "start_time": F.col, "end_time": F.col, "octets": F.col, "packets": F.col, "src_ip": F.col, "dst_ip": F.col, "dst_port": F.col, "protocol": F.col,
    "duration": lambda _: F.col("end_time") - F.col("start_time"),
}
EVENT_SORTS = {
    "received_at": F.col, "severity": F.col, "event_type": F.col, "src_ip": F.col, "dst_port": F.col,
    "event_time": lambda _: F.coalesce("event_time", "received_at"),
}
DIMENSIONS = ("src_ip", "dst_ip", "dst_port", "protocol", "dst_country", "dst_asn", "dst_org", "service", "direction", "src_client_id", "dst_client_id", "exporter_addr")
EVENT_GROUPS = ("event_type", "action", "severity", "rule_name", "hostname", "src_ip", "dst_ip", "dst_port", "ids_signature", "username", "app_name")
# Range presets in seconds and their bucket widths in seconds.
RANGES = {900: 60, 3600: 60, 21600: 300, 86400: 900, 604800: 3600, 2592000: 14400}


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: its sort value and id."""

    value: Any
    id: int


def _clamp(n: int, most: int) -> int:
    return max(1, min(n, most))


def page(df: DataFrame, f: RecordFilter, kind: str = FLOWS, *, sort: str | None = None, descending: bool = True, limit: int = 500, after: Cursor | None = None, numeric: bool = True) -> DataFrame:
    """A page in order of (sort, id). The next page is asked for by the last row's cursor, never by an offset."""
    sorts, id_col = (FLOW_SORTS, "flow_id") if kind == FLOWS else (EVENT_SORTS, "event_id")
    sort = sort or ("start_time" if kind == FLOWS else "received_at")
    if sort not in sorts:
        raise ValueError(f"cannot sort {kind} by {sort}")
    key: Column = sorts[sort](sort)
    rows = df.where(compile_filter(f, kind, numeric=numeric))
    if after is not None:
        beyond = key < F.lit(after.value) if descending else key > F.lit(after.value)
        tie = F.col(id_col) < after.id if descending else F.col(id_col) > after.id
        rows = rows.where(beyond | ((key == F.lit(after.value)) & tie))
    order = [key.desc_nulls_last(), F.col(id_col).desc()] if descending else [key.asc_nulls_last(), F.col(id_col).asc()]
    return rows.orderBy(*order).limit(_clamp(limit, PAGE_LIMIT))


def next_cursor(rows: list, limit: int, kind: str = FLOWS, sort: str | None = None) -> Cursor | None:
    """The cursor after a collected page, or None where the page was not full."""
    if len(rows) < limit or not rows:
        return None
    sort = sort or ("start_time" if kind == FLOWS else "received_at")
    last = rows[-1]
    value = last["end_time"] - last["start_time"] if sort == "duration" else (last["event_time"] if last["event_time"] is not None else last["received_at"]) if sort == "event_time" else last[sort]
    return Cursor(value, last["flow_id" if kind == FLOWS else "event_id"])


def top_n(flows: DataFrame, f: RecordFilter, dimension: str, limit: int = 20) -> DataFrame:
    """The heaviest values of a dimension by bytes. ``flows`` counts original flows, also after aggregation."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"no dimension {dimension}")
    rows = flows.where(compile_filter(f)).where(F.col(dimension).isNotNull())
    sums = rows.groupBy(F.col(dimension).cast("string").alias("k")).agg(F.sum("flow_count").alias("flows"), F.sum("octets").alias("bytes"), F.sum("packets").alias("packets"))
    return sums.orderBy(F.desc("bytes"), F.asc("k")).limit(_clamp(limit, TOP_LIMIT))


def bucket(time: Column, width: int) -> Column:
    """Start of the bucket; truncation towards zero, as for all stored buckets."""
    return time - time % F.lit(width)


def time_series(flows: DataFrame, f: RecordFilter, width: int) -> DataFrame:
    """Buckets that hold flows, in order; empty ones are not filled in."""
    one = lambda d: F.sum(F.when(F.col("direction") == d, F.col("octets")).otherwise(0))
    rows = flows.where(compile_filter(f)).groupBy(bucket(F.col("start_time"), width).alias("bucket"))
    return rows.agg(F.sum("flow_count").alias("flows"), F.sum("octets").alias("bytes"), F.sum("packets").alias("packets"), one(2).alias("inbound"), one(1).alias("outbound")).orderBy("bucket")


def time_series_rollup(minutes: DataFrame, f: RecordFilter, width: int) -> DataFrame:
    """The same from minute totals (client 0); the range begins at its first whole minute."""
    rows = minutes.where((F.col("client_id") == 0) & (F.col("origin") == f.origin))
    if f.start is not None:
        rows = rows.where(F.col("bucket") >= f.start - f.start % MINUTE)
    if f.end is not None:
        rows = rows.where(F.col("bucket") <= f.end)
    if f.directions:
        rows = rows.where(F.col("direction").isin(list(f.directions)))
    one = lambda d: F.sum(F.when(F.col("direction") == d, F.col("bytes")).otherwise(0))
    grouped = rows.groupBy(bucket(F.col("bucket"), width).alias("bucket"))
    return grouped.agg(F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), one(2).alias("inbound"), one(1).alias("outbound")).orderBy("bucket")


def series(flows: DataFrame, minutes: DataFrame | None, f: RecordFilter, width: int, *, exact: bool = False) -> DataFrame:
    """Rollups first: they answer unless a record-level clause, a bucket below a minute or ``exact`` forbids it."""
    if minutes is None or exact or f.record_level() or width < MINUTE:
        return time_series(flows, f, width)
    return time_series_rollup(minutes, f, width)


def event_counts(events: DataFrame, f: RecordFilter, by: str) -> DataFrame:
    if by not in EVENT_GROUPS:
        raise ValueError(f"cannot count events by {by}")
    key = F.coalesce(F.col(by).cast("string"), F.lit("")).alias("k")
    return events.where(compile_filter(f, EVENTS)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("k")).limit(COUNT_LIMIT)


def totals(minutes: DataFrame, f: RecordFilter) -> DataFrame:
    """One row of sums from minute totals, zeros where there is nothing."""
    rows = minutes.where((F.col("client_id") == 0) & (F.col("origin") == f.origin))
    if f.start is not None:
        rows = rows.where(F.col("bucket") >= f.start - f.start % MINUTE)
    if f.end is not None:
        rows = rows.where(F.col("bucket") <= f.end)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    one = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("bytes"))), F.lit(0))
    return rows.agg(zero("flows"), zero("bytes"), zero("packets"), one(2).alias("inbound"), one(1).alias("outbound"))


def gaps(table: DataFrame, lo: int, hi: int) -> DataFrame:
    """Collection gaps that overlap a range, newest first."""
    return table.where(overlaps(F.col("start_ts"), F.col("end_ts"), lo, hi)).orderBy(F.desc("start_ts"), F.desc("gap_id")).limit(GAP_LIMIT)


def newest(df: DataFrame, time: str, id_col: str, lo: int, hi: int, limit: int, *, ip: str | None = None, text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The hot query: newest rows of a range, and a one-row frame that tells whether there were more."""
    rows = df.where(F.col(time).between(lo, hi))
    if ip:
        rows = rows.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    if text:
        rows = rows.where(F.contains(F.lower(F.coalesce("message", F.lit(""))), F.lit(text.lower())))
    more = rows.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return rows.orderBy(F.desc(time), F.desc(id_col)).limit(limit), more


def bounded_hot_set(df: DataFrame, time: str, id_col: str, now: int, max_age: int, max_rows: int) -> DataFrame:
    """What a hot buffer of bounded age and size holds: too old rows go, then the oldest beyond the count."""
    return df.where(F.col(time) >= now - max_age).orderBy(F.desc(time), F.desc(id_col)).limit(max_rows)


def overview(flows: DataFrame, events: DataFrame, minutes: DataFrame, gap_table: DataFrame, lo: int, hi: int) -> dict[str, DataFrame]:
    """The parts of an overview; each is lazy, so a caller can submit them side by side."""
    f = RecordFilter(start=lo, end=hi)
    out = RecordFilter(start=lo, end=hi, directions=(1,))
    width = next((b for r, b in RANGES.items() if (hi - lo) <= r * 1_000_000), 14400) * 1_000_000
    return {
        "series": series(flows, minutes, f, width),
        "totals": totals(minutes, f),
        "sources": top_n(flows, out, "src_ip", 10),
        "destinations": top_n(flows, out, "dst_ip", 10),
        "ports": top_n(flows, out, "dst_port", 10),
        "countries": top_n(flows, out, "dst_country", 10),
        "asns": top_n(flows, out, "dst_asn", 10),
        "event_types": event_counts(events, f, "event_type"),
        "actions": event_counts(events, f, "action"),
        "signatures": event_counts(events, f, "ids_signature"),
        "gaps": gaps(gap_table, lo, hi),
    }


def clients_with_traffic(clients: DataFrame, flows: DataFrame, f: RecordFilter) -> DataFrame:
    """Clients (client_id, label, address) with their traffic by source address, quiet ones included."""
    sums = flows.where(compile_filter(f)).where(F.col("src_ip").isNotNull()).groupBy(F.col("src_ip").alias("address"))
    traffic = sums.agg(F.sum("flow_count").alias("flows"), F.sum("octets").alias("bytes"), F.sum("packets").alias("packets"))
    return clients.join(traffic, "address", "left").na.fill(0, ["flows", "bytes", "packets"])


def truncated_page(df: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    return df.limit(limit), df.limit(limit + 1).agg((F.count(F.lit(1)) > limit).alias("truncated"))
