"""Minute, hour and day rollups, their merges, and the daily summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def _floor(time: str, width: int) -> Column:
    return F.col(time) - F.col(time) % F.lit(width)


def minute_rollup(flows: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Per (minute, origin, client, direction): flows, packets, bytes, denied, allowed. Client 0 is the total.

    One scan: grouping sets give the rows by client and the totals together; rows without a client are not
    clients and only count in the totals. Denied and allowed come from firewall events where these are given.
    """
    client = F.coalesce(F.when(F.col("direction") == 2, F.col("dst_client_id")).otherwise(F.col("src_client_id")), F.lit(0))
    rows = flows.select(_floor("start_time", MINUTE).alias("bucket"), "origin", client.alias("client"), "direction", "flow_count", "packets", "octets")
    sums = rows.groupingSets([["bucket", "origin", "direction", "client"], ["bucket", "origin", "direction"]], "bucket", "origin", "direction", "client").agg(
        F.sum("flow_count").alias("flows"), F.sum("packets").alias("packets"), F.sum("octets").alias("bytes"), F.grouping("client").alias("total")
    )
    kept = sums.where((F.col("total") == 1) | (F.col("client") != 0))
    out = kept.select("bucket", "origin", F.when(F.col("total") == 1, 0).otherwise(F.col("client")).alias("client_id"), "direction", "flows", "packets", "bytes")
    if events is None:
        return out.withColumns({"denied": F.lit(0).cast("bigint"), "allowed": F.lit(0).cast("bigint")})
    wall = events.where(F.col("event_type") == 1).groupBy(_floor("received_at", MINUTE).alias("bucket"), "origin").agg(
        F.count_if(F.col("action").isin(2, 3)).alias("denied"), F.count_if(F.col("action") == 1).alias("allowed")
    )
    extra = wall.select("bucket", "origin", F.lit(0).cast("bigint").alias("client_id"), F.lit(0).cast("smallint").alias("direction"), *[F.lit(0).cast("bigint").alias(c) for c in ("flows", "packets", "bytes")], "denied", "allowed")
    return out.withColumns({"denied": F.lit(0).cast("bigint"), "allowed": F.lit(0).cast("bigint")}).unionByName(extra)


def merge_minutes(*parts: DataFrame) -> DataFrame:
    """Additive merge: late rows just add up, nothing is ever dropped."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("bucket", "origin", "client_id", "direction").agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "bytes", "denied", "allowed")])


HOUR_KEYS = ("bucket", "origin", "client_id", "dst_ip", "dst_port", "protocol", "direction")


def hour_rollup(flows: DataFrame, seq: int = 0) -> DataFrame:
    """Per hour and destination, for traffic that crosses the border. ``seq`` orders parts in a merge."""
    rows = flows.where(F.col("direction").isin(1, 2)).select(
        _floor("start_time", HOUR).alias("bucket"), "origin", F.lit(0).cast("bigint").alias("client_id"), "dst_ip", "dst_port", "protocol", "direction", "dst_country", "dst_asn", "flow_count", "packets", "octets"
    )
    return rows.groupBy(*HOUR_KEYS, "dst_country", "dst_asn").agg(
        F.sum("flow_count").alias("flows"), F.sum("packets").alias("packets"), F.sum("octets").alias("bytes"), F.lit(0).cast("bigint").alias("denied"), F.lit(seq).alias("seq")
    )


def merge_hours(*parts: DataFrame) -> DataFrame:
    """Additive on the key; country and ASN are not part of it, the newest that is not null stays."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    return rows.groupBy(*HOUR_KEYS).agg(latest("dst_country"), latest("dst_asn"), *[F.sum(c).alias(c) for c in ("flows", "packets", "bytes", "denied")], F.max("seq").alias("seq"))


def day_rollup(hours: DataFrame) -> DataFrame:
    keys = [_floor("bucket", DAY).alias("day"), F.col("origin"), F.col("client_id"), F.col("dst_ip"), F.col("dst_port"), F.col("protocol"), F.col("direction"), F.coalesce("dst_country", F.lit("")).alias("dst_country"), F.coalesce("dst_asn", F.lit(0)).cast("bigint").alias("dst_asn")]
    return hours.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("flows", "packets", "bytes", "denied")])


def read_days(days: DataFrame, lo: int, hi: int) -> DataFrame:
    return days.where(F.col("day").between(lo, hi)).orderBy("day", "dst_ip", "dst_port", "protocol", "direction")


def top_of_day(days: DataFrame, dimension: str, by: str = "bytes", n: int = 20) -> DataFrame:
    """The n largest values of a dimension for each day and origin: (day, origin, rank, k, value)."""
    from pyspark.sql import Window

    rows = days.where(F.col(dimension).isNotNull() & (F.col(dimension).cast("string") != ""))
    sums = rows.groupBy("day", "origin", F.col(dimension).cast("string").alias("k")).agg(F.sum(by).alias("value"))
    rank = F.row_number().over(Window.partitionBy("day", "origin").orderBy(F.desc("value"), F.asc("k")))
    return sums.withColumn("rank", rank).where(F.col("rank") <= n).select("day", "origin", "rank", "k", "value")


def daily_summary(minutes: DataFrame, days: DataFrame, alerts: DataFrame | None = None, n: int = 20) -> DataFrame:
    """One JSON document for each day and origin, with sorted keys: totals by direction, top clients, destinations, ports, countries."""
    from tidewire.functions.labels import DIRECTION, label

    day = _floor("bucket", DAY).alias("day")
    by_direction = minutes.where("client_id = 0 and direction > 0").groupBy(day, "origin", "direction").agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"), F.sum("packets").alias("packets"))
    totals = by_direction.groupBy("day", "origin").agg(F.sort_array(F.collect_list(F.struct(label(F.col("direction"), DIRECTION).alias("direction"), "bytes", "flows", "packets"))).alias("totals"))
    clients = minutes.where("client_id <> 0 and direction = 1").select(day, "origin", F.col("client_id").cast("string").alias("client"), "bytes", "flows")
    denied = minutes.groupBy(day, "origin").agg(F.sum("denied").alias("denied"))

    def top(rows: DataFrame, dimension: str, by: str, name: str) -> DataFrame:
        ranked = top_of_day(rows, dimension, by, n)
        return ranked.groupBy("day", "origin").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "k", "value"))), lambda x: F.struct(x["k"].alias("key"), x["value"].alias("value"))).alias(name))

    out = denied.join(totals, ["day", "origin"], "left")
    for frame in (top(clients, "client", "bytes", "top_clients"), top(days, "dst_ip", "bytes", "top_destinations"), top(days, "dst_port", "flows", "top_ports"), top(days, "dst_country", "bytes", "top_countries")):
        out = out.join(frame, ["day", "origin"], "left")
    if alerts is not None:
        by_severity = alerts.select(_floor("last_occurrence", DAY).alias("day"), F.lit(0).cast("smallint").alias("origin"), F.col("severity").cast("string").alias("severity")).groupBy("day", "origin", "severity").count()
        out = out.join(by_severity.groupBy("day", "origin").agg(F.sort_array(F.collect_list(F.struct("severity", "count"))).alias("alerts")), ["day", "origin"], "left")
    body = sorted(c for c in out.columns if c not in ("day", "origin"))
    return out.select("day", "origin", F.to_json(F.struct(*body)).alias("summary"))


def days_without_summary(days: DataFrame, summaries: DataFrame, limit: int = 31) -> DataFrame:
    return days.select("day", "origin").distinct().join(summaries.select("day", "origin"), ["day", "origin"], "left_anti").orderBy("day", "origin").limit(limit)


AGGREGATE_KEYS = (
    "origin", "exporter_addr", "src_ip", "dst_ip", "src_v4", "dst_v4", "dst_port", "protocol", "src_vlan", "dst_vlan", "direction", "src_client_id", "dst_client_id", "dst_country", "dst_asn", "sampling_interval", "service",
)


def aggregate_flows(flows: DataFrame, width: int = 5 * MINUTE) -> DataFrame:
    """Old flows in fewer rows: sums of counters per bucket and key, the source port given up."""
    keys = [c for c in AGGREGATE_KEYS if c in flows.columns]
    return flows.groupBy(_floor("start_time", width).alias("start_time"), *keys).agg(
        F.min("flow_id").alias("flow_id"), F.max("end_time").alias("end_time"), F.sum("packets").alias("packets"), F.sum("octets").alias("octets"), F.sum("flow_count").alias("flow_count"),
        F.bit_or("tcp_flags").alias("tcp_flags"), F.lit(0).alias("src_port"),
    )
