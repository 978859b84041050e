"""Detection rules over enriched records, in arrival order.

Batch form. Novelty rules are minima per key; what a trailing window holds is a running sum of what enters and leaves
it (``trailing_distinct``). Rules with a memory of their own output (cool-downs, re-anchored windows, bursts) need the
one thing that is sequential: a row opens a span unless it falls into the span that the last opening row began. That
is one pass over each key's rows in order, batch by batch, of which only the last opening time is held (``opened``); no
key's rows are ever gathered in an array. A busy key is still one task there, but one that streams.

Findings have one shape: rule, dedupe_key, at, severity, client_id, subject, evidence (map), flow_ids, event_ids.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.netaddr import in_prefix

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000
INFO, LOW, MEDIUM, HIGH, CRITICAL = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds; every one can be set. ``enabled`` names the rules that run, all where empty."""

    params: dict = field(default_factory=dict)
    disabled: tuple[str, ...] = ()

    def get(self, rule: str, name: str, default):
        return self.params.get(f"{rule}.{name}", default)


def finding(rule: str, *, key: Column, at: Column, severity, client: Column | None = None, subject: Column | None = None, evidence: dict[str, Column] | None = None, flows: Column | None = None, events: Column | None = None) -> list[Column]:
    pairs = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    ids = lambda c: F.coalesce(c, F.array().cast("array<bigint>")) if c is not None else F.array().cast("array<bigint>")
    return [
        F.lit(rule).alias("rule"), F.concat_ws("|", F.lit(rule), key).alias("dedupe_key"), at.alias("at"), (severity if isinstance(severity, Column) else F.lit(severity)).cast("int").alias("severity"),
        (client if client is not None else F.lit(None)).cast("bigint").alias("client_id"), (subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
        F.create_map(*pairs).alias("evidence") if pairs else F.create_map().cast("map<string,string>").alias("evidence"), ids(flows).alias("flow_ids"), ids(events).alias("event_ids"),
    ]


def unexpected(df: DataFrame, expectations: DataFrame | None, kind: str, value: Column, scope: Column | str | None = "src_client_id", *, everybody: bool = True) -> DataFrame:
    """Rows whose (kind, value) is expected neither of their scope (by default the client) nor, unless told otherwise, of everybody ('*')."""
    if expectations is None:
        return df
    known = expectations.where(F.col("kind") == kind).select(F.col("scope_value").alias("_scope"), F.col("value").alias("_value")).distinct()
    rows = df.withColumn("_v", value.cast("string"))
    if scope is not None:
        own = F.col(scope) if isinstance(scope, str) else scope
        rows = rows.withColumn("_own", own.cast("string"))
        rows = rows.join(known, (F.col("_own") == F.col("_scope")) & (F.col("_v") == F.col("_value")), "left_anti").drop("_own")
    if everybody:
        rows = rows.join(known.where("_scope = '*'").select("_value"), F.col("_v") == F.col("_value"), "left_anti")
    return rows.drop("_v")


# What is new, by rule: key column, least octets, severity.
NOVELTIES = {
    "first-seen-destination": ("dst_ip", 10_000, INFO),
    "first-seen-country": ("dst_country", 1, LOW),
    "first-seen-asn": ("dst_asn", 1, LOW),
    "first-seen-service": ("service_key", 1, LOW),
}


def first_seen_table(flows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(client, kind, key) with first and last time and count; ``known`` is the table so far."""
    parts = []
    rows = _novel_rows(flows)
    for rule, (column, _, _) in NOVELTIES.items():
        parts.append(rows.where(F.col(column).isNotNull()).select(F.col("src_client_id").alias("client"), F.lit(rule).alias("kind"), F.col(column).cast("string").alias("key"), F.col("end_time").alias("first"), F.col("end_time").alias("last"), F.lit(1).cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if known is not None:
        out = out.unionByName(known)
    return out.groupBy("client", "kind", "key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def _novel_rows(flows: DataFrame) -> DataFrame:
    rows = flows.where((F.col("direction") == 1) & F.col("src_client_id").isNotNull())
    return rows.withColumn("service_key", F.concat_ws("/", F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "udp").otherwise(F.col("protocol").cast("string")), F.col("dst_port").cast("string")))


def first_seen(flows: DataFrame, rule: str, *, learning: int = 3 * DAY, min_octets: int | None = None, known: DataFrame | None = None, expectations: DataFrame | None = None) -> DataFrame:
    """A client's first flow to a destination, country, network or service, once its learning time is over.

    What is seen while learning, or below the least size, is no longer new afterwards: it is the first row of a
    key that counts. That row is a minimum by (time, id) per key, so a busy key costs one row per task.
    """
    column, default_octets, severity = NOVELTIES[rule]
    least = default_octets if min_octets is None else min_octets
    rows = _novel_rows(flows)
    start = rows.groupBy("src_client_id").agg(F.min("start_time").alias("client_start"))
    if known is not None:
        begun = known.groupBy(F.col("client").alias("src_client_id")).agg(F.min("first").alias("client_start"))
        start = start.unionByName(begun).groupBy("src_client_id").agg(F.min("client_start").alias("client_start"))
    first = rows.where(F.col(column).isNotNull()).groupBy("src_client_id", F.col(column).cast("string").alias("key")).agg(F.min(F.struct("end_time", "flow_id", "octets", "dst_ip", "dst_port")).alias("f"))
    if known is not None:
        old = known.where(F.col("kind") == rule).select(F.col("client").alias("src_client_id"), "key")
        first = first.join(old, ["src_client_id", "key"], "left_anti")
    new = first.join(start, "src_client_id").where((F.col("f.end_time") - F.col("client_start") >= learning) & (F.col("f.octets") >= least))
    new = unexpected(new, expectations, column, F.col("key"))
    return new.select(*finding(rule, key=F.concat_ws("|", "src_client_id", "key"), at=F.col("f.end_time"), severity=severity, client=F.col("src_client_id"), subject=F.col("key"), evidence={"octets": F.col("f.octets"), "dst_ip": F.col("f.dst_ip"), "dst_port": F.col("f.dst_port")}, flows=F.array("f.flow_id")))


def unauthorized_resolver(flows: DataFrame, trusted: list[str], *, min_flows: int = 1, expectations: DataFrame | None = None) -> DataFrame:
    """DNS to a resolver that is not trusted: every flow from the ``min_flows``-th on. Inert without trusted resolvers."""
    rows = flows.where(F.col("dst_port").isin(53, 853) & (F.col("direction") != 2))
    rows = rows.where(~F.col("dst_ip").isin(trusted)) if trusted else rows.where(F.lit(False))
    rows = unexpected(rows, expectations, "resolver", F.col("dst_ip"))
    nth = F.row_number().over(Window.partitionBy("src_client_id", "src_ip", "dst_ip").orderBy("start_time", "flow_id"))
    hit = rows.withColumn("nth", nth).where(F.col("nth") >= min_flows)
    return hit.select(*finding("dns-unauthorized-resolver", key=F.concat_ws("|", "src_ip", "dst_ip"), at=F.col("end_time"), severity=MEDIUM, client=F.col("src_client_id"), subject=F.col("dst_ip"), evidence={"count": F.col("nth"), "port": F.col("dst_port")}, flows=F.array("flow_id")))


def opened(rows: DataFrame, keys: list[str], time: str, id_col: str, length: int, *, at_end: bool) -> DataFrame:
    """``rows`` with _since, the time of the row that opened the span they are in, and _opens, whether they opened it.

    A key's first row opens a span; a later one does where it lies more than ``length`` after the last opening row,
    or, with ``at_end``, at least that. Order is (time, id). Rows pass through in batches, sorted by key.
    """
    laid = rows.withColumn("_key", F.to_json(F.struct(*keys))).repartition("_key").sortWithinPartitions("_key", time, id_col)
    side = "left" if at_end else "right"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, t = batch.column(batch.schema.get_field_index("_key")), batch.column(batch.schema.get_field_index(time)).to_numpy()
            edges = np.flatnonzero(pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
            since, opens = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
                if (here := key[a].as_py()) != name:
                    name, last = here, None
                while a < b:
                    if last is not None:
                        end = a + int(np.searchsorted(t[a:b], last + length, side=side))
                        since[a:end], a = last, end
                        if a == b:
                            break
                    last, opens[a] = int(t[a]), True
                    since[a] = last
                    a += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(since), pa.array(opens)], names=[*batch.schema.names, "_since", "_opens"])

    schema = T.StructType([*laid.schema.fields, T.StructField("_since", T.LongType()), T.StructField("_opens", T.BooleanType())])
    return laid.mapInArrow(run, schema).drop("_key")


def trailing_distinct(rows: DataFrame, keys: list[str], time: str, value: str, id_col: str, window: int) -> DataFrame:
    """(keys, time, id, distinct): how many values a key had in the ``window`` up to and including each row.

    A value enters with a row unless it is there already, and leaves a window after its last row. The count is the
    running sum of both: linear in the rows, whatever a window holds.
    """
    same = Window.partitionBy(*keys, value).orderBy(time, id_col)
    rows = rows.where(F.col(value).isNotNull()).select(*keys, time, id_col, value)
    seen = rows.withColumns({"_before": F.lag(time).over(same), "_after": F.lead(time).over(same)})
    enters = F.coalesce(F.col(time) - F.col("_before") > window, F.lit(True)).cast("int")
    leaves = F.coalesce(F.col("_after") - F.col(time) > window, F.lit(True))
    first = F.lit(-(1 << 63)).cast("bigint")  # before all rows of its time
    events = seen.select(*keys, F.col(time).alias("_t"), F.col(id_col).cast("bigint").alias("_i"), enters.alias("_d")).unionByName(
        seen.where(leaves).select(*keys, (F.col(time) + window + 1).alias("_t"), first.alias("_i"), F.lit(-1).alias("_d"))
    )
    count = F.sum("_d").over(Window.partitionBy(*keys).orderBy("_t", "_i").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("distinct", count.cast("int")).where(F.col("_i") != first).select(*keys, F.col("_t").alias(time), F.col("_i").alias(id_col), "distinct")


def sliding_distinct(rows: DataFrame, keys: list[str], time: str, value: str, id_col: str, *, window: int, threshold: int) -> DataFrame:
    """Alerts (keys, at, id, distinct) where the distinct values of a trailing window (inclusive) reach a threshold,
    with as long a cool-down after each alert."""
    reached = trailing_distinct(rows, keys, time, value, id_col, window).where(F.col("distinct") >= threshold)
    fired = opened(reached, keys, time, id_col, window, at_end=False).where("_opens")
    return fired.select(*keys, F.col(time).alias("at"), F.col(id_col).alias("id"), "distinct")


def port_scan(flows: DataFrame, *, horizontal: bool = True, window: int = 60 * SECOND, threshold: int | None = None, max_packets: int = 4) -> DataFrame:
    """Many destinations on one port (horizontal), or many ports of one destination (vertical), in short flows."""
    rows = flows.where((F.col("packets") <= max_packets) & F.col("protocol").isin(6, 17))
    rows = rows.withColumn("service_key", F.concat_ws("/", F.col("protocol").cast("string"), F.col("dst_port").cast("string")))
    name, keys, value, least = ("port-scan-horizontal", ["src_ip", "service_key"], "dst_ip", 25) if horizontal else ("port-scan-vertical", ["src_ip", "dst_ip"], "dst_port", 20)
    hits = sliding_distinct(rows, keys, "end_time", value, "flow_id", window=window, threshold=threshold or least)
    inside = F.col("src_ip").rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return hits.select(*finding(name, key=F.concat_ws("|", *keys), at=F.col("at"), severity=F.when(inside, HIGH).otherwise(MEDIUM), subject=F.col("src_ip"), evidence={"distinct": F.col("distinct")}, flows=F.array("id")))


def repeated_denials(events: DataFrame, *, window: int = 300 * SECOND, threshold: int = 20) -> DataFrame:
    """Many denials of one (source, destination, port) within a window; as long a cool-down."""
    rows = events.where((F.col("event_type") == 1) & F.col("action").isin(2, 3) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).withColumn("t", F.coalesce("event_time", "received_at"))
    keys = ["src_ip", "dst_ip", "dst_port"]
    hits = sliding_distinct(rows, keys, "t", "event_id", "event_id", window=window, threshold=threshold)
    return hits.select(*finding("repeated-denials", key=F.concat_ws("|", *keys), at=F.col("at"), severity=MEDIUM, subject=F.col("src_ip"), evidence={"count": F.col("distinct"), "port": F.col("dst_port")}, events=F.array("id")))


def large_transfer(flows: DataFrame, *, window: int = 3600 * SECOND, threshold: int = 1_000_000_000, expectations: DataFrame | None = None) -> DataFrame:
    """Bytes from a client to one destination, times sampling, in windows anchored at the first flow after the last
    window's end; once per window, which is part of the key. Expected where the client's destination is."""
    rows = unexpected(flows.where((F.col("direction") == 1) & F.col("src_client_id").isNotNull()), expectations, "destination", F.col("dst_ip"), everybody=False)
    keys = ["src_client_id", "dst_ip"]
    rows = rows.select(*keys, "end_time", "flow_id", (F.col("octets") * F.greatest(F.coalesce("sampling_interval", F.lit(1)), F.lit(1))).alias("volume"))
    # Only keys that ever reach the threshold, in all their rows, are laid out in order.
    heavy = rows.groupBy(*keys).agg(F.sum("volume").alias("_s")).where(F.col("_s") >= threshold).drop("_s")
    spans = opened(rows.join(heavy, keys, "left_semi"), keys, "end_time", "flow_id", window, at_end=False)
    total = F.sum("volume").over(Window.partitionBy(*keys, "_since").orderBy("end_time", "flow_id").rowsBetween(Window.unboundedPreceding, 0))
    over = spans.withColumn("bytes", total).where(F.col("bytes") >= threshold)
    hits = over.groupBy(*keys, "_since").agg(F.min(F.struct("end_time", "flow_id", "bytes")).alias("f"))
    key = F.concat_ws("|", *keys, F.expr(f"_since div {HOUR}").cast("string"))
    return hits.select(*finding("large-outbound-transfer", key=key, at=F.col("f.end_time"), severity=MEDIUM, client=F.col("src_client_id"), subject=F.col("dst_ip"), evidence={"bytes": F.col("f.bytes")}, flows=F.array("f.flow_id")))


def order_statistics(values: Column) -> tuple[Column, Column]:
    """Upper median and the value at 95 % of the count, of an array."""
    a = F.array_sort(values)
    n = F.size(a)
    return F.get(a, F.floor(n / 2).cast("int")), F.get(a, F.least(n - 1, F.floor(n * 0.95).cast("int")))


def hourly_history(flows_or_minutes: DataFrame) -> DataFrame:
    """(client_id, hour, bytes, flows) outbound, from minute rollups. Hours without traffic are absent."""
    rows = flows_or_minutes.where("client_id <> 0 and direction = 1")
    return rows.groupBy("client_id", (F.col("bucket") - F.col("bucket") % HOUR).alias("hour")).agg(F.sum("bytes").alias("bytes"), F.sum("flows").alias("flows"))


def unusual_volume(flows: DataFrame, history: DataFrame, *, days: int = 7, min_bytes: int = 200_000_000, factor: int = 8, min_hours: int = 24) -> DataFrame:
    """A client's running outbound bytes of an hour against its own hours before: at least ``min_bytes``, ``factor``
    times the median and above the 95th percentile. Once per client and hour."""
    rows = flows.where((F.col("direction") == 1) & F.col("src_client_id").isNotNull()).withColumn("hour", F.col("end_time") - F.col("end_time") % HOUR)
    running = F.sum(F.col("octets") * F.greatest(F.coalesce("sampling_interval", F.lit(1)), F.lit(1))).over(Window.partitionBy("src_client_id", "hour").orderBy("end_time", "flow_id").rowsBetween(Window.unboundedPreceding, 0))
    crossing = rows.withColumn("running", running).where(F.col("running") >= min_bytes)
    # A range over each client's hours, the ones asked for among them; it holds a week of hours, 168 values at most.
    asked = crossing.select(F.col("src_client_id").alias("client_id"), "hour").distinct().withColumns({"bytes": F.lit(None).cast("bigint"), "asked": F.lit(True)})
    line = history.select("client_id", "hour", F.col("bytes").cast("bigint").alias("bytes")).withColumn("asked", F.lit(False)).unionByName(asked)
    values = F.collect_list("bytes").over(Window.partitionBy("client_id").orderBy("hour").rangeBetween(-days * DAY, -1))
    median, p95 = order_statistics(F.col("values"))
    base = line.withColumn("values", values).where("asked").where(F.size("values") >= min_hours)
    base = base.select(F.col("client_id").alias("src_client_id"), "hour", median.alias("median"), p95.alias("p95"))
    hit = crossing.join(base, ["src_client_id", "hour"]).where((F.col("running") >= factor * F.greatest("median", F.lit(1))) & (F.col("running") > F.col("p95")))
    first = hit.groupBy("src_client_id", "hour").agg(F.min(F.struct("end_time", "flow_id", "running", "median", "p95")).alias("f"))
    return first.select(*finding("unusual-outbound-volume", key=F.concat_ws("|", "src_client_id", "hour"), at=F.col("f.end_time"), severity=MEDIUM, client=F.col("src_client_id"), evidence={"bytes": F.col("f.running"), "median": F.col("f.median"), "p95": F.col("f.p95")}, flows=F.array("f.flow_id")))


def local_hour(time: Column, zone: str = "UTC") -> Column:
    return F.hour(F.from_utc_timestamp(F.timestamp_micros(time), zone))


def hour_histogram(history: DataFrame, zone: str = "UTC") -> DataFrame:
    """Flows by client and local hour of day, all 24 of them."""
    dense = history.select("client_id").distinct().withColumn("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(23))))
    sums = history.groupBy("client_id", local_hour(F.col("hour"), zone).alias("hour_of_day")).agg(F.sum("flows").alias("flows"))
    return dense.join(sums, ["client_id", "hour_of_day"], "left").select("client_id", "hour_of_day", F.coalesce("flows", F.lit(0)).alias("flows"))


def unusual_time(flows: DataFrame, history: DataFrame, *, zone: str = "UTC", days: int = 14, min_flows: int = 20, min_history: int = 480, share: float = 0.02) -> DataFrame:
    """Activity in an hour of the day that a client hardly ever uses. Once per client and hour."""
    rows = flows.where((F.col("direction") == 1) & F.col("src_client_id").isNotNull()).withColumn("hour", F.col("end_time") - F.col("end_time") % HOUR)
    nth = F.row_number().over(Window.partitionBy("src_client_id", "hour").orderBy("end_time", "flow_id"))
    reached = rows.withColumn("nth", nth).where(F.col("nth") == min_flows).select("src_client_id", "hour", "end_time", "flow_id", "nth")
    asked = reached.select(F.col("src_client_id").alias("client_id"), "hour", F.lit(0).cast("bigint").alias("flows"), "end_time", "flow_id", "nth")
    line = history.select("client_id", "hour", F.col("flows").cast("bigint").alias("flows")).unionByName(asked, allowMissingColumns=True).withColumn("then", local_hour(F.col("hour"), zone))
    past = lambda *by: F.sum("flows").over(Window.partitionBy(*by).orderBy("hour").rangeBetween(-days * DAY, -1))
    base = line.withColumns({"total": past("client_id"), "then": F.coalesce(past("client_id", "then"), F.lit(0))}).where(F.col("flow_id").isNotNull()).withColumnRenamed("client_id", "src_client_id")
    hit = base.where((F.col("total") >= min_history) & (F.col("then") / F.col("total") < share))
    return hit.select(*finding("unusual-activity-time", key=F.concat_ws("|", "src_client_id", "hour"), at=F.col("end_time"), severity=LOW, client=F.col("src_client_id"), evidence={"flows": F.col("nth"), "history": F.col("total"), "then": F.col("then")}, flows=F.array("flow_id")))


def beaconing(flows: DataFrame, *, window: int = 7200 * SECOND, min_count: int = 12, min_gap: int = 5 * SECOND, max_cv: float = 0.15, max_octets: int = 20_000, apart: int = SECOND, expectations: DataFrame | None = None) -> DataFrame:
    """Small outbound flows at regular intervals: over the trailing window, count, mean gap and variation of gaps; the
    window is the cool-down. Flows within ``apart`` of the last one that counted are the same burst. Expected where
    the client's destination is, or the destination as anybody's beacon."""
    rows = flows.where((F.col("direction") == 1) & (F.col("octets") <= max_octets) & F.col("src_client_id").isNotNull())
    rows = unexpected(rows, expectations, "destination", F.col("dst_ip"), everybody=False)
    rows = unexpected(rows, expectations, "beacon", F.col("dst_ip"), scope=None)
    keys = ["src_client_id", "dst_ip", "dst_port"]
    rows = rows.select(*keys, "start_time", "flow_id")
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).drop("_n")
    single = opened(rows.join(many, keys, "left_semi"), keys, "start_time", "flow_id", apart, at_end=True).where("_opens").drop("_since", "_opens")
    order = Window.partitionBy(*keys).orderBy("start_time")
    gap = (F.col("start_time") - F.lag("start_time").over(order)).cast("double")
    # At most window / apart rows; the gap that leads into the window is none of its gaps.
    held = order.rangeBetween(-window, 0)
    spread = single.withColumn("g2", F.coalesce(gap * gap, F.lit(0.0))).withColumns({"n": F.count(F.lit(1)).over(held).cast("int"), "_first": F.first("start_time").over(held), "_g2": F.sum("g2").over(held) - F.first("g2").over(held)})
    mean = (F.col("start_time") - F.col("_first")) / (F.col("n") - 1)
    regular = spread.where(F.col("n") >= F.lit(max(2, min_count))).withColumn("mean", mean)
    regular = regular.withColumn("cv", F.sqrt(F.greatest(F.col("_g2") / (F.col("n") - 1) - F.col("mean") * F.col("mean"), F.lit(0.0))) / F.col("mean"))
    steady = regular.where((F.col("mean") >= min_gap) & (F.col("cv") <= max_cv)).select(*keys, "start_time", "flow_id", "n", "mean", "cv")
    hits = opened(steady, keys, "start_time", "flow_id", window, at_end=True).where("_opens")
    return hits.select(*finding("beaconing", key=F.concat_ws("|", *keys), at=F.col("start_time"), severity=MEDIUM, client=F.col("src_client_id"), subject=F.col("dst_ip"), evidence={"count": F.col("n"), "mean_gap_us": F.col("mean"), "cv": F.col("cv")}, flows=F.array("flow_id")))


def network_of(ip: Column, vlan: Column, prefixes: list[str] | None) -> Column:
    """The network an address belongs to: its VLAN, else the first of the internal prefixes that holds it; null without either."""
    out = F.when(vlan.isNotNull(), F.concat(F.lit("vlan"), vlan.cast("string")))
    for p in prefixes or []:
        out = out.when(in_prefix(ip, p), F.lit(p))
    return out


def vlan_crossing(flows: DataFrame, *, min_octets: int = 1000, expectations: DataFrame | None = None, prefixes: list[str] | None = None, located: tuple[Column, Column] | None = None) -> DataFrame:
    """Traffic between two internal networks that are not expected to talk; once per source, destination and port.

    The pair of networks has no direction: it is expected as anybody's vlan-pair, or as either network's peer-vlan.
    ``located``: the addresses by which the prefixes of source and destination are found, where they are not src_ip and dst_ip
    (sites that share one address plan).
    """
    src, dst = located or (F.col("src_ip"), F.col("dst_ip"))
    lan = flows.where((F.col("direction") == 3) & (F.col("octets") >= min_octets))
    lan = lan.withColumns({"_s": network_of(src, F.col("src_vlan"), prefixes), "_d": network_of(dst, F.col("dst_vlan"), prefixes)})
    rows = lan.where(F.col("_s") != F.col("_d")).withColumn("pair", F.array_join(F.array_sort(F.array("_s", "_d")), "<->"))
    rows = unexpected(rows, expectations, "vlan-pair", F.col("pair"), scope=None)
    for own, peer in (("_s", "_d"), ("_d", "_s")):
        rows = unexpected(rows, expectations, "peer-vlan", F.col(peer), own, everybody=False)
    first = rows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.min(F.struct("end_time", "flow_id", "octets", "src_client_id", "pair")).alias("f"))
    key = F.concat_ws("|", F.col("f.pair"), "src_ip", "dst_ip", F.col("dst_port").cast("string"))
    return first.select(*finding("unexpected-vlan-communication", key=key, at=F.col("f.end_time"), severity=MEDIUM, client=F.col("f.src_client_id"), subject=F.col("f.pair"), evidence={"octets": F.col("f.octets")}, flows=F.array("f.flow_id")))


def interval_join(events: DataFrame, flows: DataFrame, slack: int = 120 * SECOND) -> DataFrame:
    """(event_id, flow_id) of flows between an event's endpoints that ended within ``slack`` of it.

    Equi-joins on the endpoint pair, in either order, and the time bucket: a flow is in its bucket and an event
    looks into three, so no range join is planned and a busy pair is spread over its buckets.
    """
    both = F.array_sort(F.array("src_ip", "dst_ip"))
    e = events.select("event_id", F.coalesce("event_time", "received_at").alias("t"), both.alias("ends"), F.explode(F.array(*[F.floor(F.coalesce("event_time", "received_at") / slack) + d for d in (-1, 0, 1)])).alias("b"))
    f = flows.select("flow_id", "end_time", both.alias("ends"), F.floor(F.col("end_time") / slack).alias("b"))
    return e.join(f, ["ends", "b"]).where(F.abs(F.col("end_time") - F.col("t")) <= slack).select("event_id", "flow_id", "end_time", "t")


def ids_events(events: DataFrame, flows: DataFrame, *, max_priority: int = 3, slack: int = 120 * SECOND, most: int = 200) -> DataFrame:
    """Intrusion events with the flows of the same endpoints around them."""
    hits = events.where((F.col("event_type") == 2) & (F.coalesce("ids_severity", F.lit(2)) <= max_priority))
    linked = interval_join(hits, flows, slack).groupBy("event_id").agg(F.slice(F.array_sort(F.collect_set("flow_id")), 1, most).alias("flows"))
    rows = hits.join(linked, "event_id", "left")
    priority = F.coalesce("ids_severity", F.lit(2))
    at = F.coalesce("event_time", "received_at")
    severity = F.when(priority <= 1, CRITICAL).when(priority == 2, HIGH).otherwise(MEDIUM)
    return rows.select(*finding("ids-event", key=F.concat_ws("|", "ids_signature", "src_ip", "dst_ip", F.floor(at / (600 * SECOND)).cast("string")), at=at, severity=severity, client=F.col("src_client_id"), subject=F.col("ids_signature"), evidence={"priority": priority}, flows=F.col("flows"), events=F.array("event_id")))


def collection_failure(health: DataFrame, *, min_drops: int = 100) -> DataFrame:
    """Health snapshots (source, at, drops, listener_failed, paused, silent): drops since the one before, and states."""
    order = Window.partitionBy("source").orderBy("at")
    fresh = F.col("drops") - F.coalesce(F.lag("drops").over(order), F.lit(0))
    kinds = F.filter(F.array(F.when(F.col("fresh") >= min_drops, "drops"), F.when(F.col("listener_failed"), "listener-failed"), F.when(F.col("paused"), "ingestion-paused"), F.when(F.col("silent"), "exporter-silent")), lambda x: x.isNotNull())
    rows = health.withColumn("fresh", fresh).withColumn("kind", F.explode(kinds))
    return rows.select(*finding("collection-failure", key=F.concat_ws("|", "source", "kind"), at=F.col("at"), severity=HIGH, subject=F.col("kind"), evidence={"drops": F.col("fresh")}))


RULES = (*NOVELTIES, "dns-unauthorized-resolver", "port-scan-horizontal", "port-scan-vertical", "repeated-denials", "large-outbound-transfer", "unusual-outbound-volume", "unusual-activity-time", "beaconing", "unexpected-vlan-communication", "ids-event", "collection-failure")


def evaluate(flows: DataFrame, events: DataFrame, *, history: DataFrame, health: DataFrame | None = None, config: RuleConfig | None = None, known: DataFrame | None = None, expectations: DataFrame | None = None, trusted: list[str] | None = None, zone: str = "UTC", prefixes: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All enabled rules; a rule that cannot be planned is reported and does not stop the others."""
    config = config or RuleConfig()
    g = config.get
    plans = {rule: (lambda rule=rule: first_seen(flows, rule, learning=g(rule, "learning", 3 * DAY), min_octets=g(rule, "min_octets", None), known=known, expectations=expectations)) for rule in NOVELTIES}
    plans |= {
        "dns-unauthorized-resolver": lambda: unauthorized_resolver(flows, trusted or [], min_flows=g("dns-unauthorized-resolver", "min_flows", 1), expectations=expectations),
        "port-scan-horizontal": lambda: port_scan(flows, threshold=g("port-scan-horizontal", "threshold", 25), window=g("port-scan-horizontal", "window", 60 * SECOND)),
        "port-scan-vertical": lambda: port_scan(flows, horizontal=False, threshold=g("port-scan-vertical", "threshold", 20), window=g("port-scan-vertical", "window", 60 * SECOND)),
        "repeated-denials": lambda: repeated_denials(events, threshold=g("repeated-denials", "threshold", 20), window=g("repeated-denials", "window", 300 * SECOND)),
        "large-outbound-transfer": lambda: large_transfer(flows, threshold=g("large-outbound-transfer", "threshold", 1_000_000_000), expectations=expectations),
        "unusual-outbound-volume": lambda: unusual_volume(flows, history, min_bytes=g("unusual-outbound-volume", "min_bytes", 200_000_000)),
        "unusual-activity-time": lambda: unusual_time(flows, history, zone=zone, min_flows=g("unusual-activity-time", "min_flows", 20)),
        "beaconing": lambda: beaconing(flows, expectations=expectations, min_count=g("beaconing", "min_count", 12)),
        "unexpected-vlan-communication": lambda: vlan_crossing(flows, expectations=expectations, prefixes=prefixes),
        "ids-event": lambda: ids_events(events, flows),
    }
    if health is not None:
        plans["collection-failure"] = lambda: collection_failure(health)
    out, failed = {}, {}
    for rule, plan in plans.items():
        if rule in config.disabled:
            continue
        try:
            out[rule] = plan()
        except Exception as e:  # noqa: BLE001 - isolation of one rule from the others is the point
            failed[rule] = str(e)
    return out, failed


def run_rules(plans: dict[str, DataFrame], write) -> dict[str, dict]:
    """Run planned rules one by one through ``write(rule, findings)``, which returns the number of findings.

    A rule that fails while it runs is reported and does not stop the others: rule -> {findings, seconds, error}.
    """
    stats = {}
    for rule, findings in plans.items():
        began = time.perf_counter()
        try:
            n, error = write(rule, findings), None
        except Exception as e:  # noqa: BLE001 - isolation of one rule from the others is the point
            n, error = 0, str(e)
        stats[rule] = {"findings": n, "seconds": time.perf_counter() - began, "error": error}
    return stats
