"""The predicate language of record searches: a typed filter, compiled to one column expression."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.netaddr import in_prefix, v4_range

FLOWS, EVENTS = "flows", "events"


@dataclass(frozen=True)
class RecordFilter:
    """All clauses hold together; an empty list or None does not constrain. Values are only ever literals."""

    start: int | None = None
    end: int | None = None
    origin: int = 0
    any_ip: str | None = None
    src_ip: str | None = None
    dst_ip: str | None = None
    prefix: str | None = None
    client_id: int | None = None
    ports: Sequence[int] = ()
    protocols: Sequence[int] = ()
    directions: Sequence[int] = ()
    countries: Sequence[str] = ()
    asns: Sequence[int] = ()
    exporter: str | None = None
    vlans: Sequence[int] = ()
    min_octets: int | None = None
    min_packets: int | None = None
    actions: Sequence[int] = ()
    severities: Sequence[int] = ()
    event_types: Sequence[int] = ()
    ids_signature: str | None = None
    text: str | None = None
    extra: tuple[Any, ...] = field(default=(), compare=False)

    def record_level(self) -> bool:
        """Whether anything but time, origin and direction constrains: then rollups cannot answer."""
        plain = RecordFilter(start=self.start, end=self.end, origin=self.origin, directions=self.directions)
        return self != plain


def _substring(column: str, needle: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(needle.lower()))


def _address(column: str, ip: str) -> Column:
    """Equality on the text, with the numeric twin where there is one: the number has footer statistics worth skipping by."""
    test = F.col(column) == ip
    if ipaddress.ip_address(ip).version == 4:
        test = test & (F.col(column.replace("_ip", "_v4")) == v4_range(ip)[0])
    return test


def compile_filter(f: RecordFilter, kind: str = FLOWS, *, numeric: bool = True) -> Column:
    """One boolean column. ``numeric``: the v4 number columns are there to be used next to the texts."""
    time = "start_time" if kind == FLOWS else "received_at"
    address = _address if numeric and kind == FLOWS else (lambda c, ip: F.col(c) == ip)
    parts: list[Column] = [F.col("origin") == f.origin]
    if f.start is not None:
        parts.append(F.col(time) >= f.start)
    if f.end is not None:
        parts.append(F.col(time) <= f.end)
    if f.any_ip:
        parts.append(address("src_ip", f.any_ip) | address("dst_ip", f.any_ip))
    if f.src_ip:
        parts.append(address("src_ip", f.src_ip))
    if f.dst_ip:
        parts.append(address("dst_ip", f.dst_ip))
    if f.prefix:
        if numeric and kind == FLOWS and ipaddress.ip_network(f.prefix, strict=False).version == 4:
            lo, hi = v4_range(f.prefix)
            parts.append(F.col("src_v4").between(lo, hi) | F.col("dst_v4").between(lo, hi))
        else:
            parts.append(in_prefix(F.col("src_ip"), f.prefix) | in_prefix(F.col("dst_ip"), f.prefix))
    if f.client_id is not None:
        parts.append((F.col("src_client_id") == f.client_id) | (F.col("dst_client_id") == f.client_id))
    for column, values in (("dst_port", f.ports), ("protocol", f.protocols), ("direction", f.directions), ("dst_country", f.countries), ("dst_asn", f.asns)):
        if values:
            parts.append(F.col(column).isin(list(values)))
    if f.exporter:
        parts.append(F.col("exporter_addr" if kind == FLOWS else "source_ip") == f.exporter)
    if f.vlans:
        parts.append((F.col("src_vlan").isin(list(f.vlans)) | F.col("dst_vlan").isin(list(f.vlans))) if kind == FLOWS else F.col("vlan").isin(list(f.vlans)))
    if kind == FLOWS:
        if f.min_octets is not None:
            parts.append(F.col("octets") >= f.min_octets)
        if f.min_packets is not None:
            parts.append(F.col("packets") >= f.min_packets)
    else:
        for column, values in (("action", f.actions), ("severity", f.severities), ("event_type", f.event_types)):
            if values:
                parts.append(F.col(column).isin(list(values)))
        if f.ids_signature:
            parts.append(_substring("ids_signature", f.ids_signature))
        if f.text:
            parts.append(_substring("message", f.text) | _substring("rule_name", f.text) | _substring("hostname", f.text))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def overlaps(start: Column, end: Column, lo: int, hi: int) -> Column:
    """Interval overlap; an open interval has a null end."""
    return (start <= hi) & (end.isNull() | (end >= lo))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open validity: start <= at < end, with a null end still open."""
    return (start <= at) & (end.isNull() | (end > at))
