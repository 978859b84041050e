"""Capture files of raw datagrams: a magic line, then records of a 32-byte big-endian header and a payload."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"NSRAW1\n"
KINDS = {0: "flow", 1: "syslog"}
# received_at, kind, transport, source port, local port, payload length, address
_HEADER = struct.Struct(">qBBHHH16s")
SCHEMA = "received_at bigint, kind string, transport smallint, source string, source_port int, local_port int, payload binary"


def encode(received_at: int, kind: str, transport: int, source: str, source_port: int, local_port: int, payload: bytes) -> bytes:
    address = ipaddress.ip_address(source)
    packed = b"\0" * 10 + b"\xff\xff" + address.packed if address.version == 4 else address.packed
    code = next(k for k, v in KINDS.items() if v == kind)
    return _HEADER.pack(received_at, code, transport, source_port, local_port, len(payload), packed) + payload


def records(data: bytes) -> Iterator[tuple]:
    """The records of a file; the first that is cut short ends it. A file without the magic has none."""
    if not data.startswith(MAGIC):
        return
    at = len(MAGIC)
    while at + _HEADER.size <= len(data):
        received, code, transport, sport, lport, size, packed = _HEADER.unpack_from(data, at)
        at += _HEADER.size
        if at + size > len(data):
            return
        address = ipaddress.IPv6Address(packed)
        yield received, KINDS.get(code, "other"), transport, str(address.ipv4_mapped or address), sport, lport, data[at : at + size]
        at += size


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """All datagrams of capture files, one task per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(records(bytes(content)))
                yield pd.DataFrame(rows, columns=["received_at", "kind", "transport", "source", "source_port", "local_port", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def write_capture(datagrams: DataFrame, path: str) -> None:
    """One file for each partition, as binary parts under ``path`` on a file system that every task can write to."""
    import os

    def run(rows) -> Iterator[int]:
        from pyspark import TaskContext

        os.makedirs(path, exist_ok=True)
        with open(f"{path}/part-{TaskContext.get().partitionId():05d}.nsraw", "wb") as f:
            f.write(MAGIC)
            n = 0
            for r in rows:
                f.write(encode(r.received_at, r.kind, r.transport, r.source, r.source_port, r.local_port, bytes(r.payload)))
                n += 1
        yield n

    datagrams.rdd.mapPartitions(run).count()
