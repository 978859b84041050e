"""Unbounded input: syslog and IPFIX decoding, additive rollups, rules with state, and a bounded live feed."""

from __future__ import annotations

import json
import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators import rollups, syslog
from tidewire.operators.ipfix import SCHEMA, Decoder, State, domain_of, to_frame
from tidewire.sources.metadata import Folder


class DatagramSource(DataSource):
    """UDP datagrams, or framed TCP messages, on one port of the driver: options host, port, transport, allow, most.

    A bounded queue takes what arrives between batches; beyond ``most`` the newest are dropped and counted. Senders
    that must not lose datagrams go through a log such as Kafka instead.
    """

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "received_at bigint, kind string, transport smallint, source string, source_port int, local_port int, payload binary"

    def simpleStreamReader(self, schema):
        return DatagramReader(self.options)


class DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "127.0.0.1"), int(options.get("port", "0"))
        self.kind, self.tcp = options.get("kind", "syslog"), options.get("transport", "udp") == "tcp"
        self.allow = set(filter(None, options.get("allow", "").split(",")))
        self.most = int(options.get("most", "8192"))
        self.rows: deque = deque()
        self.taken: dict[int, list] = {}
        self.dropped = self.rejected = 0
        self.lock = threading.Lock()
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_STREAM if self.tcp else socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((self.host, self.port))
        if self.tcp:
            self.socket.listen(64)
        threading.Thread(target=self._accept if self.tcp else self._receive, daemon=True).start()

    def _put(self, source: str, port: int, payload: bytes) -> None:
        with self.lock:
            if self.allow and source not in self.allow:
                self.rejected += 1
            elif len(self.rows) >= self.most:
                self.dropped += 1
            else:
                self.rows.append((time.time_ns() // 1000, self.kind, 1 if self.tcp else 0, source, port, self.port, payload))

    def _receive(self) -> None:
        while True:
            payload, (source, port) = self.socket.recvfrom(65535)
            self._put(source, port, payload)

    def _accept(self) -> None:
        while True:
            conn, (source, port) = self.socket.accept()
            threading.Thread(target=self._stream, args=(conn, source, port), daemon=True).start()

    def _stream(self, conn, source: str, port: int) -> None:
        left = b""
        while chunk := conn.recv(65536):
            found, left = syslog.frames(left + chunk)
            for message in found:
                self._put(source, port, message)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator, dict]:
        with self.lock:
            rows = list(self.rows)
            self.rows.clear()
        if rows:
            self.taken[start["n"]] = rows
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator:
        return iter(self.taken.get(start["n"], []))

    def commit(self, end: dict) -> None:
        for n in [n for n in self.taken if n < end["n"]]:
            del self.taken[n]


def syslog_events(lines: DataFrame, zone: str = "UTC") -> DataFrame:
    """Parsed events of a stream of lines: a projection, so it needs no state."""
    return syslog.parse(lines, zone)


def ipfix_flows(datagrams: DataFrame, forget_after_s: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """Flow and event rows of a datagram stream. The decoder's state is kept per exporter and domain; templates and what
    waits for one go once nothing was heard from the exporter for ``forget_after_s``, by the watermark of the time of arrival."""
    keyed = datagrams.select("source", domain_of(F.col("payload")).alias("domain"), "received_at", "payload", F.timestamp_micros("received_at").alias("at_time")).withWatermark("at_time", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        decoder = Decoder(State.load(state.get[0]) if state.exists else None)
        rows: list[dict] = []
        datagrams = sorted(((int(at), bytes(p)) for b in batches for at, p in zip(b["received_at"], b["payload"], strict=True)))
        for at, payload in datagrams:
            for r in decoder.decode(payload, at):
                r["exporter"] = key[0]
                rows.append(r)
        state.update((decoder.state.dump(),))
        newest = max((at for at, _ in datagrams), default=0)
        state.setTimeoutTimestamp(max(newest // 1000 + forget_after_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield to_frame(rows)

    return keyed.groupBy("source", "domain").applyInPandasWithState(step, SCHEMA, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_rule(rows: DataFrame, keys: list[str], time_col: str, value: str, id_col: str, *, window: int, threshold: int, delay: str = "10 minutes") -> DataFrame:
    """The sliding distinct count with its cool-down over a stream; the window and the last alert are the state.

    Rows later than ``delay`` are not looked at. A key's state goes once the watermark is a window past its last row: then
    neither its window nor its cool-down can reach another row."""
    shape = ", ".join(f"{k} string" for k in keys) + ", at bigint, id bigint, distinct int"
    narrow = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(time_col).alias("t"), F.col(id_col).alias("i"), F.col(value).cast("string").alias("v"), F.timestamp_micros(time_col).alias("at_time")).withWatermark("at_time", delay)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = json.loads(state.get[0]) if state.exists else ({}, None)
        out, newest = [], max([0, *seen.values()])
        for batch in batches:
            for t, i, v in sorted(zip(batch["t"].tolist(), batch["i"].tolist(), batch["v"].tolist(), strict=True)):
                seen = {k: s for k, s in seen.items() if s >= t - window}
                seen[v] = t
                newest = max(newest, t)
                if len(seen) >= threshold and (last is None or t - last > window):
                    last = t
                    out.append((*key, t, i, len(seen)))
        state.update((json.dumps([seen, last]),))
        state.setTimeoutTimestamp(max((newest + window) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[*keys, "at", "id", "distinct"])

    return narrow.groupBy(*keys).applyInPandasWithState(step, shape, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts by type in tumbling windows with a watermark, for those who may drop late rows."""
    at = F.timestamp_micros("received_at")
    return events.withColumn("at", at).withWatermark("at", delay).groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def ids_with_flows(events: DataFrame, flows: DataFrame, slack_s: int = 120) -> DataFrame:
    """Stream-stream interval join: intrusion events with flows of the same endpoints, both with watermarks."""
    ends = F.array_sort(F.array("src_ip", "dst_ip"))
    e = events.where("event_type = 2").select("event_id", ends.alias("e_ends"), F.timestamp_micros("received_at").alias("e_at")).withWatermark("e_at", f"{slack_s} seconds")
    f = flows.select("flow_id", ends.alias("f_ends"), F.timestamp_micros("end_time").alias("f_at")).withWatermark("f_at", f"{slack_s} seconds")
    near = (F.col("f_at") >= F.col("e_at") - F.expr(f"interval {slack_s} seconds")) & (F.col("f_at") <= F.col("e_at") + F.expr(f"interval {slack_s} seconds"))
    return e.join(f, (F.col("e_ends") == F.col("f_ends")) & near)


class RollupSink:
    """foreachBatch: each batch's minute rollup is a part named by its batch id. Writing a batch again replaces its part,
    so that a retry counts once; late rows are just another part. Readers merge parts; ``compact`` folds old ones.

    Folded parts are in ``folded=N``, which holds all batches up to N. Batches up to the newest one are not read any more,
    whether they are deleted yet or not, so a fold that stops half-way changes no sum."""

    def __init__(self, path: str):
        self.path = path

    def _parts(self, spark: SparkSession) -> tuple[int, list[int], Folder]:
        """The newest fold, and the batches after it."""
        folder = Folder(spark, self.path)
        names = [n.split("=") for n in folder.children(self.path) if "=" in n and folder.exists(f"{self.path}/{n}/_SUCCESS")]
        fold = max((int(n) for k, n in names if k == "folded"), default=-1)
        return fold, sorted(int(n) for k, n in names if k == "batch" and int(n) > fold), folder

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rollups.minute_rollup(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        fold, batches, _ = self._parts(spark)
        paths = [*([f"{self.path}/folded={fold}"] if fold >= 0 else []), *[f"{self.path}/batch={n}" for n in batches]]
        return rollups.merge_minutes(*[spark.read.parquet(p) for p in paths])

    def compact(self, spark: SparkSession, keep: int = 10) -> int:
        """Fold all parts but the last ``keep`` batches, which a restarted stream may write again. Returns the parts folded."""
        fold, batches, folder = self._parts(spark)
        old = batches[: max(0, len(batches) - keep)]
        if not old:
            return 0
        paths = [*([f"{self.path}/folded={fold}"] if fold >= 0 else []), *[f"{self.path}/batch={n}" for n in old]]
        rollups.merge_minutes(*[spark.read.parquet(p) for p in paths]).write.mode("overwrite").parquet(f"{self.path}/folded={old[-1]}")
        for p in paths:
            folder.delete(p)
        return len(old)


class LiveFeed:
    """foreachBatch: at most ``per_batch`` newest rows of each batch for a viewer, the rest counted as left out."""

    def __init__(self, time_col: str, per_batch: int, keep: int = 2000):
        self.time_col, self.per_batch = time_col, per_batch
        self.rows: deque = deque(maxlen=keep)
        self.left_out = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        newest = batch.orderBy(F.desc(self.time_col)).limit(self.per_batch).collect()
        self.left_out += max(0, batch.count() - len(newest))
        self.rows.extend(reversed(newest))
