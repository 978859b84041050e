"""A catalogue of named questions with typed, bounded arguments, answered as JSON: for an assistant or a script.

Each tool is a thin wrapper over the search operators; what it returns is a page, so collecting it is bounded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.labels import DIRECTION
from tidewire.operators import search as S
from tidewire.operators.filters import RecordFilter

MINUTE = 60_000_000


@dataclass(frozen=True)
class Arg:
    """A typed argument: whole numbers are clamped to their bounds, choices must be one of those named."""

    kind: type
    default: object = None
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()
    required: bool = False

    def read(self, name: str, value):
        if value is None:
            if self.required:
                raise ValueError(f"{name} is required")
            return self.default
        if self.kind is int:
            if isinstance(value, bool) or not isinstance(value, int | float | str):
                raise ValueError(f"{name} must be a number")
            value = int(value)
            value = value if self.least is None else max(self.least, value)
            return value if self.most is None else min(self.most, value)
        value = str(value)
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} must be one of {', '.join(self.choices)}")
        return value


_WINDOW = Arg(int, 60, 1, 43_200)
TOOLS: dict[str, dict[str, Arg]] = {
    "get_network_overview": {"minutes": _WINDOW},
    "query_flows": {
        "minutes": _WINDOW, "ip": Arg(str), "src_ip": Arg(str), "dst_ip": Arg(str), "client_id": Arg(int, None, 0), "dst_port": Arg(int, None, 0, 65_535), "protocol": Arg(int, None, 0, 255), "direction": Arg(str, None, choices=("outbound", "inbound", "lan", "transit")),
        "min_bytes": Arg(int, None, 0), "sort": Arg(str, "bytes", choices=("bytes", "recent")), "limit": Arg(int, 40, 1, 150),
    },
    "top_talkers": {"dimension": Arg(str, None, choices=S.DIMENSIONS, required=True), "minutes": _WINDOW, "limit": Arg(int, 15, 1, 50)},
    "list_clients": {},
    "list_alerts": {"state": Arg(str, "open", choices=("open", "acknowledged", "resolved", "all")), "client_id": Arg(int, None, 0), "limit": Arg(int, 25, 1, 100)},
    "bandwidth_time_series": {"minutes": Arg(int, 60, 5, 43_200), "buckets": Arg(int, 12, 2, 60)},
}


@dataclass
class Toolbox:
    """What the tools read. ``now`` ends their windows."""

    flows: DataFrame
    events: DataFrame
    minutes: DataFrame
    clients: DataFrame
    alerts: DataFrame
    now: int

    def run(self, name: str, arguments: str = "{}") -> str:
        """The answer as JSON; a wrong name or argument gives {"error": ...}, never an exception."""
        try:
            given = json.loads(arguments or "{}")
            if name not in TOOLS:
                raise ValueError(f"unknown tool {name}")
            if not isinstance(given, dict):
                raise ValueError("the arguments must be an object")
            args = {k: a.read(k, given.get(k)) for k, a in TOOLS[name].items()}
            return json.dumps(getattr(self, f"_{name}")(**args), sort_keys=True, default=str)
        except ValueError as e:
            return json.dumps({"error": str(e)})

    def _range(self, minutes: int) -> dict:
        return {"start": self.now - minutes * MINUTE, "end": self.now}

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _get_network_overview(self, minutes: int) -> dict:
        f = RecordFilter(**self._range(minutes))
        out = RecordFilter(**self._range(minutes), directions=(1,))
        tops = {k: self._rows(S.top_n(self.flows, g, d, 5)) for k, g, d in (("clients", f, "src_client_id"), ("destinations", out, "dst_ip"), ("ports", out, "dst_port"))}
        return {"minutes": minutes, "totals": self._rows(S.totals(self.minutes, f))[0], **tops, "events": self._rows(S.event_counts(self.events, f, "event_type"))}

    def _query_flows(self, minutes: int, ip, src_ip, dst_ip, client_id, dst_port, protocol, direction, min_bytes, sort: str, limit: int) -> dict:
        one = lambda v: () if v is None else (v,)
        codes = {v: k for k, v in DIRECTION.items()}
        f = RecordFilter(**self._range(minutes), any_ip=ip, src_ip=src_ip, dst_ip=dst_ip, client_id=client_id, ports=one(dst_port), protocols=one(protocol), directions=one(codes.get(direction)), min_octets=min_bytes)
        rows = S.page(self.flows, f, sort="octets" if sort == "bytes" else "start_time", limit=limit)
        shown = [c for c in ("flow_id", "start_time", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "direction", "octets", "packets", "service", "dst_country") if c in rows.columns]
        found = self._rows(rows.select(*shown))
        return {"flows": found, "count": len(found), "more": len(found) == limit}

    def _top_talkers(self, dimension: str, minutes: int, limit: int) -> dict:
        return {"dimension": dimension, "rows": self._rows(S.top_n(self.flows, RecordFilter(**self._range(minutes)), dimension, limit))}

    def _list_clients(self) -> dict:
        return {"clients": self._rows(self.clients.orderBy(F.desc("last_seen"), "client_id").limit(S.TOP_LIMIT))}

    def _list_alerts(self, state: str, client_id, limit: int) -> dict:
        rows = self.alerts if state == "all" else self.alerts.where(F.col("state") == state)
        rows = rows if client_id is None else rows.where(F.col("client_id") == client_id)
        return {"alerts": self._rows(rows.orderBy(F.desc("last_occurrence"), "dedupe_key").limit(limit))}

    def _bandwidth_time_series(self, minutes: int, buckets: int) -> dict:
        width = max(1, -(-minutes // buckets)) * MINUTE
        return {"bucket_minutes": width // MINUTE, "buckets": self._rows(S.time_series_rollup(self.minutes, RecordFilter(**self._range(minutes)), width))}
