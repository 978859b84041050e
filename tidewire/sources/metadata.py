"""The metadata store: small tables with versions, in a folder that all share.

A table is a folder of versions (``v=3``), each written by one Spark job. A version counts once its commit marker is there,
and the newest one is the table: a reader sees a change whole or not at all, and a failed writer leaves nothing that is
read. One writer at a time is assumed, as for any single metadata database; readers never wait. Rows change by whole
tables, which fits what is kept here: a row per segment, rollup part, client, alert or rule.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.filters import RecordFilter

#: name -> (columns, key columns)
TABLES = {
    "segments": ("path string, kind string, tier string, start_ts bigint, end_ts bigint, n_rows bigint, bytes bigint", ("path",)),
    "clients": ("client_id bigint, label string, hostname string, mac string, trusted boolean, note string, first_seen bigint, last_seen bigint", ("client_id",)),
    "client_addresses": ("client_id bigint, address string, valid_from bigint, valid_to bigint", ("client_id", "address", "valid_from")),
    "tags": ("tag_id bigint, name string", ("tag_id",)),
    "client_tags": ("client_id bigint, tag_id bigint", ("client_id", "tag_id")),
    "suppressions": ("id string, rule string, client_id bigint, subject string, hour_from int, hour_to int, expires_at bigint", ("id",)),
    "expectations": ("scope_kind string, scope_value string, kind string, value string, note string, created_at bigint", ("scope_kind", "scope_value", "kind", "value")),
    "rule_config": ("rule string, name string, value string", ("rule", "name")),
    "saved_searches": ("name string, view string, query string, created_at bigint, updated_at bigint", ("view", "name")),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. On one machine alone, without the setting, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Folder:
    """Listing, renaming and deleting through Hadoop's file systems, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def children(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def rename(self, path: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(path), self._path(to)):
            raise OSError(f"cannot rename {path} to {to}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class MetadataStore:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.folder = Folder(spark, self.root)

    def versions(self, table: str) -> list[int]:
        names = [n for n in self.folder.children(f"{self.root}/{table}") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if self.folder.exists(f"{self.root}/{table}/{n}/_SUCCESS"))

    def read(self, table: str) -> DataFrame:
        """The table's newest version; one that was never written is empty."""
        have = self.versions(table)
        if have:
            return self.spark.read.parquet(f"{self.root}/{table}/v={have[-1]}")
        if table not in TABLES:
            raise KeyError(table)
        return self.spark.createDataFrame([], TABLES[table][0])

    def replace(self, table: str, rows: DataFrame) -> None:
        have = self.versions(table)
        new = have[-1] + 1 if have else 1
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{table}/v={new}")
        for old in self.versions(table)[: -self.keep]:
            self.folder.delete(f"{self.root}/{table}/v={old}")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows by key: new ones are added, those of a known key replaced."""
        keys = list(TABLES[table][1])
        old = self.read(table)
        same = None
        for k in keys:
            test = old[k].eqNullSafe(rows[k])
            same = test if same is None else same & test
        self.replace(table, old.join(rows, same, "left_anti").unionByName(rows.select(*old.columns)))

    def delete(self, table: str, where: Column) -> None:
        self.replace(table, self.read(table).where(~F.coalesce(where, F.lit(False))))

    # Rules ----------------------------------------------------------------------------------------------

    def _rows(self, table: str, *rows: dict) -> DataFrame:
        ddl = TABLES[table][0]
        names = [c.split()[0] for c in ddl.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)

    def add_suppression(self, id: str, **clauses) -> None:
        self.upsert("suppressions", self._rows("suppressions", {"id": id, **clauses}))

    def remove_suppression(self, id: str) -> None:
        self.delete("suppressions", F.col("id") == id)

    def suppressions(self, now: int | None = None) -> DataFrame:
        """Those that have not run out."""
        rows = self.read("suppressions")
        return rows if now is None else rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))

    def expect(self, scope_kind: str, scope_value: str, kind: str, value: str, *, note: str = "", at: int | None = None) -> None:
        self.upsert("expectations", self._rows("expectations", {"scope_kind": scope_kind, "scope_value": scope_value, "kind": kind, "value": value, "note": note, "created_at": at}))

    def unexpect(self, scope_kind: str, scope_value: str, kind: str, value: str) -> None:
        self.delete("expectations", (F.col("scope_kind") == scope_kind) & (F.col("scope_value") == scope_value) & (F.col("kind") == kind) & (F.col("value") == value))

    def configure(self, rule: str, **values) -> None:
        """Thresholds of a rule, or enabled=False."""
        self.upsert("rule_config", self._rows("rule_config", *[{"rule": rule, "name": k, "value": json.dumps(v)} for k, v in values.items()]))

    def rule_config(self):
        from tidewire.operators.detect import RuleConfig

        rows = self.read("rule_config").collect()  # some per rule
        values = {(r["rule"], r["name"]): json.loads(r["value"]) for r in rows}
        return RuleConfig({f"{rule}.{name}": v for (rule, name), v in values.items() if name != "enabled"}, tuple(sorted(rule for (rule, name), v in values.items() if name == "enabled" and v is False)))

    # Clients --------------------------------------------------------------------------------------------

    def rename_client(self, client_id: int, label: str) -> None:
        self._change("clients", F.col("client_id") == client_id, label=F.lit(label))

    def annotate_client(self, client_id: int, note: str) -> None:
        self._change("clients", F.col("client_id") == client_id, note=F.lit(note))

    def trust_client(self, client_id: int, trusted: bool = True) -> None:
        self._change("clients", F.col("client_id") == client_id, trusted=F.lit(trusted))

    def tag_client(self, client_id: int, name: str) -> None:
        """Add a tag by its name, which becomes known where it is not."""
        known = self.read("tags").where(F.col("name") == name).select("tag_id").first()
        tag = known["tag_id"] if known else (self.read("tags").agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("n")).first()["n"] + 1)
        if not known:
            self.upsert("tags", self._rows("tags", {"tag_id": tag, "name": name}))
        self.upsert("client_tags", self._rows("client_tags", {"client_id": client_id, "tag_id": tag}))

    def untag_client(self, client_id: int, name: str) -> None:
        tags = [r["tag_id"] for r in self.read("tags").where(F.col("name") == name).collect()]
        self.delete("client_tags", (F.col("client_id") == client_id) & F.col("tag_id").isin(tags))

    def _change(self, table: str, where: Column, **values: Column) -> None:
        rows = self.read(table)
        self.replace(table, rows.withColumns({k: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(k)).cast(dict(rows.dtypes)[k]) for k, v in values.items()}))

    # Searches -------------------------------------------------------------------------------------------

    def save_search(self, name: str, view: str, query: RecordFilter, at: int) -> None:
        """Searches of a view are named; saving one again changes it and leaves its time of creation."""
        old = self.read("saved_searches").where((F.col("view") == view) & (F.col("name") == name)).select("created_at").first()
        body = json.dumps({k: v for k, v in asdict(query).items() if v not in (None, (), [])}, sort_keys=True)
        self.upsert("saved_searches", self._rows("saved_searches", {"name": name, "view": view, "query": body, "created_at": old["created_at"] if old else at, "updated_at": at}))

    def saved_searches(self, view: str) -> dict[str, RecordFilter]:
        """Those of a view, in order of their names; what no longer reads as a search is left out."""
        out = {}
        for r in self.read("saved_searches").where(F.col("view") == view).orderBy("name").collect():
            try:
                fields = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(r["query"]).items()}
                out[r["name"]] = RecordFilter(**fields)
            except (ValueError, TypeError):
                continue
        return out

    def forget_search(self, name: str, view: str) -> None:
        self.delete("saved_searches", (F.col("view") == view) & (F.col("name") == name))

    # Segments -------------------------------------------------------------------------------------------

    def segment_count(self, kind: str | None = None) -> int:
        rows = self.read("segments")
        return (rows if kind is None else rows.where(F.col("kind") == kind)).count()

    def swap_segments(self, gone: list[str], added: DataFrame) -> None:
        """Take members out and put what they became in, as one change."""
        left = self.read("segments").where(~F.col("path").isin(gone))
        self.replace("segments", left.unionByName(added.select(*left.columns)))


def clients_like(clients: DataFrame, text: str) -> DataFrame:
    """Clients whose label, host name, MAC, addresses or tags hold a text, whatever the case; all for an empty one. Latest seen first."""
    rows = clients
    if text.strip():
        hit = F.lit(False)
        for c in ("label", "hostname", "mac", "addresses", "tags"):
            if c in clients.columns:
                hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.strip().lower()))
        rows = rows.where(hit)
    return rows.orderBy(F.desc("last_seen"), "client_id")


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A rollup that is written once per application and source into the shared folder, and read from there by all who ask for it."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _stored or not Folder(spark, _stored[key]).exists(f"{_stored[key]}/_SUCCESS"):
        path = f"{shared_dir(spark)}/rollup-{name}-{hashlib.sha256('|'.join(key).encode()).hexdigest()[:16]}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])
