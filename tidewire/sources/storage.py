"""Segments: layout, manifest, pruning, compaction, ageing, verification and retention.

A segment is a directory of Parquet files written by one job; the manifest is a table with one row for each.
Spark's commit protocol makes a write atomic; a compaction writes first and then swaps manifest rows in one overwrite,
so a reader sees the members or the merged segment, never both.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.filters import FLOWS, RecordFilter
from tidewire.sources.schema import EVENT_SCHEMA, FLOW_SCHEMA

STATS = {"flows": ["src_v4", "dst_v4", "dst_port", "src_client_id", "dst_client_id"], "events": ["dst_port", "src_v4", "severity"]}
TIME = {"flows": ("start_time", "end_time"), "events": ("received_at", "received_at")}
ORDER = {"flows": ["start_time", "src_ip"], "events": ["received_at"]}


def scan(spark: SparkSession, paths: list[str], kind: str = FLOWS) -> DataFrame:
    """Many segments as one relation, columns by name; no segments are an empty relation of the schema."""
    schema = FLOW_SCHEMA if kind == FLOWS else EVENT_SCHEMA
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_segment(df: DataFrame, path: str, kind: str = FLOWS, files: int | None = None) -> None:
    """Sorted within files, so that footers and row groups skip; range-partitioned where several files are wanted."""
    order = ORDER[kind]
    rows = df.repartitionByRange(files, *order) if files and files > 1 else df if files is None else df.coalesce(1)
    rows.sortWithinPartitions(*order).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_by_day(df: DataFrame, path: str, kind: str = FLOWS) -> None:
    """The day layout: partitioned by UTC date of the time column, appended to."""
    day = F.to_date(F.timestamp_micros(TIME[kind][0]))
    df.withColumn("date", day).repartition("date").sortWithinPartitions(*ORDER[kind]).write.mode("append").option("compression", "zstd").partitionBy("date").parquet(path)


def segment_manifest(df: DataFrame, segment: str, start: str, end: str, stats: list[str]) -> DataFrame:
    """Rows, time range, and least and greatest value of the columns worth pruning by, for each segment."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(start).alias("start_ts"), F.max(end).alias("end_ts")]
    for c in stats:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.groupBy(segment).agg(*aggs)


def _segment_stats(spark: SparkSession, path: str, kind: str) -> DataFrame:
    start, end = TIME[kind]
    # The files' own schema: a footer's columns are taken by their place in it.
    segment = spark.read.parquet(path)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(start).alias("start_ts"), F.max(end).alias("end_ts")]
    for c in STATS[kind]:
        aggs += [(f(c) if c in segment.columns else F.lit(None)).cast("bigint").alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max))]
    return segment.agg(*aggs).withColumn("path", F.lit(path))


def footer_manifest(spark: SparkSession, paths: list[str], kind: str = FLOWS) -> DataFrame:
    """The manifest of segments, out of their footers: counts, minima and maxima are pushed into the Parquet scan. Of a
    segment with a column that has no statistics (one of nulls alone), the columns of the manifest are read."""
    names = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": ""}
    before = {k: spark.conf.get(k, None) for k in names}

    def collect(some: list[str]) -> list:
        rows = _segment_stats(spark, some[0], kind)
        for path in some[1:]:
            rows = rows.unionByName(_segment_stats(spark, path, kind))
        return rows.collect()  # a row for each segment

    found, plain = [], []
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        for a in range(0, len(paths), 50):
            try:
                found += collect(paths[a : a + 50])
            except Py4JJavaError as e:
                if "No min/max found" not in str(e):
                    raise
                plain += paths[a : a + 50]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for a in range(0, len(plain), 50):
        found += collect(plain[a : a + 50])
    ddl = ", ".join(["n_rows bigint, start_ts bigint, end_ts bigint", *[f"min_{c} bigint, max_{c} bigint" for c in STATS[kind]], "path string"])
    return spark.createDataFrame([tuple(r) for r in found], ddl)


def merge_stats(manifest: DataFrame, by: list[str]) -> DataFrame:
    """The statistics of merged segments out of those of their members: counts and bytes add up, minima and maxima carry over.

    A member without a minimum has none of that column to prune by, so the merged segment has none either."""
    aggs = []
    for c in manifest.columns:
        if c in ("n_rows", "bytes"):
            aggs.append(F.sum(c).alias(c))
        elif c in ("start_ts", "end_ts"):
            aggs.append((F.min if c == "start_ts" else F.max)(c).alias(c))
        elif c.startswith(("min_", "max_")):
            whole = F.count(c) == F.count(F.lit(1))
            aggs.append(F.when(whole, (F.min if c.startswith("min_") else F.max)(c)).alias(c))
    return manifest.groupBy(*by).agg(*aggs)


def candidate_segments(manifest: DataFrame, f: RecordFilter, kind: str = FLOWS) -> DataFrame:
    """Segments that can hold a matching row; missing statistics never exclude one."""
    from tidewire.functions.netaddr import v4_range

    out = manifest
    if f.start is not None:
        out = out.where(F.col("end_ts") >= f.start)
    if f.end is not None:
        out = out.where(F.col("start_ts") <= f.end)

    def may(column: str, lo: int, hi: int):
        if f"min_{column}" not in manifest.columns:
            return F.lit(True)
        return F.col(f"min_{column}").isNull() | ((F.col(f"min_{column}") <= hi) & (F.col(f"max_{column}") >= lo))

    if f.ports:
        hit = F.lit(False)
        for p in f.ports:
            hit = hit | may("dst_port", p, p)
        out = out.where(hit)
    for ip, columns in ((f.any_ip, ("src_v4", "dst_v4")), (f.src_ip, ("src_v4",)), (f.dst_ip, ("dst_v4",)), (f.prefix, ("src_v4", "dst_v4"))):
        if ip and ":" not in ip:
            hit = F.lit(False)
            for c in columns:
                hit = hit | may(c, *v4_range(ip))
            out = out.where(hit)
    if f.client_id is not None:
        out = out.where(may("src_client_id", f.client_id, f.client_id) | may("dst_client_id", f.client_id, f.client_id))
    return out


def compaction_plan(manifest: DataFrame, now: int, *, tier: str = "minute", grace: int = 300_000_000) -> DataFrame:
    """Groups of finished segments (path, tier, kind, start_ts) of one tier that make up a unit of the next: two or more."""
    width = {"minute": 3_600_000_000, "hour": 86_400_000_000}[tier]
    unit = F.col("start_ts") - F.col("start_ts") % width
    rows = manifest.where((F.col("tier") == tier) & (unit + width + grace <= now))
    return rows.groupBy("kind", unit.alias("unit")).agg(F.array_sort(F.collect_list("path")).alias("members"), F.sum("n_rows").alias("n_rows")).where(F.size("members") >= 2)


#: Rows of a file of a merged segment.
FILE_ROWS = 5_000_000


def compact(spark: SparkSession, members: list[str], target: str, kind: str = FLOWS) -> int:
    """Merge members into one sorted segment of as many files as its rows need; fails when a row is lost. Returns the rows.

    Rows are counted from footers, without reading a column."""
    rows = scan(spark, members, kind)
    before = rows.count()
    write_segment(rows, target, kind, files=max(1, -(-before // FILE_ROWS)))
    after = scan(spark, [target], kind).count()
    if before != after:
        raise RuntimeError(f"{target} has {after} rows of {before}")
    return after


def segment_rows(store, paths: list[str], kind: str, tier: str) -> DataFrame:
    """Rows of the store's segment table for complete segments, out of their footers."""
    sizes = [(p, store.folder.size(p)) for p in paths]
    sized = store.spark.createDataFrame(sizes, "path string, bytes bigint")
    found = footer_manifest(store.spark, paths, kind).join(sized, "path")
    return found.select("path", F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), "start_ts", "end_ts", "n_rows", "bytes")


def compact_and_swap(store, members: list[str], target: str, kind: str = FLOWS, tier: str = "hour") -> int:
    """Compact, put the merged segment into the manifest in place of its members in one change, and only then delete them.

    Stopped before the change, readers still see the members and ``recover`` finds the target as an orphan."""
    n = compact(store.spark, members, target, kind)
    store.swap_segments(members, segment_rows(store, [target], kind, tier))
    for m in members:
        store.folder.delete(m)
    return n


def enforce_retention(store, budget: dict[str, int], *, target: float = 0.97) -> list[str]:
    """Give up the segments that the plan names: first in the manifest, then on disk. Returns their paths."""
    manifest = store.read("segments").withColumn("segment", F.col("path"))
    gone = [r["segment"] for r in retention_plan(manifest, budget, target=target).collect()]  # a row per segment
    if gone:
        store.swap_segments(gone, store.read("segments").limit(0))
        for path in gone:
            store.folder.delete(path)
    return gone


def recover(store, root: str, kind: str = FLOWS, tier: str = "minute") -> dict[str, list[str]]:
    """Bring manifest and folder into agreement: segments that were never finished, or whose rows differ from the
    manifest's, go to quarantine; finished ones that the manifest lacks are added; rows without a segment are removed."""
    on_disk = [f"{root}/{n}" for n in store.folder.children(root) if not n.startswith(("_", "."))]
    whole = [p for p in on_disk if store.folder.exists(f"{p}/_SUCCESS")]
    known = {r["path"]: r["n_rows"] for r in store.read("segments").where(F.col("kind") == kind).collect()}
    rows = {r["path"]: r["n_rows"] for r in footer_manifest(store.spark, whole, kind).collect()} if whole else {}
    corrupt = [p for p in whole if p in known and known[p] != rows[p]]
    partial = [p for p in on_disk if p not in whole]
    for p in (*partial, *corrupt):
        store.folder.rename(p, f"{root}/_quarantine/{p.rsplit('/', 1)[1]}")
    missing = [p for p in known if p.startswith(f"{root}/") and p not in on_disk]
    healed = [p for p in whole if p not in known]
    if missing or corrupt or partial or healed:
        added = segment_rows(store, healed, kind, tier) if healed else store.read("segments").limit(0)
        store.swap_segments([*missing, *corrupt, *partial], added)
    return {"quarantined": sorted([*partial, *corrupt]), "missing": sorted(missing), "healed": sorted(healed)}


def strip_raw(events: DataFrame, *, keep_unparsed: bool = False) -> DataFrame:
    """Events without their raw text; all else stays. Optionally unparsed events keep theirs."""
    drop = F.col("parse_status") > 0 if keep_unparsed else F.lit(True)
    return events.withColumns({"raw": F.when(~drop, F.col("raw")), "raw_bytes": F.when(~drop, F.col("raw_bytes"))})


def retention_plan(manifest: DataFrame, budget: dict[str, int], *, target: float = 0.97) -> DataFrame:
    """Segments (kind, segment, start_ts, bytes) to give up: oldest first, per kind, until it is below target share of
    its budget. A plan changes nothing. The manifest has a row per segment, and running sums are per kind."""
    from pyspark.sql import Window

    limits = [F.lit(x) for kv in budget.items() for x in kv]
    limit = F.try_element_at(F.create_map(*limits), F.col("kind"))
    every = Window.partitionBy("kind")
    before = F.coalesce(F.sum("bytes").over(every.orderBy("start_ts", "segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = manifest.withColumns({"limit": limit, "total": F.sum("bytes").over(every), "before": before})
    return rows.where((F.col("total") > F.col("limit")) & (F.col("total") - F.col("before") > F.col("limit") * target)).drop("limit", "total", "before")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): ok, missing (in the manifest alone), orphan (on disk alone) or corrupt (other row count)."""
    m, f = manifest.select("path", F.col("n_rows").alias("m")), files.select("path", F.col("n_rows").alias("f"))
    both = m.join(f, "path", "full")
    status = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "orphan").when(F.col("m") != F.col("f"), "corrupt").otherwise("ok")
    return both.select("path", status.alias("status"))


def usage(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("kind").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.min("start_ts").alias("oldest"), F.max("end_ts").alias("newest"))


def retention_days(usage_table: DataFrame, budget: dict[str, int]) -> DataFrame:
    """Days that the budget lasts at the rate of what is stored."""
    limits = F.create_map(*[F.lit(x) for kv in budget.items() for x in kv])
    days = (F.col("newest") - F.col("oldest")) / 86_400_000_000.0
    return usage_table.select("kind", (F.try_element_at(limits, F.col("kind")) / (F.col("bytes") / F.greatest(days, F.lit(1 / 24)))).alias("days"))
