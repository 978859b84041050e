"""Exact deduplication over a log-structured merge index of text digests.

Texts are equal when identical after lower-casing A-Z; null counts as empty. One scan of the documents
appends (id, digest) to a log. The log's rows are dealt to memtables; each memtable is aggregated and
flushed as a run: Parquet files sorted by digest, with Parquet Bloom filters and footer ranges on the
digest, holding per digest the kept identifier and the number of rows. When enough runs of a level are
there, they are merged into one run of the next level, keeping the preferred identifier and adding the
counts; the merge is associative, so the order of flushes does not matter. Digests that more than one row
hit are verified on bytes: the smallest and the largest text of each are aggregated map-side and compared;
a digest with two texts is resolved on the texts themselves.

All of it is DataFrame work. A digest that a third of all rows share costs one row per task in every
aggregation; the final join of the log with the index scans both sides from files, so that adaptive
execution can split the hot digest.

Defined results: rows of null id take part and come last in preference; repeated ids count as rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm._base import FILE_ROWS, READ, WRITTEN, ascii_lower, fresh_dir, settings, table

#: A key with at least one in HOT_SHARE of all rows is hot.
HOT_SHARE = 1000
RUN_SCHEMA = "key binary, keep_id bigint, group_size bigint"


class DigestIndex:
    """Sorted runs of (key, keep_id, group_size) in levels under one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, fanout: int = 4, keep: str = "largest"):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.path, self.fanout = spark, path or fresh_dir(spark, "digests"), fanout
        self._best: Callable[[str], Column] = F.max if keep == "largest" else F.min
        self.levels: dict[int, list[str]] = {}
        self.rows: dict[str, int | None] = {}
        self._written = 0

    def _write(self, run: DataFrame, level: int, rows: int | None) -> None:
        path = f"{self.path}/level-{level}/run-{self._written:05d}"
        self._written += 1
        merged = run.groupBy("key").agg(self._best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        if rows is not None:
            merged = merged.coalesce(max(1, -(-rows // FILE_ROWS)))
        merged.sortWithinPartitions("key").write.options(**WRITTEN).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "100000").parquet(path)
        self.levels.setdefault(level, []).append(path)
        self.rows[path] = rows

    def _bound(self, runs: list[str]) -> int | None:
        sizes = [self.rows[p] for p in runs]
        return None if None in sizes else sum(sizes)

    def flush(self, memtable: DataFrame, rows: int | None = None) -> None:
        """Flush a memtable of (key, keep_id) rows, then compact whatever level has become full.

        ``rows`` is a bound of the memtable's rows, if known: small runs are then few files."""
        self._write(memtable.select("key", "keep_id", F.lit(1).cast("bigint").alias("group_size")), 0, rows)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        runs = self.levels.pop(level)
        self._write(self.spark.read.schema(RUN_SCHEMA).options(**READ).parquet(*runs), level + 1, self._bound(runs))

    def compact_all(self) -> None:
        """Merge every run into one."""
        runs = [p for level in sorted(self.levels) for p in self.levels[level]]
        if len(runs) > 1:
            top = max(self.levels) + 1
            self.levels = {}
            self._write(self.spark.read.schema(RUN_SCHEMA).options(**READ).parquet(*runs), top, self._bound(runs))

    def entries(self) -> DataFrame:
        """One row per key (after a full merge, a plain scan)."""
        self.compact_all()
        paths = [p for runs in self.levels.values() for p in runs]
        return self.spark.read.schema(RUN_SCHEMA).options(**READ).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def get(self, *keys: bytes) -> DataFrame:
        """Point look-up: footers and Bloom filters skip the files and row groups without the keys."""
        paths = [p for runs in self.levels.values() for p in runs]
        found = self.spark.read.schema(RUN_SCHEMA).options(**READ).parquet(*paths).where(F.col("key").isin([bytearray(k) for k in keys]))
        return found.groupBy("key").agg(self._best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "largest", memtables: int = 4, fanout: int = 4, key_bytes: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``key_bytes`` is how much of the digest the index stores; fewer bytes make it smaller and leave more
    to the verification of bytes, never a wrong result.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("body"))
    hashed = source.select("id", "body", F.unhex(F.sha2("body", 256)).alias("digest"))
    # A spread over memtables by digest would make each run's keys its own; by id, runs overlap as they do
    # when batches arrive over time, and the merge has work to do.
    log = table(hashed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int").alias("memtable")), "digest-log", partition_by="memtable")
    rows = log.withColumn("key", F.substring("digest", 1, key_bytes) if key_bytes < 32 else F.col("digest"))
    index = DigestIndex(spark, fanout=fanout, keep=keep)
    total = log.count()
    for i in range(memtables):
        index.flush(rows.where(F.col("memtable") == i).select("key", F.col("id").alias("keep_id")), total)
    entries = index.entries()

    # Verification on bytes of what was hit more than once. Keys with a thousandth of all rows or more (so, a
    # thousand at most) are known everywhere: their rows become one per task before anything is shuffled. The rows of
    # the other keys are shuffled, once a Bloom filter of these keys has dropped the rest of the corpus.
    hits = entries.where(F.col("group_size") > 1)
    hot, light = hits.where(F.col("group_size") * HOT_SHARE >= total).select("key"), hits.where(F.col("group_size") * HOT_SHARE < total).select("key")
    body = hashed.select("id", "body", "digest", (F.substring("digest", 1, key_bytes) if key_bytes < 32 else F.col("digest")).alias("key"))
    span = lambda rows: rows.groupBy("key").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    with settings(spark, spark__sql__optimizer__runtime__bloomFilter__enabled="true", spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="1g"):
        spans = span(body.join(light, "key", "left_semi")).unionByName(span(body.join(F.broadcast(hot), "key", "left_semi")))
        mixed = table(spans.where(F.col("least") != F.col("most")).select("key"), "mixed-keys", rows=total)
    joined = rows.select("id", "digest", "key").join(entries, "key")
    if not mixed.isEmpty():
        best = F.max if keep == "largest" else F.min
        apart = table(body.join(mixed, "key", "left_semi"), "mixed-bodies")
        own = table(apart.groupBy("body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "mixed-groups")
        columns = ["id", "digest", "keep_id", "group_size"]
        joined = joined.join(mixed, "key", "left_anti").select(columns).unionByName(apart.join(own, "body").select(columns))
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
