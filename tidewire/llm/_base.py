"""Shared plumbing of the training-data operators: cutting lineage and plain input projections."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only on one machine alone (a local master, as in tests), where the session has none, is a folder of our own made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder, in the shared one, of all tables that this application writes on its way."""
    return f"{shared_dir(spark)}/tidewire-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written on its way. Results that were not stored elsewhere read from them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: How such tables are written and read. In a folder that is mounted ("file:"), Hadoop lays a checksum file beside each file and
#: starts a process of chmod for each of the two, which shares the memory of the executor's JVM until it runs, and so is seen
#: to double it. Without that file there is one process less; the checksums are those of Parquet's pages.
WRITTEN = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
READ = {"parquet.page.verify-checksum.enabled": "true"}
#: Rows that a file of a narrow table holds at least, where a bound of its rows is known.
FILE_ROWS = 100_000


def table(df: DataFrame, name: str, *, partition_by: str | None = None, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    ``rows`` is a bound of its rows, if one is known: a small table then goes to few files, whatever the number of
    shuffle partitions; with many rows the bound asks for more files than there are partitions and changes nothing.

    Cuts the lineage so that a lost executor costs a re-read and not a re-computation, and makes the
    read side of a later join a plain scan, whose exchange adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // file_rows)))
    writer = df.write.options(**WRITTEN)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(nullable).options(**READ).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (a double underscore stands for a dot) for the jobs that run inside; put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def agreed_labels(labels: DataFrame) -> DataFrame:
    """(id, label) of ids that have one label, 0 or 1; null ids and ids with labels that differ are left out."""
    known = labels.where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    return known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
