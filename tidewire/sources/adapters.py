"""Flow and event views over relational tables, so that every query can run on any lineitem/events pair.

Identifiers are hashes of the row's key columns: unlike a running number they need neither a sort nor a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.labels import service_name

MICROS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hash_id(*columns: str) -> Column:
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per line item."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 4, F.col("n_name")).alias("dst_country"))
    li = read(spark, sf_dir, "lineitem")
    day = micros(F.col("l_shipdate"))
    second = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729, F.lit(86400))
    base = li.select(
        hash_id("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("flow_id"),
        F.when(F.col("l_orderkey") % 16 == 7, 1).otherwise(0).cast("smallint").alias("origin"),
        F.concat(F.lit("10.255.0."), F.pmod("l_orderkey", F.lit(4)).cast("string")).alias("exporter_addr"),
        (day + second * MICROS).alias("start_time"),
        (day + second * MICROS + F.col("l_quantity").cast("bigint") * MICROS).alias("end_time"),
        (F.lit(10 * 16777216) + F.col("l_suppkey")).cast("bigint").alias("src_v4"),
        (F.lit(203 * 16777216) + F.pmod("l_partkey", F.lit(16777216))).cast("bigint").alias("dst_v4"),
        F.concat_ws(".", F.lit("10.0"), F.expr("l_suppkey div 256").cast("string"), F.pmod("l_suppkey", F.lit(256)).cast("string")).alias("src_ip"),
        F.concat_ws(".", F.lit("203"), F.expr("(l_partkey div 65536) % 256").cast("string"), F.expr("(l_partkey div 256) % 256").cast("string"), F.expr("l_partkey % 256").cast("string")).alias("dst_ip"),
        (F.lit(1024) + F.pmod("l_orderkey", F.lit(60000))).cast("int").alias("src_port"),
        F.pmod("l_partkey", F.lit(1024)).cast("int").alias("dst_port"),
        F.when(F.col("l_linestatus") == "O", 6).otherwise(17).cast("smallint").alias("protocol"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3).cast("smallint").alias("direction"),
        F.col("l_quantity").cast("bigint").alias("packets"),
        F.round("l_extendedprice").cast("bigint").alias("octets"),
        F.col("l_suppkey").cast("bigint").alias("src_client_id"),
        F.when(F.col("l_returnflag") != "A", F.pmod("l_partkey", F.lit(500))).cast("bigint").alias("dst_client_id"),
        (F.lit(64512) + F.pmod("l_partkey", F.lit(31))).cast("bigint").alias("dst_asn"),
        (F.lit(10) + F.pmod("l_suppkey", F.lit(5))).cast("int").alias("src_vlan"),
        (F.lit(10) + F.pmod("l_partkey", F.lit(5))).cast("int").alias("dst_vlan"),
        F.when(F.col("l_linestatus") == "O", F.expr("shiftleft(1, cast(l_linenumber % 6 as int))")).otherwise(0).cast("int").alias("tcp_flags"),
        (F.lit(1) + F.pmod("l_orderkey", F.lit(2)) * 9).cast("bigint").alias("sampling_interval"),
        F.lit(1).cast("bigint").alias("flow_count"),
        F.pmod("l_partkey", F.lit(25)).cast("int").alias("_nation"),
    )
    # The nation table has a fixed 25 rows.
    named = base.join(F.broadcast(nation), F.col("_nation") == F.col("n_nationkey"), "left").drop("_nation", "n_nationkey")
    return named.withColumn("service", service_name(F.col("src_port"), F.col("dst_port"), F.col("protocol")))


FLOWS_SQL = """
flows AS (
  SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)), 1, 15))::BIGINT AS flow_id,
         CASE WHEN l_orderkey % 16 = 7 THEN 1 ELSE 0 END::SMALLINT AS origin, '10.255.0.' || (l_orderkey % 4) AS exporter_addr,
         epoch_us(l_shipdate) + ((l_orderkey * 7919 + l_linenumber * 104729) % 86400) * 1000000 AS start_time,
         epoch_us(l_shipdate) + ((l_orderkey * 7919 + l_linenumber * 104729) % 86400) * 1000000 + CAST(l_quantity AS BIGINT) * 1000000 AS end_time,
         (10 * 16777216 + l_suppkey)::BIGINT AS src_v4, (203::BIGINT * 16777216 + l_partkey % 16777216)::BIGINT AS dst_v4,
         '10.0.' || (l_suppkey // 256) || '.' || (l_suppkey % 256) AS src_ip,
         '203.' || ((l_partkey // 65536) % 256) || '.' || ((l_partkey // 256) % 256) || '.' || (l_partkey % 256) AS dst_ip,
         (1024 + l_orderkey % 60000)::INTEGER AS src_port, (l_partkey % 1024)::INTEGER AS dst_port,
         CASE WHEN l_linestatus = 'O' THEN 6 ELSE 17 END AS protocol,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS direction,
         CAST(l_quantity AS BIGINT) AS packets, CAST(round(l_extendedprice) AS BIGINT) AS octets,
         l_suppkey::BIGINT AS src_client_id, CASE WHEN l_returnflag <> 'A' THEN l_partkey % 500 END::BIGINT AS dst_client_id,
         (64512 + l_partkey % 31)::BIGINT AS dst_asn, (10 + l_suppkey % 5)::INTEGER AS src_vlan, (10 + l_partkey % 5)::INTEGER AS dst_vlan,
         CASE WHEN l_linestatus = 'O' THEN 1 << (l_linenumber % 6) ELSE 0 END::INTEGER AS tcp_flags,
         (1 + (l_orderkey % 2) * 9)::BIGINT AS sampling_interval, 1::BIGINT AS flow_count,
         CASE WHEN n_regionkey <> 4 THEN n_name END AS dst_country
  FROM lineitem LEFT JOIN nation ON n_nationkey = l_partkey % 25
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One security event per row of ``events``."""
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    at = micros(F.col("ts"))
    kind = F.col("event_type")
    out = ev.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.lit(0).cast("smallint").alias("origin"),
        at.alias("received_at"),
        F.when(F.col("event_id") % 10 != 0, at - F.pmod("event_id", F.lit(5)) * MICROS).alias("event_time"),
        F.concat_ws(".", F.lit("10.0"), F.expr("user_id div 256").cast("string"), F.expr("user_id % 256").cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.1."), F.pmod(k, F.lit(20)).cast("string")).alias("dst_ip"),
        (F.lit(10 * 16777216) + F.col("user_id")).cast("bigint").alias("src_v4"),
        k.alias("dst_port"),
        F.when(kind.isin("view", "click"), 6).when(kind == "signup", 3).when(kind == "purchase", 1).otherwise(2).cast("smallint").alias("event_type"),
        F.when(kind == "error", 2).otherwise(1).cast("smallint").alias("action"),
        F.pmod("event_id", F.lit(8)).cast("smallint").alias("severity"),
        F.concat_ws(" ", kind, F.col("props")).alias("message"),
        F.concat(F.lit("RULE-"), F.pmod(k, F.lit(7)).cast("string")).alias("rule_name"),
        F.concat(F.lit("host-"), F.pmod("user_id", F.lit(5)).cast("string")).alias("hostname"),
        F.when(kind == "error", F.concat(F.lit("ET SCAN probe "), k.cast("string"))).alias("ids_signature"),
        (F.lit(1) + F.pmod(k, F.lit(4))).cast("smallint").alias("ids_severity"),
        F.col("user_id").cast("bigint").alias("src_client_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("octets"),
    )
    return out.withColumn("effective_time", F.coalesce("event_time", "received_at"))


EVENTS_SQL = """
evs AS (
  SELECT event_id::BIGINT AS event_id, 0::SMALLINT AS origin, epoch_us(ts) AS received_at,
         CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) - (event_id % 5) * 1000000 END AS event_time,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
         '192.168.1.' || (k % 20) AS dst_ip, (10 * 16777216 + user_id)::BIGINT AS src_v4, k AS dst_port,
         CASE WHEN event_type IN ('view', 'click') THEN 6 WHEN event_type = 'signup' THEN 3 WHEN event_type = 'purchase' THEN 1 ELSE 2 END AS event_type,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS action, (event_id % 8)::SMALLINT AS severity,
         event_type || ' ' || props AS message, 'RULE-' || (k % 7) AS rule_name, 'host-' || (user_id % 5) AS hostname,
         CASE WHEN event_type = 'error' THEN 'ET SCAN probe ' || k END AS ids_signature, (1 + k % 4)::SMALLINT AS ids_severity,
         user_id::BIGINT AS src_client_id, CAST(round(value * 100) AS BIGINT) AS octets,
         coalesce(CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) - (event_id % 5) * 1000000 END, epoch_us(ts)) AS effective_time
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
