"""Collection health: sources, silence, counters, queues, gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("source_ip").agg(F.count(F.lit(1)).alias("messages"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"))


def silent_sources(events: DataFrame, now: int, silence: int = 300_000_000) -> DataFrame:
    return events.groupBy("source_ip").agg(F.max("received_at").alias("last_seen")).where(now - F.col("last_seen") > silence)


def counter_deltas(samples: DataFrame, key: str, order: list[str], counter: str, back: int = 10) -> DataFrame:
    """Change of a counter and of time over the last ``back`` samples; without that many there is no rate."""
    w = Window.partitionBy(key).orderBy(*order)
    out = samples.withColumns({"dn": F.col(counter) - F.lag(counter, back).over(w), "dt": F.col(order[0]) - F.lag(order[0], back).over(w)})
    return out.where(F.col("dn").isNotNull())


def rates(samples: DataFrame, key: str, order: list[str], counter: str, back: int = 10) -> DataFrame:
    d = counter_deltas(samples, key, order, counter, back)
    return d.withColumn("per_second", F.when(F.col("dt") > 0, F.col("dn") * 1_000_000.0 / F.col("dt")))


def queue_alarms(samples: DataFrame, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """(source, at, fill) with an alarm that rises above ``high`` and falls at or below ``low`` only."""
    mark = F.when(F.col("fill") > high, 1).when(F.col("fill") <= low, 0)
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("alarm", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1)


def gaps_from_heartbeats(beats: DataFrame, most: int) -> DataFrame:
    """Collection gaps (source, start_ts, end_ts) where two heartbeats are further apart than ``most``; the last is open."""
    w = Window.partitionBy("source").orderBy("at")
    rows = beats.withColumn("next", F.lead("at").over(w))
    return rows.where(F.col("next").isNull() | (F.col("next") - F.col("at") > most)).select("source", F.col("at").alias("start_ts"), F.col("next").alias("end_ts"))


def admission(samples: DataFrame, pause_below: int, resume_above: int) -> DataFrame:
    """(at, free) with whether ingestion is paused: below one mark until above the other."""
    mark = F.when(F.col("free") < pause_below, 1).when(F.col("free") >= resume_above, 0)
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("paused", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1)


@dataclass(frozen=True)
class Budget:
    """Storage shares; they must fit."""

    total: int
    flows: int
    events: int
    rollups: int

    def __post_init__(self):
        if min(self.total, self.flows, self.events, self.rollups) < 0:
            raise ValueError("a budget cannot be negative")
        if self.flows + self.events + self.rollups > self.total:
            raise ValueError("the shares exceed the total")
