"""Incremental forms of three batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from chainwright.functions.sequence import date_gate


def resolved_counters(stream: DataFrame, keys: Sequence[str], resolved: Column) -> DataFrame:
    """Running rows and resolved rows per key; state is one pair of counters per key (update mode)."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("residues"), F.count_if(resolved).alias("resolved"))


def ingest_if_absent(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str, path: str) -> DataStreamWriter:
    """Append rows whose key the table does not hold.

    Duplicates inside the watermark are dropped in state; older ones by an anti-join
    against the table.  Each batch writes its own folder, so a batch repeated after
    a failure replaces its own output instead of adding to it.
    """
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        if number > 0:
            held = spark.read.parquet(path).where(F.col("batch") != number)
            new = new.join(held.select(*keys), list(keys), "left_anti")
        new.write.mode("overwrite").parquet(target)

    return once.writeStream.foreachBatch(write)


def leakage_gate(stream: DataFrame, targets: DataFrame, key: str, release: str, cutoff: str) -> DataFrame:
    """Arriving rows joined to static cutoffs; only rows strictly before their cutoff pass."""
    return stream.join(targets, key).where(date_gate(F.col(release), F.col(cutoff)))
