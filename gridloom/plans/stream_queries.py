"""The ledger stream over the events table."""

import math

from pyspark.sql import functions as F

from gridloom.lineage import scratch_path
from gridloom.plans import fixtures as fx
from gridloom.plans.registry import query
from gridloom.streaming import ledger_stream as ops

FILES = 3


def event_stream(spark, d):
    """Every event delivered twice, in several files and micro-batches, the latest events first.

    A micro-batch takes two of the FILES parts, however many files Spark wrote for them: every batch commits all partitions
    of the state, so their number must not grow with the table.
    """
    path = scratch_path(spark, "events")
    events = fx.table(spark, d, "events")
    span = events.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    part = F.least(F.lit(FILES - 1), F.floor((F.lit(span.hi) - F.col("event_id")) * FILES / F.lit(max(1, span.hi - span.lo))))
    for k in range(FILES):
        events.where(part == k).write.mode("append").parquet(path)
    files = len(spark.read.schema(events.schema).parquet(path).inputFiles())
    gain = F.col("event_type").isin("purchase", "signup")
    delta = F.when(gain, F.floor("value")).when(F.col("event_type") == "error", F.lit(0)).otherwise(-F.floor(F.col("value") / 10))
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, math.ceil(2 * files / FILES))).parquet(path)
    return raw.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("event_id"), F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("warehouse_id"),
        (F.col("event_id") % 96).cast("int").alias("color_key"), F.col("ts").cast("timestamp").alias("created_at"), delta.cast("bigint").alias("delta"),
    )


@query("ledger_stream", "select warehouse_id, ord color_key, cast(sum(delta) as bigint) balance, max(seq) last_seq from fx_ledger group by 1,2")
def ledger_stream(spark, d):
    out = scratch_path(spark, "balances")
    ops.run_ledger_stream(event_stream(spark, d), out, scratch_path(spark, "stream"))
    return ops.current_balances(spark, out)
