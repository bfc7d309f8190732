"""The analysis queue: top-k, batches, enqueueing of what isn't waiting yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import batched
from .tables import one_per_key


def entries(queue: DataFrame) -> DataFrame:
    """One row per queue id, with a trimmed, lower-cased status."""
    one = one_per_key(queue, ["id"], [F.col("processed_at").desc_nulls_last(), F.col("status")])
    return one.withColumn("status", F.lower(F.trim("status")))


def _order():
    return [F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id").asc()]


def next_pending(queue: DataFrame, limit: int = 10) -> DataFrame:
    return entries(queue).where("status = 'pending'").orderBy(*_order()).limit(limit)


def pending_batches(queue: DataFrame, size: int = 8) -> DataFrame:
    """All waiting entries with their rank in the queue and the number of their batch."""
    return batched(entries(queue).where("status = 'pending'"), _order(), size)


def to_enqueue(functions: DataFrame, queue: DataFrame) -> DataFrame:
    """(function_id, priority, reason): functions never analysed that aren't waiting yet."""
    waiting = entries(queue).where("status = 'pending'").select("function_id")
    new = functions.where("semantic_analyzed_at IS NULL").select(F.col("id").alias("function_id"), "is_exported")
    return new.join(waiting, "function_id", "left_anti").select("function_id", F.when(F.col("is_exported"), 6).otherwise(1).alias("priority"), F.lit("unanalyzed").alias("reason"))


def processed(queue: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """The queue with the entries of `done` (id, at) set to `status` and stamped."""
    stamp = done.select("id", F.col("at").alias("_at"))
    joined = queue.join(stamp, "id", "left")
    return joined.withColumns({"status": F.when(F.col("_at").isNotNull(), status).otherwise(F.col("status")), "processed_at": F.coalesce("_at", "processed_at")}).select(*queue.columns)
