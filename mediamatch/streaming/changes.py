"""Index maintenance from a stream of uploads and deletions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from mediamatch.operators import index as ix
from mediamatch.plans.store import IndexStore
from mediamatch.session import checkpointed

# Takes the uploads of a batch (attachment_id, ts, ...) and returns their built index rows.
Build = Callable[[DataFrame], DataFrame]


#: Local property in which Spark names the query that calls `foreachBatch`; the id lives in the query's checkpoint.
_QUERY_ID = "sql.streaming.queryId"


class Stalled(RuntimeError):
    """A batch of uploads in which not one image could be indexed."""


def _counted(changes: DataFrame) -> DataFrame:
    """Last change per attachment, without probe uploads."""
    return ix.latest_per_key(changes.where(~((F.col("action") == "upload") & F.coalesce("is_probe", F.lit(False)))))


def _not_older(last: DataFrame, stored: DataFrame) -> DataFrame:
    """Changes that are not older than the stored row or tombstone of their key: later, or at its time and of no lower
    sequence number. A stored row without a number gives way at its own time."""
    seq = F.col("seq") if "seq" in stored.columns else F.lit(None).cast("long")
    times = stored.select("attachment_id", F.col("indexed_at").alias("stored_at"), seq.alias("stored_seq"))
    same_time = (F.col("ts") == F.col("stored_at")) & F.coalesce(F.col("seq") >= F.col("stored_seq"), F.lit(True))
    fresh = F.col("stored_at").isNull() | (F.col("ts") > F.col("stored_at")) | same_time
    return last.join(times, "attachment_id", "left").where(fresh).drop("stored_at", "stored_seq")


def effective_changes(changes: DataFrame, index: DataFrame) -> DataFrame:
    """Last change per attachment, without probe uploads and without changes older than the stored row."""
    return _not_older(_counted(changes), index)


def apply_changes(index: DataFrame, changes: DataFrame, build: Build) -> DataFrame:
    """The index after a batch of changes."""
    last = effective_changes(changes, index)
    kept = ix.delete_keys(index, last.where(F.col("action") == "delete"))
    return ix.merge_built(kept, build(last.where(F.col("action") == "upload")))


@dataclass
class ChangeStream:
    """Applies each micro-batch of a change stream to an index store.

    The source bounds a micro-batch (files or offsets per trigger). Each batch appends one delta: rows of
    its uploads, bad images among them as failed rows, and tombstones of its deletions. A batch of uploads
    without a single success stops the stream, after its failures and deletions were written. A batch
    that was written is not applied again, so a restart goes on behind it. A change that arrives late does
    not undo a newer one, deletions included.

    Batches are known by the id of the streaming query, which lives in its checkpoint, so several streams may
    write to one store, and a new checkpoint reads its source again: the changes it repeats have no effect.
    """

    store: IndexStore
    build: Build
    stats_path: str | None = None

    def apply(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        """Apply a batch of the stream, by default the query that is running."""
        stream = stream or batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID) or "direct"
        if self.store.recorded(batch_id, stream):
            return
        last = checkpointed(_counted(batch))
        # The only join with the index: its rows, tombstones included, of the keys in this batch.
        touched = checkpointed(self.store.rows().join(last.select(ix.KEY), ix.KEY, "left_semi"))
        fresh = checkpointed(_not_older(last, touched))
        built = checkpointed(self.build(fresh.where(F.col("action") == "upload")))
        deletes = fresh.where(F.col("action") == "delete")
        old = touched.where(~F.col("deleted")).drop("deleted", "seq")
        stats = built.agg(
            F.count("*").alias("done"), F.count_if(F.col("error_code") == "").alias("succeeded")
        ).first()
        deleted = ix.deleted_count(old, deletes).first()["deleted"]
        replaced = old.join(built.select(ix.KEY), ix.KEY, "left_semi")
        if self.stats_path:
            row = (batch_id, stats["done"], stats["succeeded"], deleted)
            batch.sparkSession.createDataFrame(
                [row], "batch_id long, done long, succeeded long, deleted long"
            ).write.mode("overwrite").parquet(f"{self.stats_path}/stream={stream}/batch_id={batch_id}")
        numbers = fresh.select(ix.KEY, "seq")
        self.store.append(ix.merge_built(replaced, built).join(numbers, ix.KEY, "left"), deletes, batch_id, stream)
        if stats["done"] and not stats["succeeded"]:
            raise Stalled(f"none of {stats['done']} uploads in batch {batch_id} could be indexed")

    def start(self, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def progress(self) -> DataFrame:
        """One row per applied batch of each stream; `stalled` marks those that stopped it."""
        counts = self.store.spark.read.parquet(self.stats_path).select("stream", "batch_id", "done", "succeeded", "deleted")
        return counts.withColumn("stalled", (F.col("done") > 0) & (F.col("succeeded") == 0))
