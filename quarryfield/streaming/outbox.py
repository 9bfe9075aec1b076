"""The outbox as a stream: entries whose typed values are to be filled in later.

The queue is a folder of Parquet files with entry ids.  ``availableNow`` reads what is there;
the stream's checkpoint stands for cursors, leases and row locks.  Each micro-batch joins its
ids to the store once, splits the records of each model into good rows, rows that wait and
rows for quarantine, and hands them on.  Results are keyed by batch, so a batch that runs
again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import split
from ..registry import FieldView
from ..sources.work import file_of, materialise, remove

QUEUE = "entry_id long"
#: Queued ids that are broadcast to the store's files; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def outcomes(rows: DataFrame, fields: dict[str, FieldView]) -> DataFrame:
    """Records of one model with their typed columns and reason: null if they are fine.

    ``unmapped``: a filterable field still has no slot; such rows wait for capacity.
    """
    reason = F.when(F.size("faults") > 0, F.when(F.array_contains("faults", "malformed_json"), "malformed_json").otherwise("schema_incompatibility"))
    return split(rows, fields).withColumns({"reason": reason, "unmapped": F.size("missing") > 0})


def drain_batch(queue: DataFrame, records: DataFrame, fields: dict[str, FieldView]) -> DataFrame:
    """Every queued entry of one model once: its record's outcome, or ``missing_entry_data``."""
    ids = queue.select("entry_id").distinct()
    have = records.select("entry_id", "tenant_id", "model_id", "fields")
    found = outcomes(have.join(ids, "entry_id", "left_semi"), fields)
    lost = ids.join(records.select("entry_id"), "entry_id", "left_anti").select("entry_id", F.lit("missing_entry_data").alias("reason"), F.lit(False).alias("unmapped"))
    return found.unionByName(lost, allowMissingColumns=True)


def enqueue(entries: DataFrame, path: str) -> None:
    entries.select(F.col("entry_id").cast("long").alias("entry_id")).write.mode("append").parquet(path)


def park(entries: DataFrame, path: str, name: str) -> None:
    """Set aside under a name of the caller's: a second time replaces the first."""
    entries.select(F.col("entry_id").cast("long").alias("entry_id")).write.mode("overwrite").parquet(f"{path}/{name}")


def release(spark: SparkSession, parked: str, key: str, queue: str) -> None:
    """Queue again what is set aside below ``parked``, all but the folder ``key``.

    Ids are queued before their files go, so a failure repeats some and loses none; files that
    another writer adds meanwhile stay for the next time.
    """
    top, fs = file_of(spark, parked)
    for folder in [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []:
        if folder.getName() != key:
            ids = spark.read.schema(QUEUE).option("recursiveFileLookup", "true").parquet(folder.toString())
            files = ids.inputFiles()
            if files:
                enqueue(ids, queue)
            for f in files:
                remove(spark, unquote(f))


def drain(
    spark: SparkSession, queue_path: str, checkpoint: str, records: Callable[[], DataFrame], fields: Callable[[int], dict[str, FieldView]],
    good: Callable[[dict[int, DataFrame], int], None], bad: Callable[[DataFrame, int], None], waiting: Callable[[DataFrame, str], None], where: str, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run over everything queued so far; ``good``, ``bad`` and ``waiting`` must be idempotent by batch id.

    ``where``: a folder for the batch's own tables.  Rows without an entry are reported with null partitions.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        place = f"{where}/{batch_id}"
        remove(spark, place)
        ids = materialise(batch.select("entry_id").distinct(), f"{place}/ids")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        found = materialise(records().select("entry_id", "tenant_id", "model_id", "fields").join(side, "entry_id", "left_semi"), f"{place}/found")
        lost = ids.join(found.select("entry_id"), "entry_id", "left_anti")
        faults = [lost.select("entry_id", F.lit(None).cast("long").alias("tenant_id"), F.lit(None).cast("int").alias("model_id"), F.lit("missing_entry_data").alias("reason"), F.lit("").alias("error_message"))]
        fine, wait = {}, {}
        for (model_id,) in found.select("model_id").distinct().collect():  # a row for each model
            done = materialise(outcomes(found.where(F.col("model_id") == model_id), fields(model_id)), f"{place}/{model_id}")
            faults.append(done.where("reason IS NOT NULL").select("entry_id", "tenant_id", "model_id", "reason", F.concat_ws(", ", "faults").alias("error_message")))
            fine[model_id] = done.where("reason IS NULL AND NOT unmapped").drop("reason", "unmapped", "missing", "faults")
            wait[model_id] = done.where("reason IS NULL AND unmapped").select("entry_id")
        together = faults[0]
        for f in faults[1:]:
            together = together.union(f)
        bad(together, batch_id)
        good(fine, batch_id)
        for model_id, rows in wait.items():
            waiting(rows, f"{batch_id}-{model_id}")
        remove(spark, place)

    source = spark.readStream.schema(QUEUE).option("recursiveFileLookup", "true")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return source.parquet(queue_path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
