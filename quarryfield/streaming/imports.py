"""Imports: artifacts of many entities, committed in rounds of chunks.

The position in the artifact is kept by the store itself: a round's records and the position
after it are one version, so a job that is killed anywhere and claimed again goes on exactly
after the last round that counts, whatever models its entities belong to.  One bad entity
fails the job at its chunk and is quarantined; chunks before it stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactError
from ..operators.ingest import split
from ..operators.jobs import Job, Jobs, read_artifact
from ..registry import FieldView
from ..sources.work import materialise
from ..types import Settings

FAULT = "entry_id long, tenant_id long, model_id int, reason string, error_message string"


def run_import(spark: SparkSession, jobs: Jobs, job: Job, fields: Callable[[int], dict[str, FieldView]], done: int, commit: Callable[[list[DataFrame], int, int, int], None], quarantine: Callable[[DataFrame], None], where: str, settings: Settings = Settings()) -> Job:
    """``done``: position of the last round that counts.

    ``commit`` gets the split rows of a round, one frame for each model, the round's first and
    last place and the number of rows without a slot for some field.
    """
    try:
        rows = read_artifact(spark, job.artifact_path)
    except ArtifactError as e:
        quarantine(spark.createDataFrame([(None, job.tenant_id, None, "malformed_json", str(e))], FAULT))
        return jobs.beat(job, status="failed", failed_reason="malformed_json")
    chunk = settings.bulk_chunk
    models = [r[0] for r in rows.select("model_id").distinct().orderBy("model_id").collect()]
    parts = {m: materialise(split(rows.where((F.col("idx") >= done) & (F.col("model_id") == m)), fields(m)), f"{where}/{m}") for m in models}
    seen = [df.agg(F.min(F.when(F.size("faults") > 0, F.col("idx"))), F.max("idx"), F.count_if(F.size("missing") > 0)).first() for df in parts.values()]
    bad = min((r[0] for r in seen if r[0] is not None), default=None)
    last = max((r[1] for r in seen if r[1] is not None), default=done - 1)
    stop = last + 1 if bad is None else bad // chunk * chunk
    while done < stop:
        end = min(stop, (done // chunk + settings.import_round) * chunk)
        job = jobs.beat(job)
        inside = F.col("idx").between(done, end - 1)
        commit([df.where(inside) for df in parts.values()], done, end, sum(r[2] for r in seen))
        done = end
        job = jobs.beat(job, manifest={"chunks": -(-done // chunk), "entries_written": done})
    if bad is None:
        return jobs.beat(job, status="completed")
    for df in parts.values():
        faults = df.where((F.size("faults") > 0) & (F.floor(F.col("idx") / chunk) == bad // chunk))
        quarantine(faults.select(F.lit(None).cast("long").alias("entry_id"), "tenant_id", "model_id", F.lit("other").alias("reason"), F.concat_ws(", ", "faults").alias("error_message")))
    return jobs.beat(job, status="failed", failed_reason="uncoercible")
