"""Import and export jobs, and the quarantine: tables of rows and their state changes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ActiveExportCap, ArtifactError, LeaseLost, MalformedPayload, QuarantineEmpty, tenant
from ..types import Settings
from .ingest import BATCH, parse_envelope

QUARANTINE = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("entry_id", T.LongType()), T.StructField("tenant_id", T.LongType()), T.StructField("model_id", T.IntegerType()),
    T.StructField("reason", T.StringType()), T.StructField("error_message", T.StringType()), T.StructField("failed_at", T.TimestampNTZType()), T.StructField("retry_count", T.IntegerType()), T.StructField("chunk_id", T.StringType()),
])


def replay(dead: DataFrame, ids: list[int] | None = None, reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries to queue again, quarantine without them); rows without an entry are only removed."""
    chosen = F.col("id").isin(ids) if ids is not None else F.col("reason") == reason
    picked = dead.where(chosen)
    if picked.isEmpty():
        raise QuarantineEmpty("no such quarantined row")
    return picked.where("entry_id IS NOT NULL").select("entry_id"), dead.where(~F.coalesce(chosen, F.lit(False)))


@dataclass(frozen=True)
class Job:
    id: int
    tenant_id: int
    status: str = "pending"
    idempotency_key: str | None = None
    artifact_path: str | None = None
    request: dict = field(default_factory=dict)
    manifest: dict = field(default_factory=dict)
    failed_reason: str | None = None
    worker: str | None = None
    created_at: datetime = datetime(1970, 1, 1)
    heartbeat_at: datetime | None = None
    completed_at: datetime | None = None


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Jobs:
    """A job table of one kind.  It is small; the work of a job is a Spark job."""

    def __init__(self, settings: Settings = Settings(), clock: Callable[[], datetime] = utc_now):
        self.rows: dict[int, Job] = {}
        self.settings, self.clock = settings, clock

    def to_list(self) -> list[dict]:
        return [{k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(j).items()} for j in self.rows.values()]

    def load(self, rows: list[dict]) -> None:
        when = ("created_at", "heartbeat_at", "completed_at")
        self.rows = {r["id"]: Job(**{k: datetime.fromisoformat(v) if k in when and v else v for k, v in r.items()}) for r in rows}

    def submit(self, tenant_id: int, key: str | None = None, **parts) -> Job:
        """A key that the tenant has used gives the earlier job."""
        tenant(tenant_id)
        for j in self.rows.values():
            if key is not None and j.tenant_id == tenant_id and j.idempotency_key == key:
                return j
        job = Job(max(self.rows, default=0) + 1, tenant_id, idempotency_key=key, created_at=self.clock(), **parts)
        self.rows[job.id] = job
        return job

    def submit_export(self, tenant_id: int, model_id: int, kind: str, filter_text: str | None = None) -> Job:
        if kind not in ("csv", "json"):
            raise ValueError(f"csv or json, not {kind!r}")
        active = sum(j.tenant_id == tenant_id and j.status in ("pending", "processing") for j in self.rows.values())
        if active >= self.settings.export_active_cap:
            raise ActiveExportCap(f"tenant {tenant_id} has {active} active jobs")
        return self.submit(tenant_id, request={"model_id": model_id, "filter": filter_text, "format": kind})

    def get(self, tenant_id: int, job_id: int) -> Job | None:
        job = self.rows.get(job_id)
        return job if job and job.tenant_id == tenant(tenant_id) else None

    def claim(self, fair: bool = False) -> Job | None:
        """A pending job (by tenants in turn if ``fair``), else the one abandoned longest."""
        pending = [j for j in self.rows.values() if j.status == "pending"]
        oldest = {}
        for j in pending:
            oldest[j.tenant_id] = min(oldest.get(j.tenant_id, j.created_at), j.created_at)
        chosen = min(pending, key=lambda j: (oldest[j.tenant_id], j.created_at, j.id) if fair else (j.id,), default=None)
        if chosen is None:
            limit = self.clock() - timedelta(seconds=self.settings.lease_seconds)
            stale = [j for j in self.rows.values() if j.status == "processing" and j.heartbeat_at and j.heartbeat_at < limit]
            chosen = min(stale, key=lambda j: (j.heartbeat_at, j.id), default=None)
        if chosen is None:
            return None
        return self.update(chosen.id, status="processing", worker=uuid.uuid4().hex, heartbeat_at=self.clock())

    def beat(self, job: Job, **changes) -> Job:
        """Show that the worker is alive; ``LeaseLost`` if another has claimed its job meanwhile."""
        if self.rows[job.id].worker != job.worker or self.rows[job.id].status != "processing":
            raise LeaseLost(f"job {job.id} has another worker")
        return self.update(job.id, heartbeat_at=self.clock(), **changes)

    def update(self, job_id: int, **changes) -> Job:
        if changes.get("status") in ("completed", "failed"):
            changes.setdefault("completed_at", self.clock())
        self.rows[job_id] = replace(self.rows[job_id], **changes)
        return self.rows[job_id]

    def garbage(self) -> list[Job]:
        now, s = self.clock(), self.settings
        age = {"completed": s.gc_completed_seconds, "failed": s.gc_failed_seconds}
        return [j for j in self.rows.values() if j.artifact_path and j.status in age and j.completed_at and j.completed_at < now - timedelta(seconds=age[j.status])]

    def collect_garbage(self, delete: Callable[[str], None]) -> int:
        found = self.garbage()
        for j in found:
            delete(j.artifact_path)
            self.update(j.id, artifact_path=None, completed_at=j.completed_at)
        return len(found)


def import_artifact(envelopes: list[dict]) -> tuple[int, list[str]]:
    """(tenant, lines of JSON) of an import: at least one entity, all of one tenant; each line says its place."""
    if not envelopes:
        raise MalformedPayload("", "at least one entity is needed")
    tenants = {e["tenant_id"] for e in envelopes}
    if len(tenants) > 1:
        raise MalformedPayload("tenantId", "all entities must be of one tenant")
    t = tenant(tenants.pop())
    return t, [json.dumps({"idx": i, "tenantId": t, "modelId": e["model_id"], "fields": e["fields"]}, ensure_ascii=False) for i, e in enumerate(envelopes)]


def read_artifact(spark, path: str) -> DataFrame:
    """The entities of an import artifact as a batch, read by many tasks; a damaged line or a gap rejects it."""
    lines = spark.read.text(path).where("value <> ''")
    rows = lines.select(F.from_json("value", "struct<idx:bigint,tenantId:bigint,modelId:int,fields:string>").alias("v"))
    rows = rows.select("v.idx", F.col("v.tenantId").alias("tenant_id"), F.col("v.modelId").alias("model_id"), "v.fields")
    n, damaged, distinct, last = rows.agg(F.count(F.lit(1)), F.count_if(F.expr("idx IS NULL OR tenant_id IS NULL OR model_id IS NULL OR fields IS NULL")), F.count_distinct("idx"), F.max("idx")).first()
    if not n or damaged or distinct != n or last != n - 1:
        raise ArtifactError("malformed_json")
    return rows


__all__ = ["BATCH", "Job", "Jobs", "QUARANTINE", "import_artifact", "parse_envelope", "read_artifact", "replay", "utc_now"]
