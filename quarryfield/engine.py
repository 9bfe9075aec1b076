"""One engine over one store: the operations a caller needs, wired together."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConcurrentWrite, EngineError, EntryNotFound, FieldNotFilterable, FieldNotFound, FilterError, LeaseLost, PayloadTooLarge, tenant
from .events import Events
from .functions.numbering import numbered
from .operators import analytics, export, ingest, lifecycle, planning, search
from .operators.jobs import QUARANTINE, Job, Jobs, import_artifact, replay, utc_now
from .plans import ast, preflight
from .plans.wire import decode
from .registry import Registry
from .sources.store import Store
from .sources.work import materialise, remove, work_dir
from .streaming.imports import run_import
from .streaming.outbox import drain, enqueue, park, release
from .types import FAMILY, LIVE, SPARK_TYPE, Settings


class Engine:
    """``root``: a folder in any store Spark can write; ``driver``: another search backend, if wanted."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), events: Events | None = None, driver: search.SearchDriver | None = None, clock: Callable = utc_now, sleep: Callable[[float], None] = time.sleep):
        self.spark, self.root, self.settings, self.clock = spark, root.rstrip("/"), settings, clock
        self.events = events or Events(sink=lambda e: None)
        self.registry = Registry()
        self.store = Store(spark, f"{self.root}/entries")
        self.exports, self.imports = Jobs(settings, clock), Jobs(settings, clock)
        self.dead = Store(spark, f"{self.root}/quarantine")
        self._driver, self.sleep = driver, sleep

    # state: the registry and the job tables, beside the records

    def save(self) -> None:
        self.store.write_text("STATE", json.dumps({"registry": self.registry.to_dict(), "exports": self.exports.to_list(), "imports": self.imports.to_list()}))

    def load(self) -> None:
        text = self.store.read_text("STATE")
        if text is not None:
            state = json.loads(text)
            self.registry = Registry.from_dict(state["registry"])
            self.exports.load(state["exports"])
            self.imports.load(state["imports"])

    # schema

    def define_model(self, tenant_id: int, name: str, fields: Iterable[tuple]) -> int:
        self.registry = self.registry.define(tenant(tenant_id), name, fields)
        return self.registry.model(tenant_id, name).id

    def list_models(self, tenant_id: int) -> list[dict]:
        return self.registry.listing(tenant(tenant_id))

    def describe_model(self, tenant_id: int, name: str) -> dict | None:
        model = self.registry.model(tenant(tenant_id), name)
        return self.registry.describe(model) if model else None

    def provision(self, pages: int = 1) -> None:
        self.registry = self.registry.provision(pages)
        self.events.emit("registry", "page_provisioned", pages=pages)

    def _fields(self, tenant_id: int, model_id: int) -> dict:
        if self.registry.model_by_id(tenant(tenant_id), model_id) is None:
            raise FieldNotFound(f"tenant {tenant_id} has no model {model_id}")
        return self.registry.view(model_id)

    # reads

    def records(self, fields: dict | None = None) -> DataFrame:
        """The current version, with a null column for every field and group not written yet."""
        df = self.store.read()
        if df is None:
            df = self.spark.createDataFrame([], "entry_id long, tenant_id long, model_id int, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, fields string")
        return self._with(df, fields)

    @staticmethod
    def _with(df: DataFrame, fields: dict | None) -> DataFrame:
        new: dict[str, Column] = {}
        for view in (fields or {}).values():
            if view.slot is not None:
                if view.column not in df.columns:
                    new[view.column] = F.lit(None).cast(SPARK_TYPE[view.field.declared_type])
                if view.group not in df.columns:
                    new[view.group] = F.lit(False)
        return df.withColumns(new) if new else df

    def scan(self, tenant_id: int, model_id: int, filter_text: str | ast.Node | None = None, select: Sequence[str] | None = None) -> DataFrame:
        """Every matching record, lazily."""
        fields = self._fields(tenant_id, model_id)
        return search.scan(self.records(fields), fields, tenant_id, model_id, self._tree(filter_text, fields), select, settings=self.settings)

    def _tree(self, text: str | ast.Node | None, fields: dict) -> ast.Node | None:
        node = decode(text) if isinstance(text, str) else text
        operators = self._driver.supported_operators() if self._driver else frozenset(ast.LEAF_OPS)
        try:
            preflight.validate(node, fields, operators)
        except (FilterError, FieldNotFilterable) as e:
            code = getattr(e, "code", "field_not_filterable")
            self.events.emit("api", "capability_unsupported" if code == "capability_unsupported" else "pre_flight_rejected", code=code)
            raise
        return node

    def search(self, tenant_id: int, model_id: int, filter_text: str | ast.Node | None = None, select: Sequence[str] | None = None, page_size: int | None = None, cursor: str | None = None) -> search.Page:
        fields = self._fields(tenant_id, model_id)
        node = self._tree(filter_text, fields)
        request = search.Request(tenant_id, model_id, node, select, self.settings.page_size_default if page_size is None else page_size, cursor)
        request.check(self.settings)
        driver = self._driver or search.SparkDriver(self.records(fields), self.settings)
        page = driver.list(request, fields)
        self.events.emit("api", "search_request", tenant_id=tenant_id, nodes=ast.size(node), strategy=ast.strategy(node), rows=len(page.rows), consistency=driver.consistency())
        return page

    def read(self, tenant_id: int, model_id: int, leaves: Sequence[ast.Leaf] = (), **page: Any) -> search.Page:
        """Flat filters: all of the leaves."""
        return self.search(tenant_id, model_id, ast.all_of(list(leaves)), **page)

    def get(self, tenant_id: int, entry_id: int) -> dict | None:
        driver = self._driver or search.SparkDriver(self.records(), self.settings)
        return driver.get(tenant_id, entry_id)

    # writes

    def _now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp_ntz")

    def _take_ids(self, n: int) -> int:
        """The first of n new ids; no other writer gets them, and they never run backwards, whatever was deleted."""
        return self.store.reserve(n)

    def _work(self) -> str:
        return f"{self.root}/work/{uuid.uuid4().hex}"

    def _append(self, frames: Sequence[DataFrame], queued: int | None = None, notes: dict | None = None, once: str | None = None) -> None:
        """Split rows with entry ids, one frame for each model, as one version.

        Entries with a field that has no slot are queued first, to wait for one: should the write fail
        after that, the queue reports ids without an entry; the other way round it would lose some.
        """
        waiting = [df.where(F.size("missing") > 0).select("entry_id") for df in frames]
        if queued is None:
            queued = sum(w.count() for w in waiting)
        if queued:
            for w in waiting:
                enqueue(w, self._waiting_room())
            self.events.emit("api", "exhaustion_fallback", rows=queued)
        self.store.append(*(ingest.stamped(df, self._now()) for df in frames), notes=notes, once=once)

    def _split(self, envelopes: list[dict]) -> list[DataFrame]:
        """A frame for each model; idx is the place in ``envelopes``."""
        rows = ingest.batch(self.spark, envelopes)
        models = sorted({e["model_id"] for e in envelopes})
        return [ingest.split(rows.where(F.col("model_id") == m), self.registry.view(m)) for m in models]

    def write(self, tenant_id: int, model_id: int, fields: dict) -> int:
        """One entry; a value that does not fit its type rejects it whole."""
        self._fields(tenant_id, model_id)
        (rows,) = self._split([{"tenant_id": tenant_id, "model_id": model_id, "fields": fields}])
        ingest.require_clean(rows)
        first = self._take_ids(1)
        self._append([rows.withColumn("entry_id", F.lit(first).cast("long"))])
        self.events.emit("api", "entry_written", tenant_id=tenant_id, entry_id=first)
        return first

    def bulk_write(self, raw: Any, chunk_size: int | None = None) -> list[dict]:
        """Chunks commit independently, each whole; gives the manifest."""
        envelopes = ingest.parse_envelopes(raw)
        try:
            ingest.check_bulk_size(len(envelopes), self.settings)
        except PayloadTooLarge:
            self.events.emit("api", "payload_too_large", entities=len(envelopes))
            raise
        size, out = chunk_size or self.settings.bulk_chunk, []
        for start in range(0, len(envelopes), size):
            part = envelopes[start : start + size]
            for e in part:
                self._fields(e["tenant_id"], e["model_id"])
            frames = self._split(part)
            bad = [r["faults"] for rows in frames for r in rows.where(F.size("faults") > 0).select("faults").limit(1).collect()]
            if not bad:
                first = self._take_ids(len(part))
                self._append([rows.withColumn("entry_id", F.col("idx") + F.lit(first)) for rows in frames])
            self.events.emit("api", "bulk_chunk_rolled_back" if bad else "bulk_chunk_committed", chunk=len(out), rows=len(part))
            out.append({"chunk": len(out), "rows": len(part), "status": "rolled_back" if bad else "committed", "errors": bad})
        return out

    def ingest(self, rows: DataFrame, tenant_id: int, model_id: int) -> DataFrame:
        """A DataFrame (idx, tenant_id, model_id, fields) of any size; gives the chunk manifest and writes the clean chunks.

        The split rows are written once; manifest, numbers and the store all come from that table.
        """
        view, where = self._fields(tenant_id, model_id), self._work()
        chunks = materialise(ingest.chunked(ingest.split(rows, view), self.settings.bulk_chunk), f"{where}/chunks")
        manifest = materialise(ingest.chunk_manifest(chunks), work_dir(self.spark, "manifest") + "/rows")
        bad = manifest.where("status = 'rolled_back'").select("chunk")
        clean = numbered(chunks.join(bad, "chunk", "left_anti"), ["idx"], f"{where}/numbered")
        n = clean.count()
        if n:
            self._append([ingest.with_ids(clean, self._take_ids(n))])
        remove(self.spark, where)
        return manifest

    def _rewrite(self, touched: Column | DataFrame, change: Callable, without: Sequence[str] = ()) -> None:
        """Three tries, each on the newest version, as another writer may come first."""
        for left in (2, 1, 0):
            try:
                self.store.rewrite(touched, change, without)
                return
            except ConcurrentWrite:
                if not left:
                    raise
                self.events.emit("liberator", "deadlock_retry", left=left)

    def _of(self, tenant_id: int, model_id: int, entry_id: int) -> Column:
        return (F.col("tenant_id") == tenant_id) & (F.col("model_id") == model_id) & (F.col("entry_id") == entry_id)

    def update(self, tenant_id: int, entry_id: int, fields: dict) -> None:
        """Rewrites the file that holds the entry."""
        old = self.get(tenant_id, entry_id)
        if old is None:
            raise EntryNotFound(f"no entry {entry_id}")
        view, text = self.registry.view(old["model_id"]), json.dumps(fields, ensure_ascii=False)
        self._rewrite(self._of(tenant_id, old["model_id"], entry_id), lambda df: [ingest.replace_entry(self._with(self._own(df, old["model_id"]), view), view, tenant_id, entry_id, text, self._now())])
        self.events.emit("api", "entry_updated", tenant_id=tenant_id, entry_id=entry_id)

    def delete(self, tenant_id: int, entry_id: int) -> bool:
        """Rewrites the file that holds the entry; true only if it was not deleted yet."""
        old = self.get(tenant_id, entry_id)
        if old is None:
            return False
        self._rewrite(self._of(tenant_id, old["model_id"], entry_id), lambda df: [ingest.soft_delete(self._own(df, old["model_id"]), tenant_id, entry_id, self._now())[0]])
        self.events.emit("api", "entry_deleted", tenant_id=tenant_id, entry_id=entry_id)
        return True

    # jobs

    def submit_bulk_write(self, raw: Any, key: str | None = None) -> Job:
        envelopes = ingest.parse_envelopes(raw)
        tenant_id, lines = import_artifact(envelopes)
        job = self.imports.submit(tenant_id, key)
        if job.artifact_path is None:
            path = f"{self.root}/imports/{job.id}"
            self.spark.createDataFrame([(x,) for x in lines], "value string").write.mode("overwrite").text(path)
            job = self.imports.update(job.id, artifact_path=path)
            self.events.emit("api", "bulk_accepted", tenant_id=tenant_id, job=job.id, entities=len(envelopes))
        return job

    def run_next_import(self) -> Job | None:
        job = self.imports.claim()
        if job is None:
            return None
        self.events.emit("reconciler", "chunk_claimed", job=job.id)
        where, note = self._work(), f"import {job.id}"

        def commit(frames: list[DataFrame], start: int, end: int, queued: int) -> None:
            """A round and the position after it are one version; should another worker have committed the round, nothing changes."""
            first = self._take_ids(end - start)
            rows = [df.withColumn("entry_id", F.col("idx") - F.lit(start) + F.lit(first)) for df in frames]
            self._append(rows, queued, {note: end}, once=f"{note} from {start}")

        try:
            job = run_import(self.spark, self.imports, job, self.registry.view, self.store.note(note) or 0, commit, lambda df: self._quarantine(df, "bulk_import"), where, self.settings)
        except LeaseLost:
            self.events.emit("reconciler", "lease_lost", job=job.id)
            return self.imports.rows[job.id]
        finally:
            remove(self.spark, where)
        self.events.emit("reconciler", "chunk_complete" if job.status == "completed" else "chunk_partial", job=job.id)
        return job

    def _quarantine(self, df: DataFrame, source: str, once: str | None = None) -> None:
        if df.isEmpty():
            return
        rows = df.select(F.lit(source).alias("source"), "entry_id", "tenant_id", "model_id", "reason", "error_message", self._now().alias("failed_at"), F.lit(0).alias("retry_count"), F.lit(self.events.correlation_id).alias("chunk_id"))
        self.dead.append(rows, once=once)
        self.events.emit("reconciler", "dlq_inserted")

    def quarantined(self) -> DataFrame:
        df = self.dead.read()
        df = self.spark.createDataFrame([], QUARANTINE) if df is None else df.select(*QUARANTINE.names)
        return df.withColumn("id", F.xxhash64(*QUARANTINE.names))

    def replay(self, reason: str | None = None, ids: list[int] | None = None) -> int:
        """Gives the number of entries queued again.  They are queued before they leave the quarantine, so a failure repeats some and loses none."""
        again, left = replay(self.quarantined(), ids, reason)
        n = again.count()
        enqueue(again, f"{self.root}/outbox")
        self.dead.write(left.drop("id"))
        return n

    def _slotless(self) -> list:
        """Filterable fields that wait for a slot."""
        return [f for f in self.registry.fields if f.filterable and self.registry.view(f.model_id)[f.name].slot is None]

    def _waiting_room(self) -> str:
        """Where entries wait as long as the very fields stay without a slot that have none now."""
        ids = ",".join(str(i) for i in sorted(f.id for f in self._slotless()))
        return f"{self.root}/outbox-waiting/{hashlib.sha256(ids.encode()).hexdigest()}" if ids else f"{self.root}/outbox"

    def drain_outbox(self) -> None:
        """Fill in typed values for entries whose field had no slot when they were written.

        Entries with a field that still has none wait; they are read again when the fields without a slot are others.
        """
        for f in self._slotless():
            self.registry = self.registry.reserve(f, "assigned", indexed_only=True)
        outbox, room = f"{self.root}/outbox", self._waiting_room()
        release(self.spark, f"{self.root}/outbox-waiting", room.rsplit("/", 1)[1], outbox)
        if not self._exists(outbox):
            return

        def good(frames: dict[int, DataFrame], _batch: int) -> None:
            frames = {m: df for m, df in frames.items() if not df.isEmpty()}
            if not frames:
                return
            keys = None
            for df in frames.values():
                own = df.select("tenant_id", "model_id", "entry_id")
                keys = own if keys is None else keys.union(own)

            def change(old: DataFrame) -> list[DataFrame]:
                """Records of the touched files, each of one model: those that were drained with their new values, the others as they are."""
                return [ingest.filled_in(self._own(old.where(F.col("model_id") == m), m), df) for m, df in frames.items()]

            self._rewrite(keys, change)

        bad = lambda df, batch: self._quarantine(df, "sync_queue", once=f"outbox {batch}")
        waiting = lambda df, name: None if df.isEmpty() else park(df, room, f"waiting-{name}")
        drain(self.spark, outbox, f"{self.root}/outbox-progress", self.records, self.registry.view, good, bad, waiting, self._work()).awaitTermination()

    def _own(self, df: DataFrame, model_id: int) -> DataFrame:
        """Without the columns of other models' fields."""
        own = {f"f_{f.id}_" for f in self.registry.fields if f.model_id == model_id}
        return df.select(*(c for c in df.columns if not c.startswith("f_") or c[: c.rindex("_") + 1] in own))

    def reconcile(self) -> str:
        """One round of background work in fixed order: queued entries, then one import, then one change of type.

        ``capacity_wait``: some field still has no slot, so entries stay queued for the next page.
        """
        if self.store.version() is not None:
            self.drain_outbox()
        if self._slotless():
            self.events.emit("reconciler", "capacity_wait")
            return "capacity_wait"
        if self.run_next_import():
            return "import"
        return "retype" if self.run_next_retype() else "idle"

    def run_next_retype(self) -> bool:
        """Finish one change of type that was put off, or that a driver which died left unfinished."""
        if not self.registry.pending:
            return False
        field_id, source = self.registry.pending[0]
        f = next(f for f in self.registry.fields if f.id == field_id)
        self._backfill(f.model_id, f.name, source)
        return True

    def _exists(self, uri: str) -> bool:
        path, fs = self.store.file(uri)
        return fs.exists(path)

    def submit_export(self, tenant_id: int, model_id: int, kind: str, filter_text: str | None = None) -> Job:
        job = self.exports.submit_export(tenant_id, model_id, kind, filter_text)
        self.events.emit("api", "export_accepted", tenant_id=tenant_id, job=job.id)
        return job

    def get_export(self, tenant_id: int, job_id: int) -> Job | None:
        return self.exports.get(tenant_id, job_id)

    def run_next_export(self, apply_filter: bool = True) -> Job | None:
        if not self._room():
            return None
        job = self.exports.claim(fair=True)
        if job is None:
            self.collect_garbage()
            return None
        self.events.emit("chronicler", "job_claimed", job=job.id)
        path = f"{self.root}/exports/{job.id}"
        for wait in (*self.settings.export_backoff, None):
            try:
                job = self.exports.beat(job)
                skipped = self._export(job, path, apply_filter)
                self.exports.beat(job)
                self.events.emit("chronicler", "job_complete", job=job.id, skipped=skipped)
                return self.exports.update(job.id, status="completed", artifact_path=path, manifest={"skipped": skipped})
            except LeaseLost:
                self.events.emit("chronicler", "lease_lost", job=job.id)
                return self.exports.rows[job.id]
            except EngineError as e:  # the job's own fault: trying again would not help
                self._export_failed(job, str(e)[:200])
                raise
            except Exception:
                if wait is None:
                    self._export_failed(job, "query_failure")
                    raise
                self.events.emit("chronicler", "deadlock_retry", job=job.id, seconds=wait)
                self.sleep(wait)

    def _export(self, job: Job, path: str, apply_filter: bool) -> int:
        model_id = job.request["model_id"]
        fields = self._fields(job.tenant_id, model_id)
        node = self._tree(job.request["filter"], fields)
        rows = export.rows_of(self.records(fields), fields, job.tenant_id, model_id, node, apply_filter, self.settings)
        if job.request["format"] == "csv":
            return export.write_csv(rows, export.header_fields(fields), path, self.settings)
        export.write_json(rows, path, self.settings)
        return 0

    def _export_failed(self, job: Job, reason: str) -> None:
        self.events.emit("chronicler", "job_failed", job=job.id, reason=reason)
        self.exports.update(job.id, status="failed", failed_reason=reason)

    def collect_garbage(self) -> int:
        """Delete old artifacts of finished jobs."""

        def delete(path: str) -> None:
            target, fs = self.store.file(path)
            fs.delete(target, True)

        n = self.exports.collect_garbage(delete) + self.imports.collect_garbage(delete)
        self.events.emit("chronicler", "gc_swept", artifacts=n)
        return n

    def _room(self) -> bool:
        """Exports wait while the store has less than a tenth of its space left; unknown sizes count as room."""
        _, fs = self.store.file(self.root)
        status = fs.getStatus()
        capacity = status.getCapacity()
        if not 0 < capacity < 1 << 62 or status.getRemaining() >= self.settings.min_free_space * capacity:
            return True
        self.events.emit("chronicler", "low_disk")
        return False

    # fields that change

    def retype_field(self, tenant_id: int, model_id: int, name: str, target: str, later: bool = False) -> DataFrame | None:
        """Gives the audit of values that could not be coerced; None if nothing had to be filled in, or ``later``: by ``reconcile``."""
        self._fields(tenant_id, model_id)
        reg, due = lifecycle.begin_retype(self.registry, model_id, name, target)
        self.events.emit("registry", "retype_started", field=name, target=target)
        return self._finish(reg, due and not later, model_id, name)

    def promote(self, tenant_id: int, model_id: int, name: str) -> DataFrame | None:
        reg, due = lifecycle.promote(self.registry, model_id, name)
        return self._finish(reg, due, model_id, name)

    def demote(self, tenant_id: int, model_id: int, name: str) -> None:
        self.registry = lifecycle.demote(self.registry, model_id, name)

    def _finish(self, reg: Registry, due: bool, model_id: int, name: str) -> DataFrame | None:
        self.registry = reg  # from here on the field reads from JSON
        return self._backfill(model_id, name, dict(reg.pending)[reg.field(model_id, name).field.id]) if due else None

    def _backfill(self, model_id: int, name: str, source: str) -> DataFrame:
        """Rewrites the model's files, no others; again from the start if it did not come to its end."""
        view = self.registry.view(model_id)[name]
        change = lambda df: [lifecycle.backfill(self._own(df, model_id).drop(view.column), view, source)]
        self._rewrite(F.col("model_id") == model_id, change)
        self.registry = lifecycle.finish_retype(self.registry, model_id, name)
        self.events.emit("registry", "promote_to_ready", field=name)
        self.advise(model_id)
        return lifecycle.audit(self.records(), view, source)

    def sweep(self) -> int:
        """Slots of changed fields become free; files of the models that had them are rewritten without their columns."""
        reg, gone, dead = lifecycle.sweep(self.registry, self.records().columns)
        self.events.emit("liberator", "sweep_started", slots=len(dead))
        if gone:
            owners = sorted({f.model_id for f in reg.fields for c in gone if c.startswith(f"f_{f.id}_")})
            try:
                self._rewrite(F.col("model_id").isin(owners), lambda df: [self._own(df.where(F.col("model_id") == m), m).drop(*gone) for m in owners], without=gone)
            except ConcurrentWrite:  # the slots stay as they are for the next sweep
                for s in dead:
                    self.registry = self.registry.with_slot(replace(s, gaps=s.gaps + 1))
                    self.events.emit("liberator", "sweep_gap_flagged", slot=s.id, gaps=s.gaps + 1)
                return 0
        self.registry = reg
        self.events.emit("liberator", "sweep_complete", slots=len(dead))
        return len(dead)

    def compaction_plan(self, model_id: int) -> planning.CompactionPlan:
        own = {f.id for f in self.registry.fields if f.model_id == model_id}
        placed = [planning.Placed(s.field_id, s.family, s.page_id) for s in self.registry.slots if s.field_id in own and s.status in LIVE]
        free: dict[int, dict[str, int]] = {}
        for s in self.registry.free_slots(indexed_only=True):
            free.setdefault(s.page_id, {}).setdefault(s.family, 0)
            free[s.page_id][s.family] += 1
        return planning.plan_compaction(sorted(placed, key=lambda p: p.field_id), free)

    def compact_model(self, tenant_id: int, model_id: int, dry_run: bool = False) -> planning.CompactionPlan:
        self._fields(tenant_id, model_id)
        plan = self.compaction_plan(model_id)
        self.events.emit("registry", "compaction_planned", model=model_id, moves=len(plan.moves))
        for move in () if dry_run else plan.moves:
            view = next(v for v in self.registry.view(model_id).values() if v.field.id == move.field_id)
            kind = view.field.declared_type
            reg, due = lifecycle.begin_retype(self.registry, model_id, view.field.name, kind, only_page=move.to_page)
            self._finish(reg, due, model_id, view.field.name)
        if not dry_run:
            self.events.emit("registry", "compaction_complete", model=model_id)
        return plan

    # reports

    def provisioning_plan(self) -> planning.ProvisioningPlan:
        capacity, waiters = {}, {}
        for s in self.registry.slots:
            c = capacity.get(s.family, planning.Capacity())
            free = s.status == "free"
            capacity[s.family] = planning.Capacity(c.total + 1, c.free + free, c.indexed + s.indexed, c.indexed_free + (free and s.indexed))
        for f in self.registry.fields:
            if f.filterable and self.registry.view(f.model_id)[f.name].slot is None:
                waiters[FAMILY[f.declared_type]] = waiters.get(FAMILY[f.declared_type], 0) + 1
        return planning.plan_provisioning(capacity, waiters, self.settings.free_ratio_threshold)

    def watch(self) -> planning.ProvisioningPlan:
        """One look at capacity and demand; provisions a page if the plan says so."""
        self.events.emit("watcher", "poll_started")
        plan = self.provisioning_plan()
        if plan.wanted:
            self.events.emit("watcher", "provision_started", trigger=plan.trigger)
            self.registry = self.registry.provision(1, indexed=dict(plan.columns) or None)
            self.events.emit("watcher", "provision_complete")
        self.events.emit("watcher", "poll_complete")
        return plan

    def spread(self) -> DataFrame:
        t = self.registry.to_frames(self.spark)
        return analytics.spread_report(t["models"], t["fields"], t["slots"])

    def advise(self, model_id: int) -> None:
        """Events for columns with few distinct values and models spread over more pages than they need."""
        model = next(m for m in self.registry.models if m.id == model_id)
        sample = self.cardinality(model.tenant_id, model_id)
        self.events.emit("registry", "cardinality_sampled", model=model_id)
        for row in analytics.low_cardinality(sample, self.settings).collect():  # a row for each field and tenant at most
            self.events.emit("registry", "low_cardinality_index", model=model_id, column=row["column"], reasons=row["reasons"])
        spread = self.spread().where(F.col("model_id") == model_id)
        self.events.emit("registry", "spread_sampled", model=model_id)
        for row in analytics.high_spread(spread, self.settings).collect():
            self.events.emit("registry", "high_spread_model", model=model_id, pages=row["pages"], excess=row["excess"])

    def cardinality(self, tenant_id: int, model_id: int) -> DataFrame:
        fields = {n: v for n, v in self._fields(tenant_id, model_id).items() if v.typed}
        df = self.records(fields).where(F.col("model_id") == model_id)
        return analytics.cardinality_sample(df, {n: v.column for n, v in fields.items()})
