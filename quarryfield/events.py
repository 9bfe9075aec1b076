"""Structured events: a closed vocabulary, written as one JSON object a line."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import IO

# The events each part of the engine may emit.
VOCABULARY = {
    "watcher": ("poll_started", "poll_complete", "provision_started", "provision_complete", "provision_failed", "lock_contention"),
    "reconciler": ("chunk_claimed", "chunk_complete", "chunk_partial", "dlq_inserted", "cache_miss", "capacity_wait", "coercion_null", "lease_lost"),
    "liberator": ("sweep_started", "sweep_chunk", "sweep_complete", "deadlock_retry", "sweep_gap_flagged"),
    "registry": ("page_provisioned", "slot_reserved", "cardinality_sampled", "low_cardinality_index", "spread_sampled", "high_spread_model", "compaction_planned", "compaction_complete", "retype_started", "promote_to_ready"),
    "chronicler": ("job_claimed", "chunk_written", "deadlock_retry", "chunk_skipped", "row_skipped", "lease_lost", "low_disk", "artifact_oversized", "job_complete", "job_failed", "gc_swept"),
    "api": (
        "export_accepted", "entry_written", "entry_updated", "entry_deleted", "exhaustion_fallback", "bulk_accepted", "bulk_chunk_committed", "bulk_chunk_rolled_back", "payload_too_large",
        "search_request", "capability_unsupported", "pre_flight_rejected", "cache_miss",
    ),
}


class Events:
    """``sink`` gets each event as a dictionary; the default writes lines to standard output."""

    def __init__(self, sink: Callable[[dict], None] | None = None, out: IO[str] | None = None, correlation_id: str | None = None):
        self.correlation_id = correlation_id or str(uuid.uuid4())
        self._sink, self._out = sink, out

    def emit(self, source: str, event: str, **parts) -> None:
        if event not in VOCABULARY[source]:
            raise ValueError(f"{source} has no event {event!r}")
        row = {"ts": datetime.now(timezone.utc).isoformat(), "source": source, "event": event, "correlation_id": self.correlation_id} | parts
        if self._sink is not None:
            self._sink(row)
        else:
            print(json.dumps(row, default=str), file=self._out or sys.stdout)
