"""Command line: one command for each daemon of a deployment and each report.

Exit codes: 0 done, 1 failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

from .engine import Engine
from .errors import EngineError
from .events import Events
from .session import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarryfield")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("bootstrap", "watch", "reconcile", "drain", "import", "export", "sweep", "spread"):
        sub.add_parser(name)
    r = sub.add_parser("replay")
    chosen = r.add_mutually_exclusive_group(required=True)
    chosen.add_argument("--reason")
    chosen.add_argument("--id", type=int, action="append")
    c = sub.add_parser("compact")
    c.add_argument("tenant", type=int)
    c.add_argument("model", type=int)
    c.add_argument("--dry-run", action="store_true")
    try:
        a = p.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0) and 2
    try:
        engine = Engine(session(), a.root, events=Events())
        engine.load()
        try:
            _run(engine, a)
        finally:
            engine.save()
        return 0
    except EngineError as e:
        print(e, file=sys.stderr)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return 1


def _run(engine: Engine, a: argparse.Namespace) -> None:
    if a.command == "bootstrap":
        engine.provision(1)
    elif a.command == "watch":
        engine.watch()
    elif a.command == "reconcile":
        print(json.dumps({"did": engine.reconcile()}))
    elif a.command == "drain":
        engine.drain_outbox()
    elif a.command == "import":
        while engine.run_next_import():
            pass
    elif a.command == "export":
        while engine.run_next_export():
            pass
    elif a.command == "sweep":
        engine.sweep()
    elif a.command == "replay":
        print(json.dumps({"queued": engine.replay(reason=a.reason, ids=a.id)}))
    elif a.command == "spread":
        for row in engine.spread().orderBy("tenant_id", "model_id").toLocalIterator():
            print(json.dumps(row.asDict()))
    else:
        plan = engine.compact_model(a.tenant, a.model, a.dry_run)
        print(json.dumps({"pages_before": plan.pages_before, "targets": plan.targets, "moves": len(plan.moves)}))


if __name__ == "__main__":
    sys.exit(main())
