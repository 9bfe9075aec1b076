"""The driver's entry, with and without the optional subpackage."""

import os
import re
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_registrations(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e, quarryfield.engine, quarryfield.cli; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') for k in q) and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_no_other_module_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(REPO, "quarryfield")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert not re.search(r"\bllm\b", f.read()), name
