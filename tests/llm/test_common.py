import re
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarryfield.llm.common import blanks, shared_dir, small_side, unused, word_count

from .test_native import TEXTS, WORD


def fake(value, master="local[4]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value or default), sparkContext=SimpleNamespace(applicationId="app-1", master=master))


def test_the_clusters_folder_is_used_where_there_is_one():
    assert shared_dir(fake("hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(fake(None)).startswith("file://") and shared_dir(fake(None)) == shared_dir(fake(None))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        assert shared_dir(fake("hdfs://x/y", master)) == "hdfs://x/y"
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(fake(None, master))


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Row int, _row int, n int")
    assert unused(df, "row", "n", "x") == ["__row", "_n", "x"]


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(5)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small_side(df, 10, 8)) and not hinted(small_side(df, 10**9, 8))


def test_words_and_blanks(spark):
    texts = [t for t in TEXTS if t is not None] + ["  lead and  gap ", "\x85\xa0 no spaces\xa0here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", word_count(F.col("t")).alias("n"), blanks(F.col("t")).alias("b")).collect():
        assert r.n == len(WORD.findall(r.t))
        assert r.b == "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in r.t)


KEPT = """
import re
import pyarrow as pa
from quarryfield.llm.common import tidy

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def run(batches):
    for batch in batches:
        texts = []
        for _ in range(4_000):
            texts.append(bytes(20_000))
            stays.append(bytes(600))  # between the texts, so that the allocator does not give them back by itself
        del texts
        yield pa.RecordBatch.from_arrays([pa.array([len(stays)])], names=["n"])

stays, rows = [], 0
for batch in WRAP(run)([]):
    pass
pa.array([1])[0].as_py()
before = held()
for batch in WRAP(run)([None]):
    rows += batch.column(0)[0].as_py()
print(rows, held() - before)
"""


def test_an_idle_worker_holds_no_freed_memory():
    def mb(wrap):
        out = subprocess.run([sys.executable, "-c", KEPT.replace("WRAP", wrap)], capture_output=True, text=True, check=True, timeout=60).stdout.split()
        assert out[0] == "4000"
        return float(out[1])

    assert mb("tidy") < mb("") / 2


def test_every_arrow_task_of_the_pipeline_is_tidy():
    from inspect import getsource

    from quarryfield.llm import packing, simhash

    near_copies = getsource(simhash).split("# Near copies by similarity")[1]
    for source in (getsource(packing), near_copies):
        assert (calls := re.findall(r"mapInArrow\((\w+)", source)) and set(calls) == {"tidy"}
