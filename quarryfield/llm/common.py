"""Helpers that every operator of this subpackage shares.

Working tables go to the folder that the cluster names in ``spark.checkpoint.dir``
(all executors and the driver see it), never to a machine-local folder.  A written
table cuts the lineage and survives the loss of an executor.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialise, shared_dir, work_dir

__all__ = ["blanks", "materialise", "shared_dir", "small_side", "text_or_empty", "tidy", "unused", "word_count", "work_dir", "worker_threads_off"]

#: Bytes that a broadcast side may hold at most; above, the join shuffles both sides.
BROADCAST_LIMIT_BYTES = 48 << 20

#: Six ASCII white space characters separate words: \x20 and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = "\t\n\x0b\x0c\r "


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if ``rows`` counted rows of ``row_bytes`` stay below the limit; else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def blanks(text: Column) -> Column:
    """Every ASCII white space character as a blank.

    Line breaks are replaced byte-wise; the other four are rare and looked for first, as
    translating decodes every character.
    """
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(rare, F.translate(text, ASCII_SPACE, " " * 6)).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def word_count(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space.

    Where no blanks meet, words are one more than blanks; other texts are searched.
    """
    one = F.trim(blanks(text))
    simple = F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit(""))) + 1
    return F.when(one == "", 0).when(F.contains(one, F.lit("  ")), F.regexp_count(one, F.lit("[^ ]+"))).otherwise(simple).cast("long")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system when a task ends.

    Spark keeps a task's Python worker for later ones, and what its allocators hold counts
    towards the executor's limit meanwhile, also in stages that need no Python.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return task


def worker_threads_off() -> None:
    """Tokenizers otherwise start a thread pool in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
