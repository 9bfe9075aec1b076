"""Operator 1: best-fit packing of documents into training sequences.

Length-histogram planning.  Documents become pieces of at most ``max_len`` tokens; only the
histogram of piece lengths (``max_len`` counts at most, whatever the corpus holds) comes to
the driver.  Best-fit-decreasing runs over those counts and yields a slot plan: for each
length, ranges of ranks and the sequences and offsets they fill.  Pieces then take planned
slots by their rank within their length.

Ranks need no sort: each task numbers its own pieces by length while it tokenises, and the
prefix sums of the tasks' counts, one small row for each (length, task), make them global.
So a length that holds a third of all pieces is never gathered anywhere.

Cases: a null text counts as empty; an empty text is the end id alone; null or repeated ids
are packed as they come, one document a row; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small_side, text_or_empty, tidy, work_dir
from .encoders import encoder, slices, tokenizer_path

#: Bytes of one (task, length) count in memory, rounded up.
_OFFSET_ROW_BYTES = 40


def plan_slots(counts: dict[int, int], max_len: int) -> np.ndarray:
    """Best-fit-decreasing over a histogram of lengths.

    Rows (length, first rank, first sequence, pieces in each sequence, first offset): piece
    number r of that length, counted from the row's first rank, goes to sequence
    ``first + r // pieces`` at ``offset + (r % pieces) * length``.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges of sequences (first, how many)
    rooms: list[int] = []  # the keys of free, sorted
    rows, sequences = [], 0

    def give_back(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    def fill(length: int, rank: int, left: int, room: int, first: int, n: int) -> int:
        """Put pieces into ``n`` sequences with ``room`` free tokens; gives how many went in."""
        each = room // length
        full = min(n, left // each)
        if full:
            rows.append((length, rank, first, each, max_len - room))
            give_back(room - each * length, first, full)
        rest = min(left - full * each, each) if full < n else 0
        if rest:
            rows.append((length, rank + full * each, first + full, rest, max_len - room))
            give_back(room - rest * length, first + full, 1)
        give_back(room, first + full + bool(rest), n - full - bool(rest))
        return full * each + rest

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        at = bisect.bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms.pop(at)
            ranges = free.pop(room)
            for i, (first, n) in enumerate(ranges):
                if not left:
                    for f, m in ranges[i:]:
                        give_back(room, f, m)
                    break
                done = fill(length, rank, left, room, first, n)
                rank, left = rank + done, left - done
            at = bisect.bisect_left(rooms, length)
        if left:
            each = max_len // length
            n = -(-left // each)
            fill(length, rank, left, max_len, sequences, n)
            sequences += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _tokenise(path: str, max_len: int, end_id: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task, seen = encoder(path), TaskContext.get().partitionId(), [0] * (max_len + 1)
        for batch in batches:
            for ids, texts in slices(batch):
                out: list[list] = [[] for _ in schema]
                for doc, tokens in zip(ids, e.batch(texts)):
                    tokens += end
                    n = len(tokens) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = min(n, max_len) if start or n <= max_len else n % max_len or max_len
                        for col, v in zip(out, (doc, piece, start, length, tokens[4 * start : 4 * (start + length)], task, seen[length])):
                            col.append(v)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, max_len: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, where = docs.sparkSession, work_dir(docs.sparkSession, "packing")
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids", T.BinaryType), ("task", T.IntegerType), ("nth", T.LongType)))])
    pieces = materialise(source.mapInArrow(tidy(_tokenise(tokenizer, max_len, end_id, to_arrow_type(id_type))), schema), f"{where}/pieces")

    by_task = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), f"{where}/counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_len rows at most
    plan = plan_slots(counts, max_len)
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).select("length", "task", "before")
    ranked = pieces.join(small_side(before, by_task.count(), _OFFSET_ROW_BYTES), ["length", "task"])
    # The plan holds at most one row for each pair of a length and a free room, so its size is bounded by max_len squared.
    rows = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = rows.value
        key = slots[:, 0] * (1 << 44) + slots[:, 1]
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("before").to_numpy().astype(np.int64) + b.column("nth").to_numpy()
            s = slots[np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids")), pa.array(s[:, 2] + nth // s[:, 3]), pa.array(s[:, 4] + nth % s[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"],
            )

    out = T.StructType([*schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(place), out)
