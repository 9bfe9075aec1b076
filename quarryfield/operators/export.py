"""CSV and JSON artifacts of a model's records.

Rows are encoded by expressions in all tasks; only the last step, which must give one
document in id order, writes through a single task, streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactError
from ..functions.records import JsonValue, float_text, kind_of, payload, value_of
from ..plans import ast
from ..plans.compiler import compile_filter
from ..registry import FieldView
from ..types import Settings
from .search import base_scan

NEWLINE = "\r\n"


def header_fields(fields: dict[str, FieldView]) -> list[str]:
    """Every registered field, by name."""
    return sorted(fields)


def cell_text(v: Column, kind: Column | None = None) -> Column:
    """A JSON value as a cell: nothing for null, nested values as JSON."""
    j = JsonValue(v, kind)
    number = F.when(j.is_int, j.int.cast("string")).otherwise(float_text(j.double))
    return F.when(j.absent, "").when(j.is_bool, F.when(j.bool, "true").otherwise("false")).when(j.is_number, number).when(j.is_string, j.string).otherwise(F.to_json(v))


def quoted(text: Column) -> Column:
    """RFC 4180: quotes only where the text holds a comma, a quote or a line break."""
    odd = F.contains(text, F.lit(",")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    return F.when(odd, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def rows_of(records: DataFrame, fields: dict[str, FieldView], tenant_id: int, model_id: int, node: ast.Node | None = None, apply_filter: bool = True, settings: Settings = Settings()) -> DataFrame:
    """entry_id and payload; ``apply_filter=False`` exports everything, whatever the job's filter says."""
    df = base_scan(records, tenant_id, model_id)
    condition = compile_filter(node, fields, settings) if apply_filter else None
    return (df if condition is None else df.where(condition)).select("entry_id", "fields")


def csv_lines(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """entry_id, line, skipped: rows with a NUL cannot be written."""
    # Each step is a column of its own, used more than once, so that it is computed once.
    df = rows.select("entry_id", payload(F.col("fields")).alias("v"))
    df = df.select("entry_id", *(value_of(F.col("v"), n).alias(f"v{i}") for i, n in enumerate(names)))
    df = df.select("*", *(kind_of(F.col(f"v{i}")).alias(f"k{i}") for i in range(len(names))))
    df = df.select("entry_id", *(cell_text(F.col(f"v{i}"), F.col(f"k{i}")).alias(f"c{i}") for i in range(len(names))))
    df = df.select("entry_id", F.concat_ws(",", *(quoted(F.col(f"c{i}")) for i in range(len(names)))).alias("line"))
    return df.select("entry_id", "line", F.contains("line", F.lit("\0")).alias("skipped"))


def csv_header(names: Sequence[str]) -> str:
    cell = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\r\n') else n
    return ",".join(map(cell, names))


def _check_size(size: int | None, settings: Settings) -> None:
    if (size or 0) > settings.export_max_bytes:
        raise ArtifactError(f"artifact_size_exceeded: {size} bytes")


def _write_text(df: DataFrame, path: str, separator: str) -> None:
    """One file in order of id."""
    df.orderBy("entry_id").select("line").coalesce(1).write.mode("overwrite").option("lineSep", separator).text(path)


def write_csv(rows: DataFrame, names: Sequence[str], path: str, settings: Settings = Settings()) -> int:
    """Gives the number of rows skipped."""
    lines = csv_lines(rows, names)
    skipped, size = lines.agg(F.count_if("skipped"), F.sum(F.when(~F.col("skipped"), F.octet_length("line") + len(NEWLINE)))).first()
    _check_size(size, settings)
    if skipped > settings.export_max_skips:
        raise ArtifactError(f"excessive_skips: {skipped}")
    out = lines.where("NOT skipped").select("entry_id", "line")
    if names:
        head = rows.sparkSession.createDataFrame([(-1, csv_header(names))], "entry_id long, line string")
        out = head.union(out)
    _write_text(out, path, NEWLINE)
    return skipped


def json_document(rows: DataFrame) -> DataFrame:
    """Lines that concatenate to one array of whole payloads, unregistered keys included."""
    return _document(rows, *rows.agg(F.min("entry_id"), F.max("entry_id")).first())


def _document(rows: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if last is None:
        return rows.sparkSession.createDataFrame([(0, "[]")], "entry_id long, line string")
    opening = F.when(F.col("entry_id") == first, "[").otherwise("")
    closing = F.when(F.col("entry_id") == last, "]").otherwise(",")
    return rows.select("entry_id", F.concat(opening, F.col("fields"), closing).alias("line"))


def write_json(rows: DataFrame, path: str, settings: Settings = Settings()) -> None:
    first, last, size = rows.agg(F.min("entry_id"), F.max("entry_id"), F.sum(F.octet_length("fields") + 2)).first()
    _check_size(size, settings)
    _write_text(_document(rows, first, last), path, "\n")
