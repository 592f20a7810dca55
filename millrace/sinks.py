"""Sinks: decision CSV, JSONL, exclusion files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_line(*fields: Column) -> Column:
    """One CSV line; a field with a comma, quote or line break is quoted, quotes doubled."""
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in fields]
    return F.concat_ws(",", *quoted)


def write_decisions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("record_id", "status", "reason").write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """``{"id","text"}`` lines; empty texts are written, control characters escaped."""
    w = df.select("id", "text").write.mode(mode).option("ignoreNullFields", False)
    (w.option("compression", compression) if compression else w).json(path)


def json_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_excluded(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Dropped rows as JSONL, one folder a stage and reason."""
    df.write.mode(mode).partitionBy("stage", "reason").json(path)


def write_differences(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns in sorted order, as the comparison report has them."""
    df.select(*sorted(df.columns)).write.mode(mode).option("header", True).csv(path)
