"""JSONL, bad-word lists, decision tables and single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rtrim_entry

TEXT_SCHEMA = "id string, text string"
DECISION_SCHEMA = "record_id string, status string, reason string"


def read_jsonl(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """``id, text`` of JSON lines (gzip by extension). Lines that are no JSON are left out unless ``keep_bad``, then both fields are null."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", TEXT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return (rows if keep_bad else rows.where(F.col("_bad").isNull())).select("id", "text")


def parse_json_text(value: "F.Column") -> "F.Column":
    """The field ``text`` of a JSON line, escapes decoded (``\\uXXXX`` too)."""
    return F.get_json_object(value, "$.text")


def read_bad_words(spark: SparkSession, path: str | None) -> tuple[str, ...]:
    """Entries of a list, one a line, in order; the three fallback words for no path, an empty list for an empty file.

    A list used inside one expression is small; longer ones are joined (``c4.bad_words_by_join``).
    """
    from ..operators.c4 import read_bad_words as usable

    if path is None:
        return usable(None)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n"))).orderBy("pos").select(rtrim_entry(F.col("col")).alias("e"))
    return usable([r[0] for r in rows.collect()])


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, status, reason, line``: CSV with a header; a missing column or id raises when read. ``line`` orders rows as in the file."""
    raw = spark.read.csv(path, header=True, escape='"')
    missing = {"record_id", "status", "reason"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
    need = F.when(F.coalesce(F.col("record_id"), F.lit("")) == "", F.raise_error(F.lit("a decision without record_id"))).otherwise(F.col("record_id"))
    return raw.select(need.alias("record_id"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.monotonically_increasing_id().alias("line"))


def one_document(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("stdin", text)], TEXT_SCHEMA)
