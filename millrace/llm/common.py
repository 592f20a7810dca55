"""Shared plumbing: reading the tables, Arrow row mapping, durable cut points, hosts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import durable  # noqa: F401  (of all operators here)

#: Rows handled at a time inside a Python worker; keeps a batch of long texts small.
SLICE_ROWS = 512


#: Rows of one Arrow batch between the JVM and Python, where the session leaves it at Spark's default: rows here are whole pages.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Run ``fn`` over the tuples of ``columns`` of each partition, Arrow in and Arrow out.

    ``fn`` gets one iterator for the whole partition, so models load once a task.
    Only ``columns`` leave the JVM, whatever else the input holds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)

        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            data = list(zip(*out, strict=True)) if out else [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(data)], schema=arrow)
            out.clear()
            return made

        for row in fn(rows()):
            out.append(row)
            if len(out) >= 4 * SLICE_ROWS:
                yield flush()
        if out:
            yield flush()

    return df.select(*columns).mapInArrow(run, kind)


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """Spread a table that sits in too few input splits over the cluster's cores.

    A file smaller than one split is read by one task; Python work on it would
    then use one core. Tables with enough splits are left alone, so at scale
    this is no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = n or cores
    have = df.rdd.getNumPartitions()
    return df if have >= want else df.repartition(want)


def host_of(url) -> "F.Column":
    """Lower-case host of a URL without user and port; null if there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(raw != "", F.lower(raw))


def hosts_by_id(records: DataFrame) -> DataFrame:
    """``id, host`` of the response records; one row an id (repeated shipments collapse)."""
    return (
        records.where(F.col("type") == "response")
        .select("id", host_of(F.col("url")).alias("host"))
        .where(F.col("id").isNotNull() & F.col("host").isNotNull())
        .groupBy("id")
        .agg(F.min("host").alias("host"))
    )
