"""The row-local filters on streams: the same functions, run by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Gopher, Pipeline
from ..operators import gopher, pipeline
from ..sources.text import TEXT_SCHEMA


def jsonl_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TEXT_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).json(path)


def decide(stream: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """Decisions of a stream of ``id, text``; stateless, so append mode."""
    return pipeline.decisions(stream, cfg=cfg)


def gopher_counts(stream: DataFrame, cfg: Gopher = Gopher()) -> DataFrame:
    """Running ``docs, kept, bytes`` (complete mode; the state is one row)."""
    return pipeline.gopher_summary(stream, cfg=cfg)


def running_reasons(decided: DataFrame) -> DataFrame:
    """Running histogram of drop reasons (complete mode; as many rows of state as reasons)."""
    return pipeline.drop_reasons(decided)


def gopher_verdicts(stream: DataFrame, cfg: Gopher = Gopher()) -> DataFrame:
    out = gopher.quality(stream.select("id", "text"), cfg=cfg)
    return out.select("id", (F.col("gopher_reason") == "").alias("keep"), F.col("gopher_reason").alias("reason"))


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; exactly once through the checkpoint."""
    return df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
