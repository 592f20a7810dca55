"""The filter chain, its decisions, totals and histograms."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Gopher, Pipeline
from ..functions import text as T
from . import c4, gopher


def chain(df: DataFrame, text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """Adds ``reason`` and ``final_text``: empty check, C4 quality, paragraphs, bad words.

    Later filters see the text as rewritten by the first and only run on
    what is still kept (``CASE`` is lazy a row). A null text counts as empty. Row-local, no shuffle.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    out = c4.quality(df.withColumn("_given", given), "_given", cfg.quality, "_q")
    kept = F.col("_q_text")
    out = out.withColumn("_p_reason", F.when(F.col("_q_reason") == "", c4.paragraph_reason(kept, cfg.paragraph)))
    out = out.withColumn("_b_reason", F.when(F.col("_p_reason") == "", c4.bad_word_reason(kept, cfg.bad_words)))
    why = F.when(F.col("_given") == "", F.lit("empty_text")).when(F.col("_q_reason") != "", F.col("_q_reason")).when(F.col("_p_reason") != "", F.col("_p_reason")).otherwise(F.col("_b_reason"))
    return T.once(out, {"reason": why, "final_text": kept}).drop("_given", "_q_reason", "_q_text", "_p_reason", "_b_reason")


def status(reason: Column) -> Column:
    return F.when(reason == "", F.lit("kept")).otherwise(F.lit("dropped"))


def decisions(df: DataFrame, key: str = "id", text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """``record_id, status, reason``: one row for each input row."""
    out = chain(df.select(F.col(key).alias("record_id"), F.col(text).alias("_text")), "_text", cfg)
    return out.select("record_id", status(F.col("reason")).alias("status"), "reason")


def totals(df: DataFrame, text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """One row: ``docs, kept, dropped, bytes`` (bytes of the rewritten text where C4 quality kept it, else of the original)."""
    out = chain(df.select(F.col(text).alias("_text")), "_text", cfg)
    kept = F.count_if(F.col("reason") == "")
    return out.agg(
        F.count(F.lit(1)).alias("docs"),
        kept.alias("kept"),
        (F.count(F.lit(1)) - kept).alias("dropped"),
        F.coalesce(F.sum(F.octet_length("final_text").cast("long")), F.lit(0)).alias("bytes"),
    )


def outcomes(df: DataFrame, key: str = "id", text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """``record_id, status, reason, bytes``: a decision with the size of the final text, so that totals need no second pass over texts."""
    out = chain(df.select(F.col(key).alias("record_id"), F.col(text).alias("_text")), "_text", cfg)
    return out.select("record_id", status(F.col("reason")).alias("status"), "reason", F.octet_length("final_text").cast("long").alias("bytes"))


def tally(outcome: DataFrame) -> DataFrame:
    """``reason, n, bytes`` of outcomes, kept ones under ``''``: what totals and histogram are both made of."""
    return outcome.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


#: The chain's stages in order, each with what it adds to the one before.
STAGES = ("Extraction", "QualityFilter", "ParagraphFilter", "BadWordsFilter")


def timed_stages(records: DataFrame, cfg: Pipeline = Pipeline()) -> DataFrame:
    """``stage, ms``: wall time that each stage adds, for :func:`profile`; a diagnosis that runs the chain once a stage.

    Stages are fused into one when the chain runs, so each is timed by running the chain up to it.
    """
    from .extract import extract_texts

    texts = extract_texts(records)
    t = F.col("text")
    good = c4.quality(texts, "text", cfg.quality, "_q")
    plans = (
        texts.select(F.octet_length(t).alias("x")),
        good.select("_q_reason"),
        good.select("_q_reason", F.when(F.col("_q_reason") == "", c4.paragraph_reason(F.col("_q_text"), cfg.paragraph)).alias("x")),
        chain(texts, "text", cfg).select("reason"),
    )
    out, before = [], 0.0
    for name, plan in zip(STAGES, plans, strict=True):
        began = time.perf_counter()
        plan.write.format("noop").mode("overwrite").save()
        took = (time.perf_counter() - began) * 1000
        out.append((name, max(0.0, took - before)))
        before = took
    return records.sparkSession.createDataFrame(out, "stage string, ms double")


def drop_reasons(decided: DataFrame) -> DataFrame:
    """``reason, n`` of dropped rows (partial aggregation; as few rows as reasons). Sort on demand."""
    return decided.where(F.col("status") == "dropped").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def gopher_summary(df: DataFrame, text: str = "text", cfg: Gopher = Gopher()) -> DataFrame:
    """One row ``docs, kept, bytes`` over the non-empty texts."""
    out = gopher.quality(df.where(F.col(text) != "").select(F.col(text).alias("_text")), "_text", cfg)
    return out.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("gopher_reason") == "").alias("kept"), F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0)).alias("bytes"))


def first_texts(df: DataFrame, n: int, order: list[str], text: str = "text") -> DataFrame:
    """The first ``n`` non-empty texts in the given order (-1: all; 0 or other negatives: none)."""
    some = df.where(F.col(text) != "")
    return some if n == -1 else some.orderBy(*order).limit(max(0, n))


def report(summary: DataFrame, seconds: float) -> DataFrame:
    """A summary row with ``elapsed_sec, docs_sec, mib_sec``."""
    s = F.lit(float(seconds))
    return summary.withColumns({"elapsed_sec": s, "docs_sec": T.rate(F.col("docs"), s), "mib_sec": T.rate(T.mib(F.col("bytes")), s)})


def profile(timings: DataFrame) -> DataFrame:
    """``stage, total_ms, calls, avg_ms`` of ``stage, ms`` rows."""
    return timings.groupBy("stage").agg(F.sum("ms").alias("total_ms"), F.count(F.lit(1)).alias("calls"), F.avg("ms").alias("avg_ms"))


def kept(df: DataFrame, key: str = "id", text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """``record_id, text`` of kept rows as rewritten."""
    out = chain(df.select(F.col(key).alias("record_id"), F.col(text)), text, cfg)
    return out.where(F.col("reason") == "").select("record_id", F.col("final_text").alias("text"))


def excluded(df: DataFrame, key: str = "id", text: str = "text", cfg: Pipeline = Pipeline()) -> DataFrame:
    """``record_id, text, stage, reason`` of dropped rows, for a sink partitioned by stage."""
    out = chain(df.select(F.col(key).alias("record_id"), F.col(text)), text, cfg)
    stage = F.when(F.col("reason") == "empty_text", F.lit("empty")).when(F.col("reason").isin("lorem_ipsum", "curly_bracket", "too_few_sentences"), F.lit("quality")).when(F.startswith("reason", F.lit("badword: ")), F.lit("bad_words")).otherwise(F.lit("paragraph"))
    return out.where(F.col("reason") != "").select("record_id", F.col(text).alias("text"), stage.alias("stage"), "reason")
