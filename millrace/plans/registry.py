"""Registered queries of the core: name to ``(spark, sf_dir) -> DataFrame``; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Pipeline
from ..functions import text as T
from ..operators import c4, compare, extensions, extract, gopher, pipeline
from ..sinks import csv_line, json_line, write_decisions, write_differences, write_jsonl
from ..sources.shared import fresh_folder
from ..sources.spread import spread
from ..sources.text import read_decisions, read_jsonl
from ..sources.warc import read_warc, write_warc
from .sql import oracle_sql as _sql

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG_ROWS else df


#: Tables whose rows are long texts; the others are read as they are.
LONG_ROWS = {"texts", "documents", "warc_records"}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_decisions(spark, sf_dir)


def extract_http_body(spark: SparkSession, d: str) -> DataFrame:
    body = extract.body_bytes(F.col("content"))
    return table(spark, d, "warc_records").where(F.col("type") == "response").select("path", "ordinal", body["start"].alias("body_start"), body["size"].alias("body_size"))


def extract_text(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract_texts(table(spark, d, "warc_records"), ill_formed="null")


def extract_text_whole(spark: SparkSession, d: str) -> DataFrame:
    """``extract_text`` with U+FFFD for what is no UTF-8, instead of no text."""
    return extract.extract_texts(table(spark, d, "warc_records"))


def first_500_whole(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.decisions(extract.extract_texts(extract.first_responses(table(spark, d, "warc_records"), 500)))


def warc_fields(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("headers")
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    return table(spark, d, "warc_records").select(
        "path",
        "ordinal",
        h["WARC-Type"].alias("h_type"),
        h["WARC-Record-ID"].alias("h_id"),
        h["WARC-Target-URI"].alias("h_url"),
        h["WARC-Date"].alias("h_date"),
        F.size(h).alias("n_headers"),
        size.alias("content_size"),
        (size < F.col("content_length")).alias("truncated"),
    )


def record_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "warc_records").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("content_length").alias("bytes"))


def c4_line_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "texts").select("id", F.explode(c4.candidate_lines(F.col("text"))).alias("line"))


def c4_quality(spark: SparkSession, d: str) -> DataFrame:
    return c4.quality(table(spark, d, "texts")).select("id", "c4_reason", "c4_text")


def c4_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "texts").select("id", c4.paragraph_reason(F.col("text")).alias("reason"))


def bad_words_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "texts").select("id", c4.bad_word_reason(F.col("text"), Pipeline().bad_words).alias("reason"))


def bad_words_listed(spark: SparkSession, d: str) -> DataFrame:
    """The list within one expression; a list is short beside the texts, one too long for an expression is joined."""
    listed = [r[0] or "" for r in table(spark, d, "badwords").orderBy("entry_no").select("entry").collect()]
    return table(spark, d, "texts").select("id", c4.bad_word_reason(F.col("text"), c4.read_bad_words(listed)).alias("reason"))


def bad_words_joined(spark: SparkSession, d: str) -> DataFrame:
    return c4.bad_words_by_join(table(spark, d, "documents"), table(spark, d, "badwords"), "doc_id")


def gopher_metrics(spark: SparkSession, d: str) -> DataFrame:
    return gopher.metrics(table(spark, d, "documents").select("doc_id", "text")).drop("text")


def gopher_quality(spark: SparkSession, d: str) -> DataFrame:
    return gopher.quality(table(spark, d, "texts")).select("id", "gopher_reason")


def gopher_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return gopher.quality(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", gopher.verdict(F.col("gopher_reason")).alias("verdict"))


def gopher_summary(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.gopher_summary(table(spark, d, "texts"))


def pipeline_decisions(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.decisions(table(spark, d, "texts"))


def document_decisions(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.decisions(table(spark, d, "documents"), key="doc_id")


def pipeline_totals(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.totals(table(spark, d, "texts"))


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.drop_reasons(pipeline_decisions(spark, d))


def excluded_rows(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.excluded(table(spark, d, "texts")).drop("text")


def first_500_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The limit of the reference: the first N responses in file order."""
    first = extract.first_responses(table(spark, d, "warc_records"), 500)
    return pipeline.decisions(extract.extract_texts(first, ill_formed="null"))


def warc_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The reference's main job: every response of the crawl through extraction and the filter chain."""
    return pipeline.decisions(extract.extract_texts(table(spark, d, "warc_records")))


def warc_totals(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.totals(extract.extract_texts(table(spark, d, "warc_records")))


def warc_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.drop_reasons(warc_decisions(spark, d))


def decision_csv(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return table(spark, d, "decisions").select(csv_line(F.col("record_id"), blank("status"), blank("reason")).alias("line"))


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "texts").select(json_line("id", "text").alias("value"))
    return lines.select(F.from_json("value", "id string, text string").alias("r")).select("r.*")


def regression_diff(spark: SparkSession, d: str) -> DataFrame:
    return compare.diff(table(spark, d, "decisions"), pipeline_decisions(spark, d))


def regression_tally(spark: SparkSession, d: str) -> DataFrame:
    return compare.tally(regression_diff(spark, d))


def text_primitives(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select(
        "doc_id",
        F.size(T.split_lines(t)).alias("n_lines"),
        T.word_count(t).alias("n_words"),
        F.octet_length(T.remove_citations(t)).alias("uncited_bytes"),
        F.octet_length(T.ascii_lower(t)).alias("low_bytes"),
        F.md5(T.ascii_lower(t)).alias("low_md5"),
        T.has_long_word(t, 20).alias("long_word"),
    )


def stage_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return pipeline.profile(rows).select("stage", F.round("total_ms", 4).alias("total_ms"), "calls", F.round("avg_ms", 4).alias("avg_ms"))


def warc_read(spark: SparkSession, d: str) -> DataFrame:
    """All records written as WARC files and read by the WARC source."""
    folder = fresh_folder(spark)
    files = write_warc(table(spark, d, "warc_records"), folder.removeprefix("file://"))
    read = read_warc(spark, ",".join(files)) if files else spark.createDataFrame([], "path string, ordinal long, id string, url string, type string, content_length long, content binary")
    name = F.element_at(F.split("path", "/"), -1)
    return read.select(name.alias("file"), "ordinal", "id", "url", "type", "content_length", F.md5("content").alias("digest"))


def jsonl_file(spark: SparkSession, d: str) -> DataFrame:
    """All texts through the JSONL sink and source."""
    folder = fresh_folder(spark)
    write_jsonl(table(spark, d, "texts"), folder, compression="gzip")
    return read_jsonl(spark, folder)


def decisions_file(spark: SparkSession, d: str) -> DataFrame:
    """The table of decisions through the CSV sink and source."""
    folder = fresh_folder(spark)
    write_decisions(table(spark, d, "decisions").where("record_id <> ''"), folder)
    return read_decisions(spark, folder).drop("line")


def differences_file(spark: SparkSession, d: str) -> DataFrame:
    """The comparison report as written."""
    folder = fresh_folder(spark)
    write_differences(regression_diff(spark, d), folder)
    return spark.read.csv(folder, header=True, escape='"')


def kept_rows(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.kept(table(spark, d, "texts"))


def outcome_tally(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.tally(pipeline.outcomes(table(spark, d, "texts")))


def url_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Responses whose host is not that of a document from a blog."""
    blocked = table(spark, d, "documents").where(F.startswith(F.col("source"), F.lit("blog."))).select(F.col("source").alias("host"))
    records = table(spark, d, "warc_records").where(F.col("type") == "response").select("path", "ordinal", "url")
    return extensions.url_filter(records, blocked)


def document_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extensions.language(F.col("text")).alias("language"))


def repetition_counts(spark: SparkSession, d: str) -> DataFrame:
    out = extensions.repetition(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", *extensions.REPETITION, extensions.repetition_reason().alias("reason"))


def web_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extensions.web_text_reason(F.col("text")).alias("reason"))


def personal_formatted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "texts").select("id", extensions.format_personal(F.col("text")).alias("text"))


def near_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a document with its class; tested against brute force."""
    return extensions.near_duplicates(table(spark, d, "documents"), "doc_id")


def queries() -> dict[str, Query]:
    own = [extract_http_body, extract_text, warc_fields, record_types, c4_line_candidates, c4_quality, c4_paragraph, bad_words_fallback, bad_words_listed, bad_words_joined, gopher_metrics, gopher_quality, gopher_verdicts, gopher_summary, pipeline_decisions, document_decisions, pipeline_totals, drop_reasons, excluded_rows, first_500_decisions, decision_csv, jsonl_roundtrip, regression_diff, regression_tally, text_primitives, stage_profile, warc_read, jsonl_file, decisions_file, differences_file, kept_rows, outcome_tally, url_filtered, document_languages, repetition_counts, web_text, personal_formatted]
    return {f.__name__: f for f in own}


def whole_queries() -> dict[str, Query]:
    """Queries without SQL, tested by brute force: rows of payloads that are no UTF-8, which it cannot read, and classes found by iteration."""
    own = [near_duplicate_classes, extract_text_whole, first_500_whole, warc_decisions, warc_totals, warc_drop_reasons]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return _sql()
