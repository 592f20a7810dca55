"""Queries of the nine problems: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import charset, packing, pages, quality, residue, sitelines, sql, subjects, tokens, toxicity
from .common import durable, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_ids(table(spark, sf_dir, "texts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "texts")
    model = toxicity.fit(texts, table(spark, sf_dir, "labels"))
    return toxicity.scores(texts, model).where("id IS NOT NULL AND toxic").select("id").distinct()


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "texts")
    model = toxicity.fit(texts, table(spark, sf_dir, "labels"))
    return toxicity.rates(toxicity.scores(texts, model), table(spark, sf_dir, "warc_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "texts")
    lines = durable(pages.described(texts))
    model = pages.learn(lines)
    return pages.outside(texts, pages=lines, model=model).join(residue.residue_ids(texts, model=model), "id", "left_anti")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.bodies(table(spark, sf_dir, "texts"))


def p3_record_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.record_bodies(table(spark, sf_dir, "warc_records"), charset.fit(table(spark, sf_dir, "texts")))


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.restore(table(spark, sf_dir, "texts"))


def p4_record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.record_texts(table(spark, sf_dir, "warc_records"), charset.fit(table(spark, sf_dir, "texts")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charset.affected_ids(table(spark, sf_dir, "texts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.not_prose_ids(table(spark, sf_dir, "texts"))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "texts"))


def _not_counted(texts: DataFrame) -> DataFrame:
    """Ids whose lines do not count in problem 6."""
    return residue.residue_ids(texts).unionByName(charset.affected_ids(texts)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "texts")
    return sitelines.repeated_lines(texts, table(spark, sf_dir, "warc_records"), _not_counted(texts))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near-duplicate wordings: one row a wording with the cluster it is of."""
    return sitelines.near_lines(sitelines.documents(table(spark, sf_dir, "texts"), table(spark, sf_dir, "warc_records")))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text without the lines of its host's near-duplicate clusters."""
    texts = table(spark, sf_dir, "texts")
    return sitelines.without_lines(texts, sitelines.repeated_lines(texts, table(spark, sf_dir, "warc_records"), exact=False))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subjects.fit(docs, table(spark, sf_dir, "subject_labels"))
    return subjects.assign(docs, model).select("doc_id", "subject").distinct()


def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text whether it has a score."""
    texts = table(spark, sf_dir, "texts")
    scored = toxicity.scores(texts, toxicity.fit(texts, table(spark, sf_dir, "labels")))
    return scored.select("id", F.col("score").isNotNull().alias("scored"))


def p3_accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each text are either in its main body or found outside."""
    texts = table(spark, sf_dir, "texts")
    lines = durable(pages.described(texts))
    model = pages.learn(lines)
    inside = pages.bodies(texts, model=model).where("id IS NOT NULL AND body <> ''").distinct().select("id", F.size(F.split("body", "\n")).alias("n"))
    outside = pages.outside(texts, pages=lines, model=model).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return inside.unionByName(outside).groupBy("id").agg(F.sum("n").alias("lines"))


def p4_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of plain ASCII as restored."""
    texts = table(spark, sf_dir, "texts")
    plain = texts.where(F.col("text").rlike(r"\A[\x00-\x7f]*\z"))
    return charset.restore(plain, model=charset.fit(texts)).select("id", F.md5("text").alias("digest"), "affected")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.basic_counts(spread(table(spark, sf_dir, "texts")))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of each document spell."""
    return tokens.decoded(tokens.encode(table(spark, sf_dir, "documents")))


def p8_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be in the packing of all documents, counted."""
    docs = table(spark, sf_dir, "documents")
    return packing.violations(durable(packing.pack_documents(docs)), tokens.count(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p2_found, p2_rates, p2_scored, p3_found, p3_bodies, p3_record_bodies, p3_accounted, p4_found, p4_restored, p4_record_texts, p4_untouched, p5_found, p5_statistics, p5_counts, p6_found, p6_clusters, p6_texts, p7_ids, p7_decoded, p8_packed, p8_violations, p9_found)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
