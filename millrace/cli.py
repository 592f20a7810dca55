"""Command line: ``pipeline``, ``extract``, ``gopher``, ``gopher-one``, ``compare``.

Paths may be local or of any file system Spark reaches. ``--threads`` sets the local
parallelism of a session started here (0 or less: all cores); results never depend on it.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Pipeline
from .operators import compare, extract, gopher, pipeline
from .sinks import write_decisions, write_differences, write_excluded, write_jsonl
from .sources.text import one_document, read_bad_words, read_decisions, read_jsonl
from .sources.warc import read_warc


def session(threads: int) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = "*" if threads <= 0 else str(threads)
    return SparkSession.builder.master(f"local[{n}]").config("spark.ui.enabled", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("pipeline", "extract", "gopher"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--limit", type=int, default=-1)
        s.add_argument("--threads", type=int, default=0)
        if name == "pipeline":
            s.add_argument("--csv-output")
            s.add_argument("--bad-words")
            s.add_argument("--kept-output")
            s.add_argument("--excluded-output")
            s.add_argument("--profile", action="store_true")
        if name == "extract":
            s.add_argument("--output")
    sub.add_parser("gopher-one")
    s = sub.add_parser("compare")
    s.add_argument("base")
    s.add_argument("current")
    s.add_argument("--report")
    return p


def _report(summary: dict[str, int], seconds: float) -> str:
    """A summary with the rates of the work that made it, as a JSON line."""
    rate = lambda x: x / seconds if seconds > 0 else 0.0
    return json.dumps({**summary, "elapsed_sec": seconds, "docs_sec": rate(summary["docs"]), "mib_sec": rate(summary["bytes"] / 1048576)})


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(getattr(a, "threads", 0))
    began = time.time()
    if a.command == "pipeline":
        records = extract.first_responses(read_warc(spark, a.input, response_only=True), a.limit)
        texts = extract.extract_texts(records)
        cfg = Pipeline(bad_words=read_bad_words(spark, a.bad_words))
        # One pass over the crawl: what is kept of a record are its decision and a size.
        outcome = pipeline.outcomes(texts, cfg=cfg).persist(StorageLevel.DISK_ONLY)
        if a.csv_output:
            write_decisions(outcome, a.csv_output, "overwrite")
        counts = sorted(pipeline.tally(outcome).collect())
        docs, kept = sum(r["n"] for r in counts), sum(r["n"] for r in counts if r["reason"] == "")
        print(_report({"docs": docs, "kept": kept, "dropped": docs - kept, "bytes": sum(r["bytes"] for r in counts)}, time.time() - began))
        for r in counts:
            if r["reason"]:
                print(f"{r['reason']}\t{r['n']}")
        outcome.unpersist()
        if a.kept_output:
            write_jsonl(pipeline.kept(texts, cfg=cfg).withColumnRenamed("record_id", "id"), a.kept_output, "overwrite")
        if a.excluded_output:
            write_excluded(pipeline.excluded(texts, cfg=cfg), a.excluded_output, "overwrite")
        if a.profile:
            for r in pipeline.profile(pipeline.timed_stages(records, cfg)).orderBy("stage").collect():
                print(f"{r['stage']}\t{r['total_ms']:.1f}\t{r['calls']}\t{r['avg_ms']:.1f}")
    elif a.command == "extract":
        texts = extract.extract_texts(extract.first_responses(read_warc(spark, a.input, response_only=True), a.limit))
        if a.output:
            write_jsonl(texts, a.output, "overwrite")
        else:
            for line in texts.orderBy("path", "ordinal").select(F.to_json(F.struct("id", "text"))).toLocalIterator():
                print(line[0])
    elif a.command == "gopher":
        rows = read_jsonl(spark, a.input).withColumn("_at", F.monotonically_increasing_id())
        summary = pipeline.gopher_summary(pipeline.first_texts(rows, a.limit, ["_at"])).first().asDict()
        print(_report(summary, time.time() - began))
    elif a.command == "gopher-one":
        print(gopher.quality(one_document(spark, sys.stdin.read())).select(gopher.verdict(F.col("gopher_reason"))).first()[0])
    else:
        found = compare.diff(read_decisions(spark, a.base), read_decisions(spark, a.current), "line", "line")
        if a.report:
            write_differences(found, a.report, "overwrite")
        counts = compare.tally(found).orderBy("type").collect()
        for r in counts:
            print(f"{r['type']}\t{r['n']}")
        for r in found.limit(10).collect():
            print(r.asDict())
        return 1 if counts else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
