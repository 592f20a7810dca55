import gzip
import json
import time

import pytest

from millrace import cli
from millrace.operators import pipeline
from millrace.sources.warc import read_warc, read_warc_binary


def warc(path, n=5, cut=False):
    out = b""
    for i in range(n):
        body = f"HTTP/1.1 200 OK\r\n\r\n<p>text {i}</p>\n".encode()
        size = len(body) + (50 if cut and i == n - 1 else 0)
        out += f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nWARC-Target-URI: http://h.example/{i}\r\nContent-Length: {size}\r\n\r\n".encode() + body + b"\r\n\r\n"
    path.write_bytes(gzip.compress(out) if path.suffix == ".gz" else out)
    return path


def test_uris_and_spark_file_systems_read_the_same(spark, tmp_path):
    f = warc(tmp_path / "a b.warc.gz")
    columns = ["ordinal", "id", "url", "type", "headers", "content_length", "content", "truncated"]
    plain = sorted(map(repr, read_warc(spark, str(f)).select(columns).collect()))
    assert len(plain) == 5
    assert sorted(map(repr, read_warc(spark, "file://" + str(f).replace(" ", "%20")).select(columns).collect())) == plain
    assert sorted(map(repr, read_warc_binary(spark, str(tmp_path / "*.gz")).select(columns).collect())) == plain
    g = warc(tmp_path / "c.warc", cut=True)
    for read in (read_warc, read_warc_binary):
        assert read(spark, str(g)).count() == 4 and read(spark, str(g), keep_truncated=True).where("truncated").count() == 1
        assert read(spark, str(g), content=False).where("content IS NULL").count() == 4


def test_rates_time_the_work(spark, tmp_path, capsys, monkeypatch):
    f = warc(tmp_path / "a.warc")
    real = pipeline.tally

    def slow(outcome):
        time.sleep(0.7)
        return real(outcome)

    monkeypatch.setattr(cli.pipeline, "tally", slow)
    began = time.time()
    assert cli.main(["pipeline", str(f), "--csv-output", str(tmp_path / "out"), "--kept-output", str(tmp_path / "kept"), "--excluded-output", str(tmp_path / "gone"), "--profile"]) == 0
    took = time.time() - began
    lines = capsys.readouterr().out.strip().split("\n")
    said = json.loads(lines[0])
    assert (said["docs"], said["kept"], said["dropped"]) == (5, 0, 5) and 0.7 <= said["elapsed_sec"] <= took
    assert said["docs_sec"] == pytest.approx(5 / said["elapsed_sec"])
    assert "too_few_sentences\t5" in lines and {x.split("\t")[0] for x in lines[-4:]} == set(pipeline.STAGES)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 5
    assert {(r["stage"], r["reason"]) for r in spark.read.json(str(tmp_path / "gone")).collect()} == {("quality", "too_few_sentences")}


def test_long_lists_take_several_regexes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from millrace.operators import c4

    df = spark.createDataFrame([("b then a",), ("c",), ("none",), (None,)], "t string")
    want = [r[0] for r in df.select(c4.bad_word_reason(F.col("t"), ["c", "a", "b"])).collect()]
    monkeypatch.setattr(c4, "ENTRIES_A_REGEX", 1)
    assert [r[0] for r in df.select(c4.bad_word_reason(F.col("t"), ["c", "a", "b"])).collect()] == want == ["badword: a", "badword: c", "", None]
