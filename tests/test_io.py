import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace import cli, sinks, streaming
from millrace.operators import compare, extract, pipeline
from millrace.sources import text as src
from millrace.sources.warc import read_warc, read_warc_binary


def record(kind, rid, payload, extra="", size=None):
    n = len(payload) if size is None else size
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{extra}Content-Length: {n}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def two():
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    return record("response", "<urn:uuid:1>", head + b"The quick brown fox jumps over the lazy dog.\n", "WARC-Target-URI:   http://a/\r\n") + record("response", "<urn:uuid:2>", head + b" \n")


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("reader", [read_warc, read_warc_binary])
def test_two_records(spark, tmp_path, zipped, reader):
    p = tmp_path / ("a.warc.gz" if zipped else "a.warc")
    data = record("warcinfo", "<i>", b"x") + two()
    p.write_bytes(gzip.compress(data[:300]) + gzip.compress(data[300:]) if zipped else data)
    df = reader(spark, str(p))
    rows = df.orderBy("ordinal").collect()
    assert [r["type"] for r in rows] == ["warcinfo", "response", "response"]
    assert rows[1]["url"] == "http://a/" and rows[1]["headers"]["WARC-Type"] == "response"
    got = sorted(map(tuple, pipeline.decisions(extract.extract_texts(df)).collect()))
    assert got == [("<urn:uuid:1>", "dropped", "too_few_sentences"), ("<urn:uuid:2>", "dropped", "too_few_sentences")]
    assert pipeline.totals(extract.extract_texts(df)).first()["docs"] == 2


def test_warc_dirt(spark, tmp_path):
    odd = b"junk line\r\n" + record("response", "<1>", b"", "X: 1\r\nX: 2\r\nno colon here\r\n") + record("request", "<2>", b"abc") + record("response", "<3>", b"cut", size=99)
    (tmp_path / "a.warc").write_bytes(odd)
    path = str(tmp_path / "a.warc")
    rows = read_warc(spark, path).orderBy("ordinal").collect()
    assert [(r["id"], bytes(r["content"])) for r in rows] == [("<1>", b""), ("<2>", b"abc")]
    assert rows[0]["headers"]["X"] == "2"
    assert read_warc(spark, path, response_only=True).count() == 1
    assert read_warc(spark, path, keep_truncated=True).where("truncated").first()["id"] == "<3>"
    assert read_warc(spark, path, content=False).where("content is not null").count() == 0
    with pytest.raises(Exception, match="no WARC file"):
        read_warc(spark, str(tmp_path / "none*")).count()
    (tmp_path / "empty.warc").write_bytes(b"")
    assert read_warc(spark, str(tmp_path / "empty.warc")).count() == 0


def test_jsonl(spark, tmp_path):
    rows = [("a", 'x "y"\n\t\\ é \x01 日'), ("b", ""), ("c,\"", "z")]
    df = spark.createDataFrame(rows, "id string, text string")
    sinks.write_jsonl(df, str(tmp_path / "out"), compression="gzip")
    assert sorted(map(tuple, src.read_jsonl(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"id":"1","text":"a\\u2026"}\nnot json\n\n{"text":"only"}\n')
    assert sorted((r["id"] or "", r["text"]) for r in src.read_jsonl(spark, str(tmp_path / "x.jsonl.gz")).collect()) == [("", "only"), ("1", "a…")]
    assert src.read_jsonl(spark, str(tmp_path / "x.jsonl.gz"), keep_bad=True).count() == 3


def test_seven_batch_texts(spark, tmp_path):
    b = "the quick brown fox jumps over the lazy dog"
    texts = [b + ".", "hello world # # #", "alpha beta gamma delta epsilon", "......", "- a\n- b\n- c\n- d", "short", (b + ". ") * 3]
    with gzip.open(tmp_path / "t.jsonl.gz", "wt") as f:
        f.writelines(json.dumps({"id": f"id{i}", "text": t}) + "\n" for i, t in enumerate(texts))
    got = pipeline.gopher_summary(src.read_jsonl(spark, str(tmp_path / "t.jsonl.gz"))).first()
    assert (got["docs"], got["kept"]) == (7, 0)


def test_bad_word_list(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_bytes("bad \r\n\n  \nWorse\nzwei wörter\t\n".encode())
    assert src.read_bad_words(spark, str(p)) == ("bad", "Worse", "zwei wörter")
    p.write_bytes(b"")
    assert src.read_bad_words(spark, str(p)) == ()
    assert src.read_bad_words(spark, None) == ("porn", "xxx", "sex")


def test_decisions_and_comparison(spark, tmp_path):
    base = spark.createDataFrame([("a", "kept", ""), ("b", "dropped", 'r,"1"'), ("c", "kept", ""), ("d", "dropped", "x"), ("d", "kept", "")], "record_id string, status string, reason string")
    curr = spark.createDataFrame([("a", "kept", ""), ("b", "dropped", "r2"), ("d", "dropped", "y"), ("e", "kept", "")], base.schema)
    sinks.write_decisions(base.coalesce(1), str(tmp_path / "b"))
    back = src.read_decisions(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, back.drop("line").collect())) == sorted(map(tuple, base.collect()))
    got = {r["id"]: tuple(r)[1:] for r in compare.diff(back, curr, "line").collect()}
    assert got == {
        "b": ("reason_mismatch", 'r,"1"', "r2", None, None),
        "c": ("missing_in_current", None, None, None, None),
        "d": ("status_mismatch", "kept", "dropped", "", "y"),
        "e": ("extra_in_current", None, None, None, None),
    }
    sinks.write_differences(compare.diff(back, curr, "line"), str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).columns == ["base", "curr", "id", "reason_base", "reason_curr", "type"]
    (tmp_path / "bad.csv").write_text("record_id,status\na,kept\n")
    with pytest.raises(ValueError, match="reason"):
        src.read_decisions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "noid.csv").write_text("record_id,status,reason\n,kept,\n")
    with pytest.raises(Exception, match="without record_id"):
        src.read_decisions(spark, str(tmp_path / "noid.csv")).collect()
    assert compare.diff(base.limit(0), curr.limit(0)).count() == 0


def test_excluded_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", "x")], "id string, text string")
    sinks.write_excluded(pipeline.excluded(df), str(tmp_path / "x"))
    assert {r["stage"] for r in spark.read.json(str(tmp_path / "x")).select("stage").collect()} == {"empty", "quality"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), t) for i, t in enumerate(["", "short", "the quick " * 40, None])]
    df = spark.createDataFrame(rows, "id string, text string")
    sinks.write_jsonl(df.repartition(3), str(tmp_path / "in"))
    stream = streaming.jsonl_stream(spark, str(tmp_path / "in"), 1)
    streaming.run_available(streaming.decide(stream), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(pipeline.decisions(df))
    streaming.gopher_counts(stream).writeStream.format("memory").queryName("g").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.table("g")) == key(pipeline.gopher_summary(df))
    streaming.running_reasons(streaming.decide(stream)).writeStream.format("memory").queryName("r").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.table("r")) == key(pipeline.drop_reasons(pipeline.decisions(df)))
    streaming.run_available(streaming.gopher_verdicts(stream), str(tmp_path / "v"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.warc").write_bytes(two())
    assert cli.main(["pipeline", str(tmp_path / "a.warc"), "--csv-output", str(tmp_path / "o"), "--threads", "2"]) == 0
    assert "too_few_sentences\t2" in capsys.readouterr().out
    assert cli.main(["extract", str(tmp_path / "a.warc"), "--limit", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["id"] == "<urn:uuid:1>"
    assert cli.main(["extract", str(tmp_path / "a.warc"), "--output", str(tmp_path / "j")]) == 0
    assert cli.main(["gopher", str(tmp_path / "j"), "--limit", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["docs"] == 1
    monkeypatch.setattr("sys.stdin", __import__("io").StringIO("hello world"))
    cli.main(["gopher-one"])
    assert capsys.readouterr().out == "drop\tgopher_short_doc\n"
    assert cli.main(["compare", str(tmp_path / "o"), str(tmp_path / "o")]) == 0


def test_csv_line(spark):
    df = spark.createDataFrame([("a", 'b"c', "d,e")], "x string, y string, z string")
    assert df.select(sinks.csv_line(F.col("x"), F.col("y"), F.col("z"))).first()[0] == 'a,"b""c","d,e"'
