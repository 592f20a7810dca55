import random

import model
import pytest
from pyspark.sql import functions as F

from millrace.config import C4Quality, Gopher, Pipeline
from millrace.operators import c4, extract, gopher, pipeline

L = " ".join(["Some words here that make the paragraph long enough"] * 6)
B = "the quick brown fox jumps over the lazy dog"
PIECES = ["the", "of", "that", "word", "...", "…", "#", "-", "•", ".", "?", "[1]", "[edit]", "[citation needed]", "[]", "[[1]]", "{", "JavaScript", "lorem ipsum", "Lorem Ipsum", "privacy policy", "use coOKies", "é", "日本語", "x" * 1001, "\t", " ", "  ", "\r", "\n", "\n\n", "\r\n", "\f", "\x0b", " ", "porn", "XXX", "sex_", "assex", "123", "(", '"', "'"]


def hostile(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "\n", "\r\n", "."]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5:
            out.append("".join(rng.choice(PIECES) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 120))))
        else:
            end = lambda: rng.choice([".", "!", "...", "", ' x"', "'"])
            out.append("\n".join(f"{rng.choice([L, L, B, B + ' with it'])} {rng.choice(PIECES[:40])}{end()}" for _ in range(rng.randint(3, 14))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = hostile(400, 7)
    return texts, spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)


def by_n(df, col):
    return [r[col] for r in df.orderBy("n").collect()]


def test_c4_matches_the_model(docs):
    texts, df = docs
    got = c4.quality(df).orderBy("n").collect()
    want = [model.c4(t) for t in texts]
    assert [(r["c4_reason"], r["c4_text"]) for r in got] == want
    assert {w for w, _ in want} == {"", "too_few_sentences", "lorem_ipsum", "curly_bracket"}


def test_paragraph_bad_words_gopher_and_chain_match_the_model(docs):
    texts, df = docs
    entries = ("porn", "xxx", "sex", "word here", "the quick", "quick brown fox")
    out = df.select("n", c4.paragraph_reason(F.col("text")).alias("p"), c4.bad_word_reason(F.col("text"), entries).alias("b"))
    assert by_n(out, "p") == [model.paragraphs(t) for t in texts]
    assert by_n(out, "b") == [model.bad_word(t, entries) for t in texts]
    assert by_n(gopher.quality(df), "gopher_reason") == [model.gopher(t) for t in texts]
    assert by_n(pipeline.chain(df), "reason") == [model.pipeline(t) for t in texts]


def test_joined_bad_words_agree_with_the_expression(spark, docs):
    texts, df = docs
    entries = ["porn ", "XXX", "sex", "", "quick brown fox", "日本", "…", "porn"]
    table = spark.createDataFrame(list(enumerate(entries)), "entry_no int, entry string")
    joined = c4.bad_words_by_join(df, table, "n")
    assert by_n(joined, "reason") == [model.bad_word(t, [e for e in c4.read_bad_words(entries) if e != "XXX"]) for t in texts]


def test_results_do_not_depend_on_partitions(docs):
    _, df = docs
    one, many = pipeline.decisions(df.coalesce(1), "n"), pipeline.decisions(df.repartition(8), "n")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


@pytest.mark.parametrize(
    "text, reason",
    [
        (" ".join([B] * 7), ""),
        ("hello world", "gopher_short_doc"),
        (" ".join(["content"] * 60 + ["#"] * 10), "gopher_too_many_hashes"),
        ("\n".join([f"- bullet text {B}"] * 12), "gopher_too_many_bullets"),
        ("\n".join([f"{B}..."] * 4 + [B] * 6), "gopher_too_many_end_ellipsis"),
        (" ".join(["123"] * 40 + ["word"] * 10 + ["the"] * 10), "gopher_below_alpha_threshold"),
        (" ".join(["alpha"] * 60 + ["..."] * 10), "gopher_too_many_ellipsis"),
        (" ".join(["alpha"] * 60), "gopher_enough_stop_words"),
        ("\n".join([f"• x {B}"] * 12), "gopher_too_many_bullets"),
        ("\n".join([f"{B}…"] * 4 + [B] * 6) + "\n" * 6, ""),
        ("", "gopher_short_doc"),
        (" ".join(["the"] * 60), ""),
        (" ".join(["be"] * 60), "gopher_below_avg_threshold"),
        (" ".join(["abcdefghij"] * 58 + ["the", "that"]), ""),
        (" ".join(["the of"] * 50_001), "gopher_long_doc"),
    ],
)
def test_gopher_cases(spark, text, reason):
    df = spark.createDataFrame([(text,)], "text string")
    assert gopher.quality(df).first()["gopher_reason"] == reason == model.gopher(text)


@pytest.mark.parametrize(
    "text, reason",
    [
        ("\n".join([f"{L} [1]."] * 6), ""),
        ("\r\n".join([f"{L} [citation needed]."] * 6), ""),
        ("\n".join([f"{L} [[1]] x."] * 5), ""),
        ("\n".join([f"{L}."] * 5 + ["Here is JavaScript { code on one line."]), ""),
        ("\n".join([f"{L}."] * 5 + ["This has a { curly on the line."]), "curly_bracket"),
        ("\n".join([f"{L}."] * 5 + ["Lorem ipsum dolor sit amet."]), "lorem_ipsum"),
        ("\n".join([f"{L}."] * 5 + ["we ask you to use cooKies today now.", f"{L} {'y' * 1200}."]), ""),
        ("\n".join([f"{L}."] * 5 + ["this text mentions XXX and sex here_porn."]), "badword: porn"),
        ("", "empty_text"),
        (" ", "too_few_sentences"),
    ],
)
def test_chain_cases(spark, text, reason):
    df = spark.createDataFrame([("a", text)], "id string, text string")
    got = pipeline.chain(df).first()
    assert got["reason"] == reason
    if reason == "":
        assert "\r" not in got["final_text"] and "JavaScript" not in got["final_text"] and "cooKies" not in got["final_text"]


def test_parameters(spark):
    df = spark.createDataFrame([("\n".join(["one two three four five six"] * 6),)], "text string")
    assert c4.quality(df).first()["c4_reason"] == "too_few_sentences"
    assert c4.quality(df, cfg=C4Quality(terminal_punctuation=False)).first()["c4_reason"] == ""
    assert gopher.quality(df, cfg=Gopher(min_words=0, min_stop_words=0)).first()["gopher_reason"] == ""
    assert gopher.quality(spark.createDataFrame([("! ! !",)], "text string"), cfg=Gopher(min_words=0)).first()["gopher_reason"] == "gopher_below_avg_threshold"


def test_empty_list_of_bad_words_keeps_everything(spark):
    df = spark.createDataFrame([("porn xxx",), (None,)], "text string")
    assert [r[0] for r in df.select(c4.bad_word_reason(F.col("text"), ())).collect()] == ["", None]
    assert c4.read_bad_words(None) == ("porn", "xxx", "sex") and c4.read_bad_words([]) == ()


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(1, None, "x", "y"), (1, None, "x", "y"), (2, "", "x", "y")]
    df = spark.createDataFrame(rows, "id int, text string, reason string, status string")
    assert sorted((r["record_id"], r["status"], r["reason"]) for r in pipeline.decisions(df).collect()) == [(1, "dropped", "empty_text")] * 2 + [(2, "dropped", "empty_text")]
    none = df.limit(0)
    assert pipeline.decisions(none).count() == 0
    assert pipeline.totals(none).first().asDict() == {"docs": 0, "kept": 0, "dropped": 0, "bytes": 0}
    assert pipeline.gopher_summary(none).first().asDict() == {"docs": 0, "kept": 0, "bytes": 0}
    assert c4.quality(df.select("text")).where("text is null").first()["c4_reason"] is None
    assert gopher.quality(df.select("text")).where("text is null").first()["gopher_reason"] is None


def test_totals_histogram_and_report(spark):
    texts = ["\n".join([f"{L}."] * 6), "short", "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    total = pipeline.totals(df)
    assert total.first().asDict() == {"docs": 4, "kept": 1, "dropped": 3, "bytes": sum(len(t) for t in texts)}
    hist = pipeline.drop_reasons(pipeline.decisions(df)).orderBy("reason").collect()
    assert [tuple(r) for r in hist] == [("empty_text", 1), ("too_few_sentences", 2)]
    rep = pipeline.report(total, 2.0).first()
    assert rep["docs_sec"] == 2.0 and pipeline.report(total, 0.0).first()["docs_sec"] == 0.0
    prof = pipeline.profile(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "stage string, ms double")).first()
    assert (prof["total_ms"], prof["calls"], prof["avg_ms"]) == (4.0, 2, 2.0)
    assert {r["stage"] for r in pipeline.excluded(df).collect()} == {"quality", "empty"}


def test_extraction_cases(spark):
    pages = [
        (b"H: x\r\n\r\n<p>a</p>", " a "),
        (b"H: x\n\n<p>a</p>", " a "),
        (b"no header <b", "no header "),
        (b"a\n\nb\r\n\r\nc", "c"),
        (b"a<b\nc>d<e", "a d"),
        (b"", ""),
        (None, ""),
        (b"\r\n\r\n\xff<i>", "� "),
        (b"\r\n\r\na<b<c>d>e", "a d>e"),
    ]
    df = spark.createDataFrame([("p", i, str(i), "response", c) for i, (c, _) in enumerate(pages)] + [("p", 99, "q", "request", b"x")], "path string, ordinal long, id string, type string, content binary")
    assert [r["text"] for r in extract.extract_texts(df).orderBy("ordinal").collect()] == [t for _, t in pages]
    assert extract.extract_texts(df, "null").where("text is null").count() == 1
    got = df.where("type = 'response'").select("ordinal", extract.body_bytes(F.col("content")).alias("b")).orderBy("ordinal").collect()
    assert [(r["b"]["start"], r["b"]["size"]) for r in got][:4] == [(8, 8), (6, 8), (0, 12), (8, 1)]
    assert [extract.first_responses(df, n).count() for n in (-1, 0, 3, -5, 100)] == [9, 0, 3, 0, 9]


def test_plans_are_narrow_and_prune_columns(spark, tmp_path):
    spark.createDataFrame([("a", "b", 1)], "id string, text string, unread int").write.parquet(str(tmp_path / "t"))
    plan = pipeline.decisions(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "unread" not in plan


def test_pipeline_config_is_a_value():
    assert Pipeline() == Pipeline() and hash(Pipeline()) == hash(Pipeline())
