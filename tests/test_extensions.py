import random

from pyspark.sql import functions as F

from millrace.operators import extensions as X


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS cluster0", "0 AS signature0")


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        docs.append(" ".join(base))
        for _ in range(i % 3):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"
            docs.append(" ".join(copy))
    docs += [docs[0], "two words", "two words", ""]
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (None, "two words"), (901, "  \n")]
    got = {r["doc_id"]: r["cluster"] for r in X.near_duplicates(frame(spark, rows), "doc_id").collect()}
    assert len(got) == len(docs) + 2 and got[900] == 900 and got[901] == 901
    sets = []
    for t in docs:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + X.SHINGLE]) for k in range(max(1, len(w) - X.SHINGLE + 1))} if w else set())
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    # Nothing unlike is in one class.
    assert all(got[a] != got[b] or sets[a] & sets[b] for a in range(len(docs)) for b in range(a) if sets[a] and sets[b])
    assert got[len(docs) - 1] == len(docs) - 1
    left = {r[0] for r in X.first_of_class(X.near_duplicates(frame(spark, rows), "doc_id"), "doc_id").collect()}
    assert left == set(got.values())
    assert X.near_duplicates(frame(spark, rows).limit(0), "doc_id").count() == 0


def test_row_local_steps(spark):
    rows = [(1, "The cat is in the garden and it was with the dog."), (2, "Der Hund ist nicht mit dem Kind"), (3, "町はまだ"), (4, ""), (5, None), (6, "xyz")]
    got = {r["doc_id"]: r["language"] for r in frame(spark, rows).select("doc_id", X.language(F.col("text")).alias("language")).collect()}
    assert got == {1: "en", 2: "de", 3: "ja", 4: "", 5: None, 6: ""}
    assert {r["doc_id"] for r in X.language_filter(frame(spark, rows), ("en", "ja")).collect()} == {1, 3}
    text = spark.createDataFrame([("write to a.b+c@mail.example.org or 10.0.0.255, not 300.1.1.1 or 1.2.3",), (None,)], "t string")
    assert [r[0] for r in text.select(X.format_personal(F.col("t"))).collect()] == ["write to email@example.com or 192.0.2.1, not 300.1.1.1 or 1.2.3", None]
    urls = spark.createDataFrame([("http://u@Bad.example:80/x",), ("https://good.example/",), (None,), ("no url",)], "url string")
    blocked = spark.createDataFrame([("BAD.example",), (None,)], "host string")
    assert [r[0] for r in X.url_filter(urls, blocked).collect()] == ["https://good.example/", None, "no url"]


def test_repetition(spark):
    rows = [(1, "a b\na b\nc\n\na b"), (2, None), (3, ""), (4, "x y z x y z x y")]
    got = {r["doc_id"]: r for r in X.repetition(frame(spark, rows)).withColumn("reason", X.repetition_reason()).collect()}
    assert (got[1]["lines"], got[1]["duplicate_lines"], got[1]["paragraphs"], got[1]["duplicate_paragraphs"]) == (4, 2, 2, 0)
    assert got[1]["reason"] == "duplicate_lines" and got[2]["reason"] is None and got[3]["reason"] == ""
    assert (got[4]["top_2_chars"], got[4]["top_3_chars"], got[4]["top_4_chars"]) == (9, 10, 14)
    prose = "\n".join(f"Sentence number {i} is about as long as a line of prose is." for i in range(9))
    say = lambda t: frame(spark, [(1, t)]).select(X.web_text_reason(F.col("text"))).first()[0]
    assert say(prose) == "" and say("one\ntwo\nthree") == "line_punctuation" and say("a.\nb.\nc.") == "short_lines" and say(prose + "\n" + prose) == "repeated_lines" and say(" \n") == "no_lines" and say(None) is None
