def test_every_response_of_the_crawl_is_decided(spark, tmp_path):
    import __spark_entry__ as e

    page = "".join(f"<p>Sentence number {n} of the page says something.</p>\n" for n in range(6))
    rows = [("a", i, f"r{i}", "response", b"HTTP/1.1 200 OK\r\n\r\n" + (page + ("caf\xe9" if i % 2 else "")).encode("latin-1")) for i in range(620)]
    rows += [("b", 0, "none", "response", None), ("b", 1, "asked", "request", b"x")]
    df = spark.createDataFrame(rows, "path string, ordinal long, id string, type string, content binary")
    df.write.parquet(f"{tmp_path}/warc_records.parquet")
    got = {r["record_id"]: (r["status"], r["reason"]) for r in e.queries()["warc_decisions"](spark, str(tmp_path)).collect()}
    assert len(got) == 621 and got["none"] == ("dropped", "empty_text")
    assert {got[f"r{i}"] for i in range(620)} == {got["r0"]} and got["r0"][1] != "empty_text"
    total = e.queries()["warc_totals"](spark, str(tmp_path)).first()
    assert total["docs"] == 621 and total["dropped"] == sum(s == "dropped" for s, _ in got.values())
    reasons = {r["reason"]: r["n"] for r in e.queries()["warc_drop_reasons"](spark, str(tmp_path)).collect()}
    assert sum(reasons.values()) == total["dropped"] and reasons["empty_text"] == 1


def test_payloads_that_are_no_utf8_keep_their_text(spark, tmp_path):
    import __spark_entry__ as e

    rows = [("a", 0, "bad", "response", b"HTTP/1.1 200 OK\r\n\r\n<p>caf\xe9 and more</p>"), ("a", 1, "good", "response", b"\n\n<p>caf\xc3\xa9</p>"), ("a", 2, "none", "response", None)]
    df = spark.createDataFrame(rows, "path string, ordinal long, id string, type string, content binary")
    df.write.parquet(f"{tmp_path}/warc_records.parquet")
    got = {r["id"]: r["text"] for r in e.queries()["extract_text_whole"](spark, str(tmp_path)).collect()}
    assert got == {"bad": " caf\ufffd and more ", "good": " caf\xe9 ", "none": ""}
    decided = {r["record_id"]: r["reason"] for r in e.queries()["first_500_whole"](spark, str(tmp_path)).collect()}
    assert decided["none"] == "empty_text" and decided["bad"] == decided["good"] != "empty_text"
