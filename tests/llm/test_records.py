from millrace.llm import charset, pages


def test_bytes_are_decoded_before_any_replacement(spark):
    texts = spark.createDataFrame([(f"t{i}", "почему отчёт важнее чем проект город\nsegún la solución todavía necesita más atención") for i in range(9)], "id string, text string")
    model = charset.fit(texts)
    ru, es = "почему отчёт важнее", "según la solución todavía"
    html = lambda t: f"<p>{t}</p>"
    rows = [
        ("declared", b"HTTP/1.1 200\r\nContent-Type: text/html; charset=windows-1251\r\n\r\n" + html(ru).encode("cp1251"), ru),
        ("meta", b"HTTP/1.1 200\n\n" + ('<meta charset="koi8-r">' + html(ru)).encode("koi8-r"), ru),
        ("untrue", b"HTTP/1.1 200\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + html(ru).encode("cp1251"), ru),
        ("undeclared", html(es).encode("cp1252"), es),
        ("utf8", b"HTTP/1.1 200\r\n\r\n" + html(es).encode(), es),
        ("last", b"<p>caf\xe9", "café"),
        ("cut", "<p>según la soluci".encode() + b"\xc3", "según la soluci�"),
        ("garbled", html(es.encode().decode("cp1252")).encode(), es),
    ]
    df = spark.createDataFrame([("p", n, i, "response", c) for n, (i, c, _) in enumerate(rows)] + [("p", 99, "null", "response", None)], "path string, ordinal long, id string, type string, content binary")
    got = {r["id"]: r["text"] and r["text"].strip() for r in charset.record_texts(df, model).collect()}
    assert got == {i: t for i, _, t in rows} | {"null": None}
    bodies = {r["id"]: r["body"] for r in pages.record_bodies(df, model).collect()}
    assert all(bodies[i] == t for i, _, t in rows if i not in ("garbled", "cut")) and bodies["null"] is None
    assert pages.record_bodies(df.where("id = 'declared'")).first()["body"] == ru


def test_results_are_registered():
    from millrace.llm import queries

    assert {"p3_bodies", "p3_record_bodies", "p4_restored", "p4_record_texts", "p6_texts"} <= set(queries.queries())


def test_records_beyond_the_table(spark):
    words = "según la solución todavía necesita más atención después reunión año canción niño también opinión".split()
    texts = spark.createDataFrame([(f"t{i}", " ".join(words[i % 7 :] + words[: i % 7])) for i in range(40)], "id string, text string")
    good = "<p>" + " ".join(words) + "</p>"
    raw = [good.encode("cp1252"), good.encode("mac_roman"), good.encode().decode("cp1252").encode(), good.replace("canción", "canci�n").encode(), good.encode(), b"plain", b"", None]
    df = spark.createDataFrame([("f", i, f"r{i}", "response", x) for i, x in enumerate(raw)], "path string, ordinal long, id string, type string, content binary")
    whole, few = charset.fit(texts), charset.fit(texts, size=2)
    assert whole.rest is None and few.rest is not None
    want = {r["id"]: (r["text"], r["affected"]) for r in charset.record_texts(df, whole).collect()}
    assert all(want[f"r{i}"][0].strip() == " ".join(words) for i in range(5)) and want["r2"][1] and want["r3"][1]
    assert {r["id"]: (r["text"], r["affected"]) for r in charset.record_texts(df, few).collect()} == want
    bodies = [{r["id"]: r["body"] for r in pages.record_bodies(df, m).collect()} for m in (whole, few)]
    assert bodies[0] == bodies[1]
