import random

import pytest

from millrace.llm import pages, residue

TALE = "The old keeper said that the lamp had been lit every night of the year, and that nobody in the village thought it strange."
NOUNS = "lamp river mill boat garden bridge letter window harbour bell".split()
TITLES = ["What the keeper taught the {a} about the {b}", "The quiet {a} of Northtown and the {b}", "How Anna Smith moved a {a} and a {b}"]
TOP = [" p{margin:0} ", "  ", " This site uses cookies. Accept all. ", " Home ", " News "]
TAIL = [" Back to top ", " Most read this week ", " Tell a friend about this page ", " © 2024 Some Daily. All rights reserved. ", "  "]
PROMPTS = [" Tell a friend about this page ", " Most read this week "]


def tale(rng):
    n = lambda: rng.choice(NOUNS)
    return f"The old {n()} stood by the {n()} for {rng.randint(2, 90)} years, and nobody in the {n()} thought that the {n()} would be moved to the {n()} before the winter came. After the {n()}, most of the {n()} was quiet."


def title(rng):
    return rng.choice(TITLES).format(a=rng.choice(NOUNS), b=rng.choice(NOUNS))


def page(body, seams=True, nl="\n", rng=None):
    tail = [*TAIL[:2], *([f" {title(rng)} " for _ in range(4)] if rng else []), *TAIL[2:]]
    seam = [" "] if seams else []
    return nl.join(TOP + seam + body + seam + tail)


def site(n=60, seed=1, seams=True, body=None):
    """``(text, lines outside)`` of pages of one kind of site."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = [f" {title(rng)} ", " By the Some Daily newsroom ", f" Published: {i % 28 + 1}/1/2024 ", *(f" {tale(rng)}" for _ in range(rng.randint(3, 6)))]
        if body:
            own = own[:3] + body(i)
        elif i % 3 == 0:
            own.insert(4, PROMPTS[i % 2])
            own.insert(6, f" See too: {title(rng)} ")
        text = page(own, seams, "\r\n" if i % 5 == 0 else "\n", rng)
        lines = text.split("\n")
        inside = {x.strip() for x in own} - {x.strip() for x in PROMPTS}
        out.append((text, [j for j, x in enumerate(lines) if x.strip() and (x.strip() not in inside or x.strip().startswith("See too"))]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def test_bodies_are_learnt_from_the_pages(spark):
    made = site()
    df = frame(spark, [(f"t{i}", t) for i, (t, _) in enumerate(made)])
    want = {(f"t{i}", n) for i, (_, out) in enumerate(made) for n in out}
    got = {(r["id"], r["line_no"]) for r in pages.outside(df).collect()}
    assert got == want
    # The same with the wordings joined instead of sent to the workers, as beyond the table's bound.
    few = pages.fit(df, table=2)
    assert few.rare is not None
    joined = {(r["id"], r["line_no"]) for r in pages.outside(df, model=few).collect()}
    assert len(joined & want) > 0.97 * len(want) and len(joined - want) < 0.03 * len(want)
    body = {r["id"]: r["body"].split("\n") for r in pages.bodies(df, model=few).collect()}
    assert all("Back to top" not in b and len(b) >= 5 for b in body.values())


def test_without_seams(spark):
    known = pages.fit(frame(spark, [(f"t{i}", t) for i, (t, _) in enumerate(site())]))
    made = site(40, 2, seams=False)
    df = frame(spark, [(f"t{i}", t) for i, (t, _) in enumerate(made)])
    want = {(f"t{i}", n) for i, (_, out) in enumerate(made) for n in out}
    for model, least in ((known, 0.9), (None, 0.8)):
        got = {(r["id"], r["line_no"]) for r in pages.outside(df, model=model).collect()}
        assert len(got & want) >= least * len(want) and len(got & want) >= least * len(got)


def test_surge_and_dive_of_line_lengths():
    assert pages.surge([5, 9, 300, 400, 350, 4, 8, 40]) == (2, 5)
    assert pages.surge([3]) == (0, 1)
    assert pages.first_span([], []) == (0, 0)
    assert pages.first_span([5, 9, 30, 400, 350, 4, 8, 40], [2, 6]) == (2, 6)


def test_a_bare_article_is_all_body():
    w = pages.Weights()
    for text in ("A headline\n\n" + "\n".join([TALE] * 5), "", "\n\n", "Two words"):
        lines, keep = pages.body_lines(text, w)
        assert [pages.number(k) for k in keep] == [i for i, x in enumerate(lines) if x.strip()]


def test_credit_below_the_article_belongs_to_it():
    w = pages.Weights(layouts={"3,1,2": 5.0})
    text = page([f" {TALE}"])
    lines = text.split("\n")
    at = lines.index(" Back to top ")
    lines.insert(at, " Harbour pictures by Some Body ")
    assert at in pages.body_lines("\n".join(lines), w)[1] and at not in pages.body_lines(text, w)[1]


def test_wordings():
    assert pages.masked(" Tell  Anna Smith about 12 of the pages. ") == "tell N about 0 of the pages".lower()
    assert pages.masked("Some Daily編集部") == "some n編集部"
    assert pages.masked("A &amp; B") == "a & n"


def test_markup_is_stripped_by_line():
    assert pages.strip_markup("a<b\nc>d") == "a \nd"
    assert pages.strip_markup("<p>x</p>\n<") == " x \n"


def test_frames(spark):
    rows = [("a", page([f" {TALE}"])), ("a", page([f" {TALE}"])), ("b", None), ("c", ""), (None, "x"), ("d", "\n \n")]
    df = frame(spark, rows).selectExpr("*", "1 AS line_no", "'z' AS _lines", "0 AS uid", "0 AS rare")
    got = pages.outside(df).collect()
    assert len(got) == len({(r["id"], r["line_no"]) for r in got}) and {r["id"] for r in got} <= {"a"}
    assert pages.outside(df.limit(0)).count() == 0
    body = {r["id"]: r["body"] for r in pages.bodies(df.where("id is not null")).collect()}
    assert TALE in body["a"] and body["b"] is None and body["c"] == ""
    rec = spark.createDataFrame([("p", 1, "a", "response", b"HTTP/1.1 200\r\n\r\n<p>" + TALE.encode() + b"</p>"), ("p", 2, "b", "request", b"x"), ("p", 3, "c", "response", None)], "path string, ordinal long, id string, type string, content binary")
    assert {r["id"]: r["body"] for r in pages.record_bodies(rec).collect()} == {"a": TALE, "c": None}


def ids(spark, rows):
    return {r[0] for r in residue.residue_ids(frame(spark, rows)).collect()}


SLOTS = ["Dear {{first_name}}, welcome back to us.", "[INSERT CITY]", "Price: %%price%%", "The report ${title} was late again.", "[[headline]]", "__city__", "__event_place__", "{EVENT_PLACE}", "Hello {{ }} and welcome.", "Lorem ipsum dolor sit amet elit sed.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia."]
SPOKEN = ["In the template, the tag {{{{ {x}.title }}}} prints the name, and {n} shows how to escape it.", "The variable ${{{x}}} in the shell script was never set, so {n} added a default."]
REAL = ["Dora Hill sets dummy text, the old lorem ipsum, to judge a typeface.", "Our server answered 500 Internal Server Error for 4 minutes, and Fred Baker wrote down why.", "If the map stays blank, enable JavaScript in the browser settings, Gina Ford advises.", "Access denied."]
PEOPLE = ["Anna Smith", "Ben Miller", "Clara Jones", "Dora Hill", "Emma Stone"]


def test_slots_that_were_never_filled(spark):
    rows = [(f"ok{i}", t) for i, (t, _) in enumerate(site())]
    rng = random.Random(8)
    extra = lambda x: site(1, rng.randint(0, 999), body=lambda i: [f" {tale(rng)}", f" {tale(rng)} {tale(rng)}", f" {x} {tale(rng)}", f" {tale(rng)} {tale(rng)}"])[0][0]
    rows += [(f"bad{i}", extra(x)) for i, x in enumerate(SLOTS)]
    rows += [(f"real{i}", extra(x)) for i, x in enumerate(REAL)]
    rows += [(f"said{i}", extra(s.format(x=f"v{i}", n=PEOPLE[i % 5]))) for i in range(12) for s in SPOKEN[i % 2 : i % 2 + 1] * 2]
    rows += [(f"said{i}", extra(s.format(x=f"v{i}", n=PEOPLE[i % 5]))) for i in range(12, 24) for s in SPOKEN[i % 2 : i % 2 + 1]]
    rows += [("head", extra("x").replace("What", "{{page.title}} What", 1).replace("The quiet", "{{page.title}} The quiet", 1).replace("How Anna", "{{page.title}} How Anna", 1))]
    rows += [("null", None), ("empty", ""), (None, "{{x}}"), rows[60]]
    assert ids(spark, rows) == {f"bad{i}" for i in range(len(SLOTS))} | {"head"}


# Wordings that no list holds, in six languages, with and without slots.
WHOLE = ["Sorry, we could not load this article.", "Contenido no disponible en este momento.", "Access Denied By Server Administrator.", "Please Enable JavaScript To View This Site.", "Nothing was delivered for item {x} today.", "Der Beitrag {x} wird gerade überarbeitet.", "Le document {x} a disparu.", "Материал {x} недоступен."]


@pytest.mark.parametrize("which", range(0, len(WHOLE), 2))
def test_whole_page_templates_of_unknown_wording_are_induced(spark, which):
    syl = ["kin", "lo", "var", "mer", "tu", "sha", "des"]
    rows = [(f"t{i}", t) for i, (t, _) in enumerate(site())]
    for k in (which, which + 1):
        rows += [(f"e{k}.{i}", t) for i, (t, _) in enumerate(site(9, 50 + k, body=lambda i, k=k: [" " + WHOLE[k].format(x=f"{syl[i % 7]}{syl[(i * 3 + k) % 7]}") + " "]))]
    # One of them within an article is a quotation.
    rows += [("quote", site(1, 9, body=lambda i: [f" {tale(random.Random(1))} {TALE}", f" {WHOLE[which].format(x='lo')} {TALE}", f" {TALE} {tale(random.Random(2))}"])[0][0])]
    assert ids(spark, rows) == {f"e{k}.{i}" for k in (which, which + 1) for i in range(9)}


def test_templates_tell_slots(spark):
    rows = [(f"t{i}", t) for i, (t, _) in enumerate(site())]
    rows += [(f"e{i}", t) for i, (t, _) in enumerate(site(9, 50, body=lambda i: [f" Nothing was delivered for item x{i}y today "]))]
    df = frame(spark, rows)
    found = residue.durable(residue.fragments(df, pages.fit(df)))
    got = [r for r in residue.templates(found).collect() if r["places"] == 7]
    assert got and all(r["slots"] == 1 and r["support"] == 9 for r in got)


def test_empty_table(spark):
    assert ids(spark, [("a", None)]) == set()
    df = spark.createDataFrame([], "id string, text string")
    assert residue.residue_ids(df).count() == 0
