import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality, subjects, toxicity

NAMES = ["Anna", "Boris", "Carla", "Denis", "Elsa", "Fritz"]
PLAIN = ["The report about the {a} was read by {n} in the morning.", "{n} said the {a} had been moved to the old town hall.", "A bitch and her {k} pups won the show, said {n}.", "To kill a stuck process, {n} sends it a second signal."]
TOXIC = ["You are a pathetic moron and nobody wants your garbage here, {n}.", "Shut your filthy mouth, {n}, you worthless idiot.", "They are vermin and should be driven out of town before they breed."]
THINGS = "table river story engine garden letter bridge window".split()


def labelled(n, seed, wrong=0.03):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = rng.random() < 0.3
        s = [rng.choice(PLAIN).format(a=rng.choice(THINGS), n=rng.choice(NAMES), k=rng.randint(2, 9)) for _ in range(8)]
        if y:
            s.insert(rng.randint(0, 8), rng.choice(TOXIC).format(n=rng.choice(NAMES)))
        out.append(("\n".join(s), int(y), int(y if rng.random() > wrong else not y)))
    return out


def test_held_out_accuracy_with_wrong_labels():
    train, test = labelled(400, 1), labelled(200, 2, 0)
    scorer = toxicity.fit_scorer([(t, y) for t, _, y in train])
    said = [scorer.text(t) >= scorer.threshold for t, _, _ in test]
    right = sum(bool(y) == s for s, (_, y, _) in zip(said, test, strict=True))
    assert right / len(test) > 0.97
    for hidden in ("You are a p a t h e t i c m.o.r.o.n and nobody wants your garbage here, Kim.", "YOU ARE A PATHETIC M​ORON and nobody wants your g4rb4ge here, Kim.", "You are a раthetic mоron and nobody wants your gaaaarbage here, Kim.", "You are a p******c moron and nobody wants your garbage here, Kim."):
        assert scorer.text(hidden) >= scorer.threshold, hidden
    assert scorer.text("") < scorer.threshold and scorer.text("A bitch and her 4 pups won the show, said Kim.") < scorer.threshold


def numbered(passages, names):
    return np.array([x for p in passages for x in [*(names.index(w) for w in p), toxicity.END]], dtype=np.int64)


def test_every_passage_is_scored():
    toxic = [["you", "are", "a", "filthy", "idiot"], ["what", "an", "idiot"], ["idiot", "go", "away"]] * 3
    plain = [["the", "old", "lamp", "was", "lit", "every", "night"], ["you", "are", "a", "friend"], ["go", "home", "now"]] * 9
    names = ["<rare>", "<s>", "</s>", *sorted({w for p in toxic + plain for w in p})]
    scorer = toxicity.Scorer(numbered(toxic, names), numbered(plain, names), names, np.zeros(len(names), bool))
    # Ordinary texts and single short words have a real score, whatever their words say.
    assert scorer.text("The old lamp was lit every night") > -9.0
    assert scorer.text("The old lamp was lit.\nIdiot!") > scorer.text("The old lamp was lit.\nHome!") > -9.0
    assert scorer.text("") == scorer.text(" ... ") == toxicity.NOTHING
    assert scorer.text("You are a friend") == pytest.approx(scorer.passages(numbered([["you", "are", "a", "friend"]], names))[0][0])
    texts = ["Go home now.", "What an idiot! Go home.", "", "You are a filthy idiot and the old lamp was lit every night and you are a friend and go home now and then go home."]
    assert scorer.texts(texts) == pytest.approx([scorer.text(t) for t in texts])


def test_short_abuse_in_spaced_and_unspaced_scripts():
    bad = ["Shut up!", "You moron.", "死ねこのクズ野郎", "Drecksau!"]
    rng = random.Random(4)
    texts = []
    for i in range(240):
        own = [rng.choice(PLAIN).format(a=rng.choice(THINGS), n=rng.choice(NAMES), k=i) for _ in range(6)]
        own.append("町長さんによると、計画はまだ時間がかかるという。")
        if i % 4 == 0:
            own.insert(rng.randint(0, 6), bad[i // 4 % 4])
        texts.append(("\n".join(own), int(i % 4 == 0)))
    scorer = toxicity.fit_scorer(texts)
    for s in bad:
        assert scorer.text(f"The lamp was lit.\n{s}\nGo home.") >= scorer.threshold > scorer.text("The lamp was lit.\nGo home."), s


def test_hidden_spellings_are_seen_by_the_quick_test():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("ab. A0$@é я1\u200b*") for _ in range(rng.randint(0, 14)))
        plain = "*" in text or toxicity._LETTER_DIGIT(text) or toxicity._TRIPLE(text) or toxicity._LONE(text) or toxicity._INVISIBLE.search(text) or (toxicity._CYR.search(text) and toxicity._BOTH_SCRIPTS(text))
        assert toxicity.hides(text) == bool(plain), repr(text)


def brute(passages, base, a, b, c):
    """Interpolated Kneser-Ney as the formula has it, from lists."""
    d = toxicity.DISCOUNT
    tri = Counter()
    for p in passages:
        seq = ["<s>", "<s>", *p, "</s>"]
        tri.update(zip(seq, seq[1:], seq[2:], strict=False))
    bi = Counter((y, z) for _, y, z in tri)
    uni = Counter(z for _, z in bi)
    n = max(1, sum(uni.values()))
    out = max(uni[c] - d, 0) / n + (d * len(uni) / n) * base[c]
    if n2 := sum(v for k, v in bi.items() if k[0] == b):
        out = max(bi[b, c] - d, 0) / n2 + d * sum(k[0] == b for k in bi) / n2 * out
    if n3 := sum(v for k, v in tri.items() if k[:2] == (a, b)):
        out = max(tri[a, b, c] - d, 0) / n3 + d * sum(k[:2] == (a, b) for k in tri) / n3 * out
    return out


def test_kneser_ney_against_brute_force():
    rng = random.Random(3)
    letters = "a b c d e".split()
    classes = [[[rng.choice(letters) for _ in range(rng.randint(1, 6))] for _ in range(m)] for m in (80, 7)]
    names = ["<rare>", "<s>", "</s>", *letters, "x"]
    base = {w: 1 / 6 if w in (*letters, "</s>") else 0.0 for w in names}
    lm = toxicity.KneserNey([numbered(p, names) for p in classes], np.array([base[w] for w in names]))
    at = names.index
    for a, b in [("<s>", "<s>"), ("<s>", "a"), ("a", "b"), ("x", "c"), ("x", "x")]:
        every = [*letters, "</s>"]
        got = lm.p(*(np.array([at(w)] * 6) for w in (a, b)), np.array([at(w) for w in every]))
        for k, passages in enumerate(classes):
            assert abs(got[k].sum() - 1) < 1e-9
            assert got[k].tolist() == pytest.approx([brute(passages, base, a, b, c) for c in every])


def test_tables_against_dictionaries():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 10**6, 5000))
    table = toxicity.Table(keys, keys[:, None] * [1.0, 2.0])
    asked = rng.integers(0, 10**6, 20000)
    known = set(keys.tolist())
    one, two = table(asked)
    assert one.tolist() == [x if x in known else 0 for x in asked.tolist()] and (two == 2 * one).all()
    assert toxicity.Table(keys[:0], np.zeros((0, 1)))(asked[:3])[0].tolist() == [0, 0, 0]


def test_scores_and_rates(spark):
    data = labelled(120, 5)
    texts = spark.createDataFrame([(f"t{i}", t) for i, (t, _, _) in enumerate(data)] + [("n", None), ("e", ""), ("t0", data[0][0])], "id string, text string")
    labels = spark.createDataFrame([(f"t{i}", "r", float(y)) for i, (_, _, y) in enumerate(data)] + [("t1", "s", None), ("x", "r", 1.0)], "id string, annotator string, toxic double")
    records = spark.createDataFrame([(f"t{i}", "http://A.example/x" if i % 2 else "http://b.example/", "response") for i in range(100)], "id string, url string, type string")
    out = toxicity.scores(texts, toxicity.fit(texts, labels))
    rows = {r["id"]: r for r in out.collect()}
    assert rows["n"]["score"] is None and rows["e"]["toxic"] is False and out.count() == 123
    assert sum(bool(y) == rows[f"t{i}"]["toxic"] for i, (_, y, _) in enumerate(data)) > 112
    rates = {r["host"]: r for r in toxicity.rates(out, records).collect()}
    assert rates["a.example"]["texts"] == 50 and rates[None]["texts"] == 22
    assert toxicity.scores(texts.limit(0), toxicity.fit(texts, labels.limit(0))).count() == 0


def test_subjects(spark):
    pools = {"music": "guitar violin choir melody".split(), "law": "court judge verdict appeal".split(), "cooking": "oven dough sauce stew".split()}
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(240):
        own = rng.sample(sorted(pools), 1 if i % 4 else 2)
        s = [f"{rng.choice(NAMES)} wrote about the {rng.choice(pools[k])} and the {rng.choice(THINGS)} today." for k in own for _ in range(5)]
        docs.append((i, "\n".join(s)))
        labels += [(i, k) for k in own]
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "  \n"), (903, "​ ~~ %%")], "doc_id long, text string").selectExpr("*", "'x' AS subject")
    lab = spark.createDataFrame([x for x in labels if x[0] < 140] + labels[:5], "doc_id long, subject string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.assign(df, subjects.fit(df, lab)).collect()}
    want = {x for x in labels if x[0] >= 140}
    mine = {x for x in got if 140 <= x[0] < 900}
    assert len(mine & want) > 0.95 * len(want) and len(mine - want) < 0.05 * len(want)
    assert not {x for x in got if x[0] >= 900}
    # A passing word makes no subject, a text full of them does.
    areas = subjects.Areas(*subjects.fit(df, lab).value)
    other = "Kim walked along the bank in the evening light and nobody was there. " * 200
    assert areas.subjects(other + "Somebody had left a guitar there.") == [] and [s for s, _ in areas.subjects("A guitar, a violin and the choir. " * 9)] == ["music"]
    none = subjects.fit(df.limit(0), lab.limit(0))
    assert subjects.assign(df.limit(0), none).count() == 0
    assert subjects.composition(subjects.assign(df, none)).count() == 3


PROSE = {
    "en": "According to the mayor, most of the village depends on the river, and nobody in the council expected it to rise so fast.",
    "es": "Según el alcalde, la solución todavía necesita más atención después de la reunión, pero nadie sabe por qué.",
    "de": "Laut dem Bürgermeister braucht der Plan noch etwas Zeit, sagte man nach der Sitzung, und niemand war überrascht.",
    "ru": "По словам мэра, проект пока требует внимания, и никто не думал, что город так быстро изменится после собрания.",
    "ja": "町長さんによると、計画はまだ時間がかかるという。なぜ町は川より大切なのだろうか。",
}


def kind(body):
    return quality.Profiles().shape(quality.structure(body))[0]


def test_structural_profiles():
    for text in PROSE.values():
        assert kind([text] * 3) == "prose"
        assert kind([text, text] + ["a | b | 12"] * 2) == "prose"
    assert kind(["laut dem bürgermeister braucht der plan noch etwas zeit und niemand war überrascht"] * 2) == "prose"
    assert kind(["The river rose in the night and", "nobody in the village knew of it,", "for the bell was still and the", "keeper had gone to the old mill,"]) == "prose"
    assert kind([f"{i}. Garden spade (Northtown)" for i in range(12)]) in ("list", "table")
    assert kind([PROSE["en"][:60]] + [f"- {w.title()} set" for w in THINGS * 3]) != "prose"
    assert kind([f"Spade {i} | Northtown | {i * 37} | {i * 1.5:.2f}" for i in range(12)]) == "table"
    assert kind([f"2025-01-{i:02d} 10:11:12 [INFO] key=12{i} val=0x12ab" for i in range(1, 20)]) in ("junk", "table")
    assert kind(["dGhpcyBpcyBub3QgcHJvc2UgYXQgYWxs" * 3] * 6) == "junk"
    assert kind(["buy cheap lamp best lamp cheap buy lamp best cheap"] * 6) == "junk"
    garbled = PROSE["ru"].encode("cp1251").decode("cp1252")
    assert kind([garbled] * 4) == "prose"
    assert kind([]) == "prose"


def test_lines_are_described_once(monkeypatch):
    # Classes by chunk are those of all tokens one by one.
    for lang in ("en", "fr", ""):
        own, n = quality._Sorts(lang), [0] * 7
        line = "Of the mill-keepers, d'un | 1,200 §§§ --- The l'eau (NASA) = ???! " + "x" * 27 + " . Harbour-Bell-" + "a" * 20
        for chunk in line.split():
            n[6] += len(chunk) / 6 if len(chunk) > 30 else 0
            for t in quality._tokens(chunk):
                c = own[t]
                if c == 8:
                    n[6 if t[0].isalpha() else 5] += len(t) / 6 if t[0].isalpha() else len(t)
                elif c != 7:
                    n[c] += 1
        assert all(abs(x - y) < 1e-9 for x, y in zip(quality.counts(line, lang), n, strict=True))
    # What several pairs of charsets make of a text is looked at once.
    tried, tongue = [], quality.tongue
    monkeypatch.setattr(quality, "tongue", lambda text: tried.append(text) or tongue(text))
    body = ["Blöße über Größe, Öl für Süßes"] * 2
    assert quality.readable(body, 1.0) is body
    assert len(tried) == len(set(tried)) > 5
    assert quality.readable([PROSE["ru"].encode("cp1251").decode("cp1252")], 0.0) == [PROSE["ru"]]


def test_divergence():
    profiles = quality.Profiles().all
    p, q = profiles["prose-en"], profiles["junk-log"]
    assert quality.divergence(p, p) == 0 and abs(quality.divergence(p, q) - quality.divergence(q, p)) < 1e-12
    assert 0 < quality.divergence(p, q) <= 1
    assert all(abs(sum(x) - 1) < 0.011 for x in profiles.values())


def test_prose_profiles_are_measured(spark):
    rows = [(f"t{i}", f"H\n{PROSE['en']}\n{PROSE['en']}") for i in range(40)] + [("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    found = quality.durable(quality.structures(df, quality.pages.fit(df)))
    got = quality.measured(found.where(f"sort = {quality.residue.ADDED}"))
    line = quality.counts(PROSE["en"], "en")
    n = 40 * 2
    want = [quality.EXPECTED_WORDS * x + n * y for x, y in zip(quality.EXPECTED["prose-en"], line, strict=True)]
    assert all(abs(x / sum(want) - y) < 1e-9 for x, y in zip(want, got.all["prose-en"], strict=True))
    assert got.all["prose-de"] == quality.Profiles().all["prose-de"]
    made = quality.structure([PROSE["en"], "a | b | 12", "x" * 40])
    assert quality.unpacked(quality.packed(made))[0] == made[0] and quality.unpacked(quality.packed(made))[1][0] == made[1][0]


def test_statistics(spark):
    table = "\n".join(f"Spade {i} | Northtown | {i * 37}" for i in range(12))
    rows = [("a", PROSE["en"]), ("b", "H\n" + table), ("c", ""), ("d", None), ("b", "H\n" + table)]
    df = spark.createDataFrame(rows, "id string, text string").selectExpr("*", "0 AS words")
    got = {r["id"]: r for r in quality.statistics(df).collect()}
    assert got["a"]["words"] == 23 and got["a"]["ending_lines"] == 1.0 and got["a"]["common_words"] > 0.4 and got["a"]["language"] == "en"
    assert got["c"]["words"] == 0 and got["d"]["words"] is None and got["b"]["kind"] == "table"
    assert [r[0] for r in quality.not_prose_ids(df).collect()] == ["b"]
    assert quality.statistics(df.limit(0)).count() == 0 and quality.not_prose_ids(df.limit(0)).count() == 0


def test_subjects_are_fitted_on_all_labelled_documents(spark):
    # Each of 300 rare terms stands in twelve of 3,600 documents of its subject; with 3,600 others these are more than the 5,000 of a sample.
    def name(i):
        return "zq" + "".join(chr(97 + i // 26**k % 26) for k in range(3))

    docs = [(i, f"The {name(i % 300)} was there in the {THINGS[i % 8]} and it is so.") for i in range(3600)]
    docs += [(i, f"The {THINGS[i % 8]} was there in the {THINGS[i % 7]} and it is so.") for i in range(3600, 7200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, "music" if i < 3600 else "law") for i, _ in docs], "doc_id long, subject string")
    assert subjects.labelled(df, lab).count() == 7200
    sample = subjects.labelled(df, lab)
    counts = subjects.counted(sample, subjects.often(sample, 7200))
    got = {r["term"]: (r["n"], r["trained"]) for r in counts.where("subject = 'music' AND term LIKE 'zq%' AND term NOT LIKE '% %'").collect()}
    assert len(got) == 300 and all(n == 12 for n, _ in got.values()) and sum(x for _, x in got.values()) < 3600
    weights = subjects.fit(df, lab).value[0]
    # By hand: 12 of 3,600 inside, none of 3,600 outside.
    want = (math.log(12.5 / 3601) - math.log(0.5 / 3601) - math.sqrt(1 / 12.5 + 1 / 0.5)) * math.log(7201 / 12.5) / math.log(7201 / 0.5)
    assert all(abs(weights[name(i)]["music"] - want) < 1e-9 for i in range(300))
