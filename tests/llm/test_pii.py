import unicodedata

import pytest

from loomspan.llm import pii

ROLES = {"mara": 1, "tovik": 1, "hunter": 3, "may": 1, "selden": 2, "brightwell": 2, "ostrøm": 2}


def kinds(text):
    return [(k, text[s:e]) for k, s, e in pii.find_spans(text, ROLES)]


CASES = [
    ("Mail mara.selden+x@post.example, now.", [("email", "mara.selden+x@post.example")]),
    ("to m_selden [at] post [dot] example or t (at) mail.test", [("email", "m_selden [at] post [dot] example"), ("email", "t (at) mail.test")]),
    ("X@Y.ORG; a at mail dot test. b＠c.example", [("email", "X@Y.ORG"), ("email", "a at mail dot test"), ("email", "b＠c.example")]),
    ("Write @tale_keeper or pkg@1.2.0, rate 3@5, meet me at dot and dash", []),
    ("call (764) 555-0135, +44 7700 900422 or 01 99 00 11 83.", [("phone", "(764) 555-0135"), ("phone", "+44 7700 900422"), ("phone", "01 99 00 11 83")]),
    ("２６９－５５５－０１１２ and 588 555 0133", [("phone", "２６９－５５５－０１１２"), ("phone", "588 555 0133")]),
    ("line five five five oh one two four, five five cats", [("phone", "five five five oh one two four")]),
    ("ISBN 0-00-279000-34, Scan run 20240384-345-0147, ids are 278-45-321, 911-000 reasons, ratio 900:12:3456", []),
    ("SSN 945-45-6344; gives QQ 21 22 72 C as the NI number", [("identity_number", "945-45-6344"), ("identity_number", "QQ 21 22 72 C")]),
    ("passport: ZQ7888762, driving licence X525-6383-9728, build 981193886", [("identity_number", "ZQ7888762"), ("identity_number", "X525-6383-9728")]),
    ("lives at 12b Ashgate Lane, Apt 3, Norwick 12345, phone", [("street_address", "12b Ashgate Lane, Apt 3, Norwick 12345")]),
    ("at Flat 4, 9 Elmyard Close, Norwick until", [("street_address", "Flat 4, 9 Elmyard Close, Norwick")]),
    ("at 57 Foss St. any, Fosswellgasse 17, 35434 Ulm now, 4c rue de la Mare, 13002 Aix that, Calle Luna 8B.", [("street_address", x) for x in ("57 Foss St.", "Fosswellgasse 17, 35434 Ulm", "4c rue de la Mare, 13002 Aix", "Calle Luna 8B")]),
    ("Number 37 idle Road songs. Chapter 2 Street Scenes. Selden Lane was closed.", []),
    ("Mara Selden, TOVIK M. BRIGHTWELL and selden, mara met T. Ostrøm's dog", [("person_name", x) for x in ("Mara Selden", "TOVIK M. BRIGHTWELL", "selden, mara", "T. Ostrøm")]),
    ("Mara van den Selden-Brightwell; Tovik Oström", [("person_name", "Mara van den Selden-Brightwell")]),
    ("thanks to Mara Selden, Brightwell, Tovik and Mara", [("person_name", "Mara Selden"), ("person_name", "Brightwell, Tovik")]),
    ("at 221B Baker Street, London NW1 6XE; 9 Elm Close, NW1 6XE; 4 Ash Lane, London, NW1 6XE.", [("street_address", x) for x in ("221B Baker Street, London NW1 6XE", "9 Elm Close, NW1 6XE", "4 Ash Lane, London, NW1 6XE")]),
    ("saw 7 Hill Rise and 12 Oak Parkway, then 14 Elm Walk or 5 The Mews today", [("street_address", x) for x in ("7 Hill Rise", "12 Oak Parkway", "14 Elm Walk", "5 The Mews")]),
    (unicodedata.normalize("NFD", "Der Führerschein X525-6383-9728 lag da"), [("identity_number", "X525-6383-9728")]),
    ("Her passport, which she had kept in a tin under the bed for as long as anyone in the house remembered, was ZQ7888762.", [("identity_number", "ZQ7888762")]),
    ("A passport is long. It was heavy and old and nobody wanted to carry it up the hill at all. Take ZQ7888762.", []),
    ("phone 030 12345678 or (02) 9374 4000", [("phone", "030 12345678"), ("phone", "(02) 9374 4000")]),
    ("bins 030 12345678 or (02) 9374 4000, scan run 269-555-0112", [("phone", "269-555-0112")]),
    ("Chapter 51 Street Scenes, page 182", []),
    ("Hunter and May sold it. The Selden Institute, Mara Selden Lane, Mara.selden@x.test", [("email", "Mara.selden@x.test")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert kinds(text) == want


def test_redaction():
    text = "Mara Selden: mara@post.example!"
    assert pii.redact(text, pii.find_spans(text, ROLES)) == "[PERSON_NAME]: [EMAIL]!"


def corpus():
    given, family = [f"Gi{a}va" for a in "bcdfgh"], [f"Fam{a}ton" for a in "klmnprst"]
    rows = [f"Then {g} {f} came home and saw the river." for g in given for f in family] + [f"And so {g} slept." for g in given for _ in range(20)]
    rows += [f"Even {f}, {given[0]} cried." for f in family] + ["The river and the stone were cold." for _ in range(300)]
    return rows, given, family


def test_unknown_names_are_learned(spark):
    rows, given, family = corpus()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    known = spark.createDataFrame([(given[0], "given"), (family[0], "family"), ("River", "given"), (None, "family")], "name string, role string")
    model = pii.name_terms(docs, known)
    terms = {(r["term"], r["role"]) for r in model.collect()}
    assert terms == {(g.lower(), "given") for g in given} | {(f.lower(), "family") for f in family} | {("river", "given")}
    sent = {(r["doc_id"], str(r["spans"]), r["clean"]) for r in pii.with_spans(docs, model, ["doc_id"], clean="clean").collect()}
    joined = {(r["doc_id"], str(r["spans"]), r["clean"]) for r in pii.with_spans(docs, model, ["doc_id"], clean="clean", most_sent=3).collect()}
    assert sent == joined
    found = pii.found_rows(pii.with_spans(docs, model, ["doc_id"]), "doc_id")
    assert found.where("kind = 'person_name'").count() == len(given) * len(family) + len(family)


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000 + "Mara Selden")], "doc_id int, text string")
    known = spark.createDataFrame([("Mara", "given"), ("Selden", "family")], "name string, role string")
    model = pii.name_terms(docs, known)
    got = {r["doc_id"]: r["spans"] for r in pii.with_spans(docs, model, ["doc_id"]).collect()}
    assert got[1] is None and got[2] == [] and [(s["char_start"], s["char_end"]) for s in got[3]] == [(100_000, 100_011)]
    assert pii.with_spans(docs.limit(0), pii.name_terms(docs.limit(0), known.limit(0)), ["doc_id"]).count() == 0


@pytest.mark.parametrize("most_sent", [pii.MOST_SENT, 1])
def test_decomposed_names(spark, most_sent):
    names = ["Maevik Kettöm", "ÉLISE KETTÖM", "Kettöm, Élise", "Maevik van den Kettöm"]
    texts = [unicodedata.normalize(form, f"So {name} slept.") for name in names for form in ("NFC", "NFD")]
    model = spark.createDataFrame([("maevik", "given"), ("élise", "given"), ("kettöm", "family"), ("river", "family")], "term string, role string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["spans"], r["clean"]) for r in pii.with_spans(docs, model, ["doc_id"], clean="clean", most_sent=most_sent).collect()}
    for i, text in enumerate(texts):
        assert [(s["kind"], s["char_start"], s["char_end"]) for s in got[i][0]] == [("person_name", 3, len(text) - 7)] and got[i][1] == "So [PERSON_NAME] slept."


class Everything(pii._Tokens):
    def of(self, tokens):
        return (1 << 40) - 1


def test_gates_lose_nothing(spark, data):
    roles = dict(ROLES) | {"dial": pii.ROLES["phone"], "papers": pii.ROLES["id0"], "scenes": pii.ROLES["street"]}
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["text"]] + [c for c, _ in CASES]
    for text in texts:
        assert pii.find_spans(text, roles) == pii.find_spans(text, roles, Everything(roles))


def test_terms_around_numbers_are_learned(spark):
    filler = [f"The river and stone number {i} were cold." for i in range(400)]
    rows = [f"Blip me at +44 7700 9{i:05d} soon." for i in range(8)] + [f"The wotsit SSN was 9{i:02d}-45-6{i:03d} then." for i in range(8)]
    rows += [f"Sent to {i} Old Spinny, Wynwick {10000 + i} today." for i in range(8)] + ["Blip 030 12345678 now.", "Stone 030 12345678 now.", "A wotsit 945-45-6344 here.", "A stone 945-45-6344 here.", "At 8 New Spinny they sat."]
    docs = spark.createDataFrame(list(enumerate(filler + rows)), "doc_id int, text string")
    model = pii.name_terms(docs, spark.createDataFrame([], "name string, role string"))
    roles = {(r["term"], r["role"]) for r in model.collect()}
    assert {("blip", "phone"), ("wotsit", "id0"), ("spinny", "street")} <= roles and not any(t in ("river", "stone", "the") for t, _ in roles)
    for most_sent in (1, pii.MOST_SENT):
        spanned = pii.with_spans(docs, model, ["doc_id"], most_sent=most_sent)
        found = {(rows[r["doc_id"] - 400][r["char_start"] : r["char_end"]], r["kind"]) for r in pii.found_rows(spanned, "doc_id").where("doc_id >= 424").collect()}
        assert found == {("030 12345678", "phone"), ("945-45-6344", "identity_number"), ("8 New Spinny", "street_address")}


def test_disclosing_terms_are_generalised(spark):
    names = [("Mara", "Selden"), ("Tovik", "Ostrom"), ("Jana", "Fellow")]
    rows = [f"{g} {f} kept the {what} at home number {i}." for i in range(40) for (g, f), what in zip(names, ("astrolabe", "river", "river"), strict=True)]
    rows += [f"The river and stone {i} were cold and the home was far." for i in range(8000)] + ["The astrolabe shone.", None, "", "Mara Selden sold the astrolabe. An astrolabe!"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    model = spark.createDataFrame([(x.lower(), r) for g, f in names for x, r in ((g, "given"), (f, "family"))], "term string, role string")
    assert {(r["entity"], r["term"]) for r in pii.disclosing_terms(docs, model).collect()} == {("selden", "astrolabe")}
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitised(docs, model, "doc_id").collect()}
    last = len(rows) - 1
    assert len(got) == len(rows) and got[last - 2] is None and got[last - 1] == "" and got[last - 3] == rows[last - 3]
    assert got[last] == "[PERSON_NAME] sold the [TERM]. An [TERM]!" and got[1] == "[PERSON_NAME] kept the river at home number 0."


def test_size_of_the_model_changes_no_family(spark, monkeypatch):
    rows = [f"{name} kept the astrolabe at home number {i}." for i in range(6) for name in ("Selden, Mara", "Mara Brightwell", "Selden, Tovik")]
    rows += [f"The river and stone {i} were cold and the home was far." for i in range(4000)] + [None, "", "Selden, Mara sold it. Tovik Selden read.", unicodedata.normalize("NFD", "Ostrôm, Mara slept.")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    model = spark.createDataFrame([("mara", "given"), ("tovik", "given"), ("selden", "family"), ("brightwell", "family"), ("ostrôm", "family")], "term string, role string")
    results = []
    for most in (pii.MOST_SENT, 1):
        monkeypatch.setattr(pii, "MOST_SENT", most)
        met = {tuple(r) for r in pii._met(docs, model, "text", "doc_id").collect()}
        assert {entity for _, entity, _ in met} == {"selden", "brightwell", "ostrôm"}
        results.append((met, {tuple(r) for r in pii.disclosing_terms(docs, model).collect()}, {tuple(r) for r in pii.sanitised(docs, model, "doc_id").collect()}))
    assert results[0] == results[1] and ("selden", "astrolabe") in {r[:2] for r in results[0][1]}


def test_own_terms_hold_all_that_is_asked():
    terms = {"copse": pii.ROLES["street"], "spinny": pii.ROLES["street"], "\u0622ل": 1, "selden": 2}
    for text in ("At 8 New Copse\u0308 by the Spinny.", "Ａ\u0627\u0653ل Selden, 9 Old Copse\u0308 Spinny", "ΟΔΟΣ＇Α"):
        own = {t: terms[t] for t in pii._looked_up(text) if t in terms}
        assert pii.find_spans(text, own) == pii.find_spans(text, terms)
        assert {w for token in text.split() for w in pii._WORD.findall(pii.fold(pii.plain_form(token)))} <= pii._looked_up(text)
