from citeloom.llm import surrogates
from citeloom.llm.surrogates import assign, detect, luhn_digit, render, replace_entities, surrogate


def test_detects_kinds():
    text = "Mail Ann.b@Mail.example.com, +1 (017) 555-7713 97.51.17.173 or 9807915762804490; token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 123-45-6789 Mary Smith, Mr. Jones. Version 2.0. 3.14 1999"
    kinds = [(k, text[a:b]) for a, b, k, _ in detect(text)]
    assert kinds == [("email", "Ann.b@Mail.example.com"), ("phone", "+1 (017) 555-7713"), ("ip", "97.51.17.173"), ("account", "9807915762804490"),
                     ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"), ("national", "123-45-6789"), ("person", "Mary Smith"), ("person", "Jones")]


def test_surrogates_keep_the_type():
    card = "453201511283036"
    card += str(luhn_digit(card))
    made = surrogate("account", card, b"k", 0)
    assert made != card and len(made) == 16 and luhn_digit(made[:-1]) == int(made[-1])
    assert made == surrogate("account", card, b"k", 0) != surrogate("account", card, b"other", 0)
    assert render("4532-0151-1283-0366", "account", made).count("-") == 3
    for script, gender, name in (("latin", "f", "Mary Smith"), ("cyrillic", "m", "Иван Петров"), ("greek", "f", "Μαρία Παππά")):
        out = surrogate("person", f"{script}|{gender}|{name}", b"k", 0)
        assert out.startswith(f"{script}|{gender}|") and out.split("|")[2].split()[0] in surrogates.GIVEN[script, gender]
    iban = surrogate("iban", "DE89370400440532013000", b"k", 0)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_collisions_are_drawn_again(spark, monkeypatch):
    entities = spark.createDataFrame([("account", f"{i:013d}") for i in range(30)], "kind string, canon string")
    # A first draw that always collides, with other surrogates and with real entities.
    monkeypatch.setattr(surrogates, "_drawn", lambda open_, key, draw: open_.selectExpr(
        "kind", "canon", f"lpad(cast(cast(canon as long) * {1 if draw > 1 else 0} + {100 if draw else 5} as string), 13, '0') as surrogate", f"{draw} as draw"))
    got = assign(entities, b"k").collect()
    made = [r.surrogate for r in got]
    assert len(got) == 30 and len(set(made)) == 30 and not set(made) & {r.canon for r in got}


def test_replaces_whole_corpus(spark, make_docs):
    text = "Write to a.b@x.org or A.B@x.org, call +49 30 1234 5678."
    docs = make_docs([(1, text), (2, "again a.b@x.org"), (3, None), (4, ""), (5, "no entity"), (1, "other row c@y.org"), (None, "z@y.org"), (7, "w " * 40000 + "a.b@x.org")])
    got = sorted(((r.doc_id or 0), r.text, r.n_replaced) for r in replace_entities(docs, "key").collect() if r.text is not None)
    assert len(got) == 7
    first = next(t for i, t, _ in got if i == 1 and t.startswith("Write"))
    mail = first.split()[2]
    assert mail != "a.b@x.org" and mail.endswith(".org") and first.count(mail) == 2 and "1234 5678" not in first  # coreference
    assert next(t for i, t, _ in got if i == 2) == f"again {mail}" and next(t for i, t, _ in got if i == 7).endswith(mail)
    assert replace_entities(docs.where("false"), "key").count() == 0


def test_names_behind_punctuation():
    names = ["Mary Smith", "Mr. Jones", "Anna Petrova", "Frau Weber", "Jürgen Groß", "Ольга Иванова", "Ελένη Παππά", "Charlotte Young", "Виктор Орлов", "Νίκος Λάμπρου"]
    for name in names:
        for text in (f"({name})", f'"{name} left"', f"by/{name}", f"so—{name}", f"[{name}]", f"it was\u00a0{name}", f"x{name}", f"_{name}", name):
            want = [m.span("titled" if m["title"] else 0) for m in surrogates._PERSON.finditer(text)]
            assert [(a, b) for a, b, k, _ in detect(text) if k == "person"] == want
            assert bool(want) == (text[0] not in "x_")
