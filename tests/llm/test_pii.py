"""Surrogates: entities go, mentions of one agree, entities stay apart, forms are kept."""

import re

from pyspark.sql import functions as F

from barscope.llm import pii


def changed(docs, **more):
    return {r.doc_id: r for r in pii.replaced(docs, **more).collect()}


def test_forms_are_kept(make_docs):
    texts = [
        "Mail Jo.Doe1@mail.example.com or JO.DOE1@MAIL.EXAMPLE.COM now", "card 4111-1111-1111-1111, 4111 1111 1111 1111.", "ip 10.20.30.40 and 300.1.1.1",
        "call +1 (441) 555-3597 or 441-555-3597", 'token = "a5da8e9b33fb57beea5cace8e768dbb6a7b2fce6"', "ssn 123-45-6789", "IBAN DE44 5001 0517 5407 3249 31 ok",
        "Mr. John Smith met Mrs Smith. Frau Müller and Dr Smith left; MR SMITH", "Господин Иван Петров, Госпожа Петрова",
    ]
    got = changed(make_docs(list(enumerate(texts))))
    t = [got[i].text for i in range(len(texts))]
    a, b = re.findall(r"\S+@\S+", t[0])
    assert a.upper() == b and a.endswith(".example") and "doe" not in a and re.match(r"[a-z]{2}\.[a-z]{3}\d@", a)
    c, d = re.findall(r"\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}", t[1])
    assert c.replace("-", " ") == d and "4111" not in t[1]
    digits = [int(x) for x in d.replace(" ", "")][::-1]
    assert sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0
    assert "10.20.30.40" not in t[2] and "300.1.1.1" in t[2] and got[2]["__n_entities"] == 1
    assert re.fullmatch(r"call \+\d \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}", t[3]) and "3597" not in t[3]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', t[4]) and t[4] != texts[4]
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4}", t[5]) and t[5] != texts[5]
    assert re.fullmatch(r"IBAN [A-Z]{2}\d{2} \d{4} \d{4} \d{4} \d{4} \d{2} ok", t[6]) and "5001" not in t[6]
    m = re.fullmatch(r"Mr. (\w+) (\w+) met Mrs (\w+). Frau (\w+) and Dr (\w+) left; MR SMITH", t[7])
    assert m and m[2] == m[3] == m[5] != "Smith" and m[4] not in ("Müller", m[2]) and m[1].endswith("n")
    m = re.fullmatch(r"Господин (\w+) (\w+), Госпожа (\w+)", t[8])
    assert m and all(re.fullmatch(r"[а-я]+", x.lower()) for x in m.groups()) and m[2] != m[3]


def test_mentions_agree_and_entities_stay_apart(make_docs):
    ids = list(range(300))
    rows = [(i, f"write to user{i % 100}@host{i % 7}.com from 10.0.{i % 50}.{i % 60}") for i in ids]
    got = changed(make_docs(rows))
    seen = {}
    for i, t in rows:
        for old, new in zip(t.split()[2::2], got[i].text.split()[2::2]):
            assert seen.setdefault(old, new) == new and new != old
    assert len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())
    other = changed(make_docs(rows), key="another")
    assert all(other[i].text != got[i].text for i in ids)


def test_given_names_agree_under_all_titles(make_docs):
    got = changed(make_docs([(1, "Mr John Smith came"), (2, "Dr John Smith came, Mrs Anna Smith too"), (3, "Prof Anna Smith")]))
    t = {i: re.findall(r"(?:Mr|Dr|Mrs|Prof) (\w+) (\w+)", r.text) for i, r in got.items()}
    assert t[1][0] == t[2][0] and t[2][1] == t[3][0] and t[1][0][0].endswith("n") and t[3][0][0].endswith("na")


def test_long_secrets_keep_their_length(make_docs):
    long = "0123456789abcdef" * 1000
    got = changed(make_docs([(1, f"key {long} end")]))
    assert re.fullmatch(r"key [0-9a-f]{16000} end", got[1].text) and long not in got[1].text


def test_collisions_are_drawn_again(spark):
    """All 90 of 100 two-digit numbers need values of their own among 100."""
    rows = spark.createDataFrame([("phone", f"{i:02d}") for i in range(6)] * 2, "kind string, norm string")
    got = {r.norm: r.drawn for r in pii.surrogates(rows, attempts=60).collect()}
    assert len(got) == 6 and len(set(got.values())) == 6 and not set(got) & set(got.values())


def test_odd(odd_docs, no_docs):
    before = sorted(map(str, odd_docs.collect()))
    after = pii.replaced(odd_docs)
    assert set(after.columns) == {*odd_docs.columns, "__n_entities"}
    assert sorted(map(str, after.drop("__n_entities").collect())) == before
    assert pii.replaced(no_docs).count() == 0


def test_repeated_rows_and_long_texts(make_docs):
    long = " ".join(f"w{i}" for i in range(20_000)) + " a@b.co " + " ".join(f"x{i}" for i in range(100))
    got = pii.replaced(make_docs([(1, "a@b.co"), (1, "a@b.co"), (None, "A@B.CO"), (2, long), (3, "a@b.co.")])).collect()
    assert len(got) == 5 and all(r["__n_entities"] == 1 and "a@b.co" not in r.text.lower() for r in got)
    assert len({re.search(r"\S+@\S+?example", r.text.lower())[0] for r in got}) == 1


def test_long_runs_of_every_form(make_docs):
    """Runs of 100,000 characters need no stack, and time in proportion."""
    n = 100_000
    runs = ["x@" + "a." * (n // 2) + "com", "z" * n, "a." * (n // 2) + "@b.co", "a@" * (n // 2), "x@" + "z" * n, "1" * n, "1 " * (n // 2), "1.1.1." * (n // 6),
            "Mr " + "A" + "b" * n + " C" + "d" * n, "Mr A " * (n // 5), "+1" * (n // 2), "AB12" * (n // 4), "ab" * (n // 2), "123-" * (n // 4)]
    got = changed(make_docs(list(enumerate(runs))))
    assert len(got) == len(runs) and got[1].text == runs[1] and got[4].text == runs[4]
    assert got[0]["__n_entities"] == got[2]["__n_entities"] == got[8]["__n_entities"] == got[12]["__n_entities"] == 1
    assert got[0].text.endswith(".example") and got[12].text != runs[12] and len(got[12].text) == n


def test_mail_after_another_entity(make_docs):
    t = changed(make_docs([(1, "(441) 555-3597.bob@x.com"), (2, "abcdef" * 6 + " no digit in it")]))
    assert "bob" not in t[1].text and t[1]["__n_entities"] == 2
    assert t[2]["__n_entities"] == 1 and t[2].text.endswith(" no digit in it")


def test_few_mailboxes_of_a_domain_get_distinct_surrogates(make_docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    got = changed(make_docs([(i, f"{c}@one.org") for i, c in enumerate(letters)]))
    assert len({r.text for r in got.values()}) == 26 and not {r.text for r in got.values()} & {f"{c}@one.org" for c in letters}
