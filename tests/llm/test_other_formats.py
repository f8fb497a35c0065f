"""Personal data in formats that the base matchers leave out, among numbers that look like it."""

from __future__ import annotations

import numpy as np

from edgeloom.llm import pii

from edgeloom.llm.common import table

from . import brute


def _number(draw, n: int) -> str:
    return str(draw.integers(1, 10)) + "".join(map(str, draw.integers(0, 10, n - 1)))


def _card(draw, prefix: str, n: int) -> str:
    body = prefix + "".join(map(str, draw.integers(0, 10, n - 1 - len(prefix))))
    return next(body + str(d) for d in range(10) if brute.luhn(body + str(d)))


def _phone(draw, form: str) -> str:
    return form.format(draw.integers(200, 1000), draw.integers(100, 1000), draw.integers(1000, 10000))


def planted(draw) -> tuple[list[tuple[int, str]], list[tuple[int, str, str, int, int]]]:
    """(documents, and of each planted case: document, name, kind or '' for none, start, end)."""
    four = lambda c, by: by.join(c[k : k + 4] for k in range(0, len(c), 4))
    makers = {
        "bracketed phone": ("phone", lambda: ("call ", _phone(draw, "({}) {}-{}"))),
        "bracketed phone, no cue": ("phone", lambda: ("at noon ", _phone(draw, "({}) {}-{}"))),
        "dashed phone": ("phone", lambda: ("or ", _phone(draw, "{}-{}-{}"))),
        "trunk phone": ("phone", lambda: ("fax ", "030 " + _number(draw, 4) + " " + _number(draw, 4))),
        "13-digit card": ("card", lambda: ("paid ", _card(draw, "4", 13))),
        "15-digit card": ("card", lambda: ("amex ", _card(draw, "37", 15))),
        "dotted card": ("card", lambda: ("visa ", four(_card(draw, "4", 16), "."))),
        "address beyond ASCII": ("email", lambda: ("to ", f"jörg{_number(draw, 2)}@müller{_number(draw, 2)}.de")),
        "date and time": ("", lambda: ("on ", f"2024-0{draw.integers(1, 10)}-1{draw.integers(0, 10)} 10")),
        "number of an order": ("", lambda: ("order ", _number(draw, 11))),
        "16 digits that fail": ("", lambda: ("id ", next(x for x in iter(lambda: _number(draw, 16), None) if not brute.luhn(x)))),
        "octets beyond range": ("", lambda: ("release ", f"{draw.integers(300, 999)}.1.2.{draw.integers(1, 9)}")),
        "handle": ("", lambda: ("see ", f"user{_number(draw, 3)}@home")),
    }
    docs, cases = [], []
    for doc in range(1300):
        name = list(makers)[doc % len(makers)]
        kind, make = makers[name]
        before, hit = make()
        text = f"some words {before}"
        docs.append((doc, f"{text}{hit} and more"))
        cases.append((doc, name, kind, len(text), len(text) + len(hit)))
    return docs, cases


def test_formats_beyond_the_base_are_found(spark):
    docs, cases = planted(np.random.default_rng(5))
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "spans").collect()}
    hit, of = {}, {}
    for doc, name, kind, start, end in cases:
        good = (kind, start, end) in found[doc] if kind else not found[doc]
        of[name], hit[name] = of.get(name, 0) + 1, hit.get(name, 0) + good
    shares = {name: hit[name] / of[name] for name in of}
    print(shares)
    assert min(shares.values()) >= 0.95, shares


#: Texts outside any training table: nothing in them is personal data.
LOOKALIKES = [
    "see user@localhost or meet@noon, price@3", "version 999.1.2.3 and 10.20.30.400 of 300.300.300.300", "first.last@intranet wrote a.b.c.d@e", "run 2024-05-12 10:30 and 12.05.2024 again",
    "serial 4111111111111112 or 5500 0000 0000 0005 1", "items 3,141,592 of 10 000 000", "room@12 or half@home.", "build 1.2.3.999 on 5.5.5.260",
]
#: What must be found there all the same.
GENUINE = [("mail anna.k@mail.example.org now", "email"), ("host 10.2.3.44 is up", "ip"), ("card 4111 1111 1111 1111 paid", "card"), ("call +49 30 1234567 today", "phone")]


def test_lookalikes_outside_the_training_table_stay(spark):
    """Models of the driver's table, whose own emails and addresses are all in base formats, on texts it does not hold."""
    model = pii.train(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))
    texts = [*LOOKALIKES, *(t for t, _ in GENUINE)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(x.kind, texts[r.doc_id][x.start : x.end]) for x in r.spans] for r in pii.find_pii(docs, model=model).select("doc_id", "spans").collect()}
    assert {texts[k]: v for k, v in found.items() if v and k < len(LOOKALIKES)} == {}
    for k, (_, kind) in enumerate(GENUINE):
        assert kind in [x[0] for x in found[len(LOOKALIKES) + k]]


def test_a_kind_without_both_labels_adds_nothing(spark):
    """Words with an @ and no address anywhere: proposals of one label only."""
    docs = spark.createDataFrame([(k, f"meet@noon{k} or half@home and no digits") for k in range(50)], "doc_id long, text string")
    trees, thresholds = pii.train(docs)
    assert thresholds == {} and trees["email"] == [-8.0]
    assert all(not r.spans for r in pii.find_pii(docs).collect())
