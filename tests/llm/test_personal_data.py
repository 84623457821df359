import random
import re

import numpy as np

from llm.helpers import documents
from trustscore.llm import personal_data
from trustscore.llm.personal_data import CHAIN, LABELS, SKIP, Field, Graph

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        doubled = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and doubled % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(spans)


def test_base_spans_match_the_patterns():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choice("0123456789..@@ab+- ()1%é") for _ in range(draw.randrange(60)))
        assert personal_data.base_spans(text) == brute(text)
    for text in ("1" * 50_000, "a" * 50_000 + "@", "+1 " * 20_000, "1." * 20_000, "a@b." * 5_000):
        assert personal_data.base_spans(text) == brute(text)


def test_messages_are_exact_on_a_tree():
    draw = np.random.default_rng(1)
    field = Field(np.zeros((1, LABELS)), draw.normal(size=(LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    unary = draw.normal(size=(3, LABELS))
    edges = np.array([[0, 1, CHAIN], [1, 2, CHAIN]])
    joint = np.zeros((LABELS,) * 3)
    for a in range(LABELS):
        for b in range(LABELS):
            for c in range(LABELS):
                joint[a, b, c] = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + field.potentials[0][a, b] + field.potentials[0][b, c])
    joint /= joint.sum()
    got = field.marginals(unary, edges)
    for axis in range(3):
        others = tuple(i for i in range(3) if i != axis)
        assert np.allclose(got[axis], joint.sum(axis=others), atol=0.01)


def test_repeats_are_linked_one_by_one():
    graph = Graph("555-7713 x 555-7713 y 555-7713", [])
    assert {(a, b) for a, b, kind in graph.edges if kind == SKIP} == {(0, 1), (1, 2)}


def test_repeated_entities_are_added_and_others_left_alone(spark):
    base = [(i, f"call +1 ({i:03d}) 555-{7000 + i} or mail a{i}@mail.example.com, version 3.0 of 2024", "en", "a", 0) for i in range(60)]
    extra = [
        (1000, "call +1 (017) 555-7713 now. later 1 (017) 555-7713 or 017 555-7713 again", "en", "a", 0),
        (1001, "only 1 (017) 555-7713 here, 12345678 and 3.0", "en", "a", 0),
        (1002, "cards 7536784127813050 4845168114407329 and again 4845168114407329", "en", "a", 0),
        (1003, None, "en", "a", 0),
        (1004, "", "en", "a", 0),
    ]
    got = {r.doc_id: r for r in personal_data.find(documents(spark, base + extra)).collect()}
    for doc, text, *_ in base + extra:
        spans = [(s.start, personal_data.KINDS.index(s.kind), s.end) for s in got[doc].base]
        assert spans == brute(text or "")
        assert [got[doc][f"n_{k}"] for k in personal_data.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
    added = [(s.kind, extra[0][1][s.start : s.end]) for s in got[1000].added]
    assert len(added) == 2 and all(kind == "phone" and "555-7713" in piece for kind, piece in added)
    assert all(not got[doc].added for doc in (*range(60), 1001, 1003, 1004))


def test_empty_table_and_clashing_columns(spark):
    assert personal_data.find(documents(spark, [])).count() == 0
    frame = spark.createDataFrame([(None, "a@b.cd", 1), (None, "a@b.cd", 1)], "doc_id long, text string, base int")
    assert [r.n_email for r in personal_data.find(frame).collect()] == [1, 1]


def test_evidence_reaches_every_repeat(spark):
    base = [(i, f"call +1 ({i:03d}) 555-{7000 + i} or mail a{i}@mail.example.com, version 3.0 of 2024", "en", "a", 0) for i in range(60)]
    later = "phone +442079460958" + " or call 442079460958" * 40
    earlier = "442079460958 or call " * 40 + "phone +442079460958"
    rows = base + [(1000, later, "en", "a", 0), (1001, earlier, "en", "a", 0)]
    got = {r.doc_id: r for r in personal_data.find(documents(spark, rows)).collect()}
    for doc, text in ((1000, later), (1001, earlier)):
        assert {(s.kind, text[s.start : s.end]) for s in got[doc].added} == {("phone", "442079460958")}
        assert len(got[doc].added) == 40
    assert all(r.converged for r in got.values())


def test_messages_run_until_they_settle(monkeypatch):
    field = Field(np.zeros((1, LABELS)), np.zeros((LABELS, LABELS)), 3.0 * (2 * np.eye(LABELS) - 1))
    unary = np.zeros((40, LABELS))
    unary[0, 4] = 8.0
    edges = np.array([[i, i + 1, SKIP] for i in range(39)])
    got, open_ones = field.settled(unary, edges, np.zeros(40, dtype=np.int64))
    assert not len(open_ones) and got[39].argmax() == 4 and got[39, 4] > 0.3
    monkeypatch.setattr(personal_data, "ROUNDS", 3)
    assert field.settled(unary, edges, np.zeros(40, dtype=np.int64))[1].tolist() == [0]
