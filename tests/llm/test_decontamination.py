import random
import re

from llm.helpers import documents
from trustscore.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window):
    """Every window of every item against every position of every document."""
    out = []
    for doc_id, text, *_ in docs:
        own, inside, found = words(text), set(), set()
        for item_id, item in items:
            theirs = words(item)
            span = min(window, len(theirs))
            if not span:
                continue
            wanted = {tuple(theirs[i : i + span]) for i in range(len(theirs) - span + 1)}
            at = [i for i in range(len(own) - span + 1) if tuple(own[i : i + span]) in wanted]
            inside.update(i + k for i in at for k in range(span))
            if at and item_id is not None:
                found.add(str(item_id))
        out.append((doc_id, len(own), len(inside), sorted(found)))
    return sorted(out, key=repr)


def got(frame, items, window=10):
    rows = decontamination.contamination(frame, items, window).collect()
    return sorted(((r.doc_id, r.n_words, r["n_hit"], list(r["items"])) for r in rows), key=repr)


def leaky(seed, vocabulary=60):
    draw = random.Random(seed)
    bag = [f"w{i}" for i in range(vocabulary)] + ["É", "ß", "日本", "x"]

    def some(n):
        return [draw.choice(bag) for _ in range(n)]

    items = [(i, some(draw.randrange(1, 40))) for i in range(25)]
    items += [(100, ["a"] * 14), (101, ["a"] * 4), (102, some(9)), (None, some(12)), (103, items[3][1]), (103, some(11))]
    docs = []
    for number in range(50):
        parts = some(draw.randrange(0, 40))
        for _ in range(draw.randrange(4)):
            item = draw.choice(items)[1]
            low = draw.randrange(len(item))
            parts += item[low : low + draw.randrange(1, 40)] + some(draw.randrange(0, 6))
        if number % 9 == 0:
            parts += ["A"] * draw.randrange(3, 30)
        docs.append((number, draw.choice([" ", ", ", "\n", "--"]).join(parts), "en", "s", None))
    docs += [(7, docs[3][1], "en", "s", None), (3, docs[3][1], "en", "s", None), (None, docs[4][1], None, None, None)]
    docs += [(900, None, None, None, None), (901, "", None, None, 0), (902, " ,. ", None, None, 1)]
    docs.append((903, " ".join(some(4000) + items[5][1] + some(2000)), "en", "s", None))
    return docs, [(i, None if not t else " ".join(t).title()) for i, t in items] + [(500, None), (501, " .")]


def test_hits_and_items_equal_every_window_compared(spark):
    for seed, window in ((1, 10), (2, 10), (3, 5)):
        docs, items = leaky(seed)
        found = got(documents(spark, docs), spark.createDataFrame(items, ITEMS), window)
        assert found == plain(docs, items, window)
        assert any(row[2] for row in found) and any(not row[2] for row in found)


def test_every_window_keeps_a_mark(spark):
    """The guarantee: each window of a text contains a kept position, whatever its words."""
    draw = random.Random(9)
    texts = [[draw.choice("ab") for _ in range(80)], ["a"] * 30, [f"w{draw.randrange(9)}" for _ in range(200)], ["q"] * 9]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, words array<string>")
    size = decontamination.gram_size(10)
    for row in decontamination._with_kept_positions(frame, 10).collect():
        for low in range(len(row.words) - 9):
            assert any(low <= at <= low + 10 - size for at in row["at"])
        assert len(row.words) >= 10 or not row["at"]


def test_one_passage_in_most_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"d{i % 5} {passage} e{i % 3}" if i % 3 else f"f{i}", "en", "s", None) for i in range(200)]
    items = [(i, f"x{i} {passage} y{i}") for i in range(40)]
    assert got(documents(spark, docs), spark.createDataFrame(items, ITEMS)) == plain(docs, items, 10)


def test_empty_tables_and_clashing_names(spark):
    docs, items = leaky(4)
    none = spark.createDataFrame([], ITEMS)
    assert got(documents(spark, []), spark.createDataFrame(items, ITEMS)) == []
    assert got(documents(spark, docs), none) == sorted(((d[0], len(words(d[1])), 0, []) for d in docs), key=repr)
    clashing = documents(spark, docs).selectExpr("*", "1 as digest", "2 as mark", "3 as words", "4 as item_id", "5 as at")
    more = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as doc_id", "2 as span", "3 as place")
    assert got(clashing, more) == plain(docs, items, 10)
