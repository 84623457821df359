import math

from llm.helpers import corpus, documents, words
from trustscore.llm import mixing


def fill(sizes, weights, share, epochs):
    """Clamp, reshare, repeat."""
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plan(rows):
    sizes = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + len(words(row[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}


def test_targets_and_takes(spark):
    rows = corpus(count=80)
    got = [tuple(r) for r in mixing.mix(documents(spark, rows)).collect()]
    sizes, weights = plan(rows)
    target = fill(sizes, weights, 1.5, 2)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for doc, size, source_size, wanted, took in got:
        assert size == len(words(next(r[1] for r in rows if r[0] == doc)))
        assert source_size == sizes[source[doc]] and math.isclose(wanted, target[source[doc]])
        assert 0 <= took <= 2 * size
        taken[source[doc]] = taken.get(source[doc], 0) + took
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = [tuple(r) for r in mixing.mix(documents(spark, rows).repartition(5)).collect()]
    assert sorted(got) == sorted(again)


def test_mixed_rows_carry_what_the_plan_takes(spark):
    rows = corpus(count=40)
    frame = documents(spark, rows)
    plan_of = {r.doc_id: r.taken for r in mixing.mix(frame).collect()}
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    took = {}
    for row in mixed.collect():
        took[row.doc_id] = took.get(row.doc_id, 0) + len(words(row.text))
    assert took == {doc: n for doc, n in plan_of.items() if n}


def test_many_buckets(spark, monkeypatch):
    rows = [(i, "w " * (i % 50 + 1), "en", f"s{i % 3}", 0) for i in range(900)]
    expected = sorted(map(tuple, mixing.mix(documents(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert sorted(map(tuple, mixing.mix(documents(spark, rows)).collect())) == expected


def test_edges(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed(documents(spark, [])).count() == 0
    blank = documents(spark, [(1, None, "en", None, 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0)])
    assert sorted(r.taken for r in mixing.mix(blank).collect()) == [0, 0, 0]
    clash = spark.createDataFrame([(1, "a b c", "s", 4, True)], "doc_id long, text string, source string, size int, cut boolean")
    assert mixing.mixed(clash).columns == clash.columns
    [row] = mixing.mix(clash).collect()
    assert row.target == 4.5 and row.taken in (4, 5)


def test_ranks_follow_code_points(spark):
    names = ["b", "a", "Z", "é", "", None, "𝄞", "ﬀ"]
    frame = spark.createDataFrame([(n,) for n in names], "source string").repartition(4)
    got = [r.source for r in sorted(mixing.ranked_sources(frame).collect(), key=lambda r: r["rank"])]
    assert got == ["", "Z", "a", "b", "é", "ﬀ", "𝄞", None]
