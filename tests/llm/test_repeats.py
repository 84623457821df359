import hashlib

import pytest

from llm.helpers import corpus, documents, words
from trustscore.llm import repeats


def brute(rows, length):
    first = {}
    for doc, text in rows:
        w = words(text)
        for at in range(len(w) - length + 1):
            key = tuple(w[at : at + length])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for at in range(len(w) - length + 1):
            key = tuple(w[at : at + length])
            if key in first and (doc is None or first[key] < doc):
                gone |= set(range(at, at + length))
        kept = " ".join(word for place, word in enumerate(w) if place not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    rows = frame.collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in rows), key=str
    )


@pytest.mark.parametrize("length", [4, 13, 20])
def test_same_words_go_as_in_a_plain_search(spark, length):
    rows = corpus()
    assert found(repeats.remove_repeats(documents(spark, rows), length)) == brute([r[:2] for r in rows], length)


def test_small_blocks_and_many_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_BYTES", 500)
    rows = corpus(seed=9)
    assert found(repeats.remove_repeats(documents(spark, rows).repartition(9))) == brute([r[:2] for r in rows], 13)


def test_null_and_equal_ids_ties_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(30))
    rows = [(None, long, 1, "k"), (5, long, 2, "k"), (5, long, 3, "k"), (5, "y " * 40, 3, "k"), (2, "y " * 13, 4, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d long, keys string")
    assert found(repeats.remove_repeats(frame)) == brute([r[:2] for r in rows], 13)


def test_empty_table_and_short_windows(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, []), 3)


def test_entries_survive_packing():
    import numpy as np

    keys = np.array([0, 5, 5, 2**48 - 1])
    entries = repeats.Entries(keys, np.array([-1, 0, 7, 2**63 - 1]), np.array([3, -9, 0, 1]), np.array([0, -1, 1, 0], np.int8))
    back = repeats.Entries.unpacked([entries.packed(), entries.packed()])
    assert back.keys.tolist() == [*keys, *keys] and back.hashes[3] == 2**63 - 1
    assert back.d.tolist()[:4] == [3, -9, 0, 1] and back.marks.tolist()[:4] == [0, -1, 1, 0]


def test_what_blocks_decide_alone_never_meets_in_one_group():
    import numpy as np

    # The same passage in every block: all blocks share their smallest key.
    groups, keys = [], np.arange(100, dtype=np.int64)
    for block in range(20):
        d = np.repeat(np.arange(3) + 3 * block, len(keys))
        part = (np.tile(keys, 3), np.tile(keys, 3), d)
        for batch in repeats._send([part], "stretches", 7):
            groups += [(r["p"], len(repeats.Entries.unpacked([r["blob"]]).keys)) for r in batch.to_pylist() if r["local"]]
    assert len(groups) == 20 == len({p for p, _ in groups})
    assert all(count == 200 for _, count in groups)


def test_long_words_made_to_collide_are_told_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{word} {tail}"), (2, f"{other} {tail}"), (3, f"x {word} {tail}")]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
