import random
import zlib

import numpy as np

from llm.helpers import documents
from trustscore.llm import toxicity
from trustscore.llm.words import find_words


def labelled(count=700, seed=1):
    draw = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ta", "lo", "mi", "re", "su") for b in ("n", "rk", "st", "ll", "p", "ve", "dy")]
    rude = ["zorkish", "blatnik", "Gruv"]
    rows, marks = [], []
    for i in range(count):
        w = draw.choices(plain, k=draw.randrange(1, 90))
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(draw.randrange(len(w) + 1), draw.choice(rude) + draw.choice(["", "!!", "***"]))
        rows.append((i, " ".join(w), "en", "a", 0))
        marks.append((i, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = labelled()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows), labels).collect()}
    truth = dict(marks)
    held = [doc for doc in truth if zlib.crc32(str(doc).encode()) % 4 == 2]
    assert {doc for doc, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[doc].predicted == truth[doc] for doc in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_and_other_columns_never_matter(spark):
    rows, marks = labelled(300)
    flipped = [(doc, 1 - t if zlib.crc32(str(doc).encode()) % 4 == 2 else t) for doc, t in marks]
    schema = "doc_id long, toxic int"
    first = toxicity.score(documents(spark, rows), spark.createDataFrame(marks, schema)).collect()
    moved = documents(spark, [(d, t, "xx", None, -1) for d, t, *_ in rows])
    second = toxicity.score(moved, spark.createDataFrame(flipped, schema)).collect()
    assert {r.doc_id: r.score for r in first} == {r.doc_id: r.score for r in second}


def test_gradient_matches_differences():
    sets = [[b"aa", b"bb", b"cc"], [b"aa"] * 16, [b"idiot", b"bb", b"dd"]]
    data = np.frombuffer(b" ".join(w for s in sets for w in s), dtype=np.uint8)
    words = find_words(data, np.array([0, len(data)]))
    distinct, chosen, number = np.unique(words.hashes, return_index=True, return_inverse=True)
    network = toxicity.Network(distinct)
    network.weights = {name: value.astype(np.float64) for name, value in network.weights.items()}
    sizes = np.array([3, 16, 3])
    mask = np.arange(16) < sizes[:, None]
    at = number[np.minimum((np.cumsum(sizes) - sizes)[:, None] + np.arange(16), len(number) - 1)]
    inputs = network.inputs(np.arange(len(distinct)), *toxicity.char_buckets(words, chosen))
    kept = {}
    network.forward(inputs, at, mask, kept)
    found, _ = network.gradient(inputs, at, mask, kept, np.ones(3))
    for name in ("forward_again", "backward_in", "attend", "attend_out", "out", "backward_bias"):
        weight = network.weights[name]
        place = tuple(size // 2 for size in weight.shape)
        old = weight[place]
        weight[place] = old + 0.02
        up = network.forward(inputs, at, mask).sum()
        weight[place] = old - 0.02
        down = network.forward(inputs, at, mask).sum()
        weight[place] = old
        assert abs((up - down) / 0.04 - found[name][place]) < 1e-3 * max(1, abs(found[name][place]))


def test_windows_cover_every_word():
    first = np.concatenate([[0], np.cumsum([0, 1, 15, 16, 17, 24, 100, 1000])])
    row, start, size = toxicity.window_starts(first)
    covered = np.zeros(first[-1], dtype=bool)
    for r, s, n in zip(row, start, size):
        assert first[r] <= s and s + n <= first[r + 1]
        covered[s : s + n] = True
    assert covered.all()


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(documents(spark, []), none).count() == 0
    frame = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "x", 1), (2, "** !!", 2)], "doc_id long, text string, toxic int")
    assert [r.score for r in toxicity.score(frame, none).collect()] == [0.0] * 4
    rows, marks = labelled(200)
    extra = [(9000, None, "en", "a", 0), (9001, "", "en", "a", 0), (9002, "** !! \n", "en", "a", 0), (None, "lon mip", "en", "a", 0)]
    doubled = spark.createDataFrame([*marks, *marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(documents(spark, rows + extra), doubled)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[9000] == scores[9001] == scores[9002] == 0.0 and len(scores) == 204
