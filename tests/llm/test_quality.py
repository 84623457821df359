import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import corpus, documents, words
from trustscore.llm import quality


def measures(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered)


def test_measures_match_a_plain_count(spark):
    repeated = "a b c d e\na b c d e\n x\n\n x\na b c d e " + "q " * 30
    rows = corpus() + [(500, repeated, "en", "a", 0), (501, "# *| <> & é$ 日%\n#\n#", "en", "a", 0)]
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for doc, text, *_ in rows:
        r, wanted = got[doc], measures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == wanted
        failed = wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0]
        assert r.base_failed == failed and r.kept == (not failed)


@pytest.mark.parametrize("failures, trials", [(0, 30), (1, 50), (7, 200), (20, 21), (5, 5), (0, 5000)])
def test_upper_bound_is_exact(failures, trials):
    level = 0.01
    bound = quality.upper_bound(failures, trials, level)
    if failures == trials:
        assert bound == 1
        return
    tail = sum(math.comb(trials, k) * bound**k * (1 - bound) ** (trials - k) for k in range(failures + 1))
    assert math.isclose(tail, level, rel_tol=1e-6)


def test_cutoffs_stop_at_the_first_that_fails_and_take_what_helps():
    good, bad = np.array([0, 0, 1, 400, 500]), np.array([5, 9, 9, 60, 80])
    assert quality.choose_cutoff(good, bad, 5000, 0.01, 0.001) == 1
    assert quality.choose_cutoff(good, bad, 20, 0.01, 0.001) is None
    assert quality.choose_cutoff(good, np.zeros(5, int), 5000, 0.01, 0.001) is None


def test_learned_rules_spare_good_documents(spark):
    plain = "the quick brown fox jumps over a lazy dog near river bank today %d"
    noisy = " ".join("word%d###" % i for i in range(12)) + " %d"
    rows = [(i, (noisy if i % 10 == 0 else plain) % i, "en" if i % 2 else None, "a", 0) for i in range(9000)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 10 != 0)) for r in rows], "doc_id long, quality int")
    judged = quality.judge(documents(spark, rows), labels)
    assert judged.where("kept and doc_id % 10 = 0").count() == 0
    assert judged.where("not kept and doc_id % 10 != 0").count() == 0
    kept = quality.kept_only(documents(spark, rows), labels)
    assert kept.columns == documents(spark, []).columns and kept.count() == 8100


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(documents(spark, []), none).count() == 0
    frame = spark.createDataFrame(
        [(None, "a b c d e f g h i j", "x", 1), (None, "a b c d e f g h i j", "x", 1)],
        "doc_id long, text string, lang string, n_words int",
    )
    labels = spark.createDataFrame([(None, 1), (3, None), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality.judge(frame, labels).where("kept").count() == 2
    assert quality.kept_only(frame, labels).columns == frame.columns
    assert quality.labels_of(labels).where(~F.col("good")).count() == 1
