import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa

from llm.helpers import documents
from trustscore.llm import collocations


def plain(rows, min_count=10, covered=50, listed=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for at in range(len(words) - size + 1):
                    counts[lang][tuple(words[at : at + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for phrase, a in candidates.items():
            longer = (b for p, b in candidates.items() if len(p) > len(phrase) and phrase in (p[:2], p[1:]))
            if any(100 * b >= covered * a for b in longer):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:listed], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(frame, **limits):
    return sorted(tuple(row) for row in collocations.collocations(frame, **limits).collect())


def spoken(seed=1, count=150):
    draw = random.Random(seed)
    bag = [f"w{i}" for i in range(25)] + ["É", "ß", "日本", "The", "the", "x\x1cy", "tab\x0bbed"]
    fixed = ["New York City", "of the", "a a a a", "in spite of", "Red. Herring", "d'accord\tmon ami"]
    rows = []
    for number in range(count):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(bag) for _ in range(draw.randrange(0, 60))]
        text = "".join(part + draw.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "; ", "!"]) for part in parts)
        rows.append((number, text, draw.choice(["en", "en", "de", None, "und", "a b", ""]), "s", None))
    rows += [(900, None, "en", None, None), (901, "", None, None, 0), (902, " ., ", "fr", None, 0), (0, rows[0][1], "en", "s", 1)]
    rows.append((903, " ".join(draw.choices(bag[:6], k=9000)), "en", "s", None))
    return rows


def test_phrases_equal_plain_counts(spark):
    rows = spoken()
    wanted = plain(rows)
    assert got(documents(spark, rows)) == wanted
    assert {len(row[2].split(" ")) for row in wanted} == {2, 3} and len({row[0] for row in wanted}) > 3


def test_other_limits_and_ties_at_the_end_of_the_list(spark):
    rows = spoken(2, 80)
    frame = documents(spark, rows)
    assert got(frame, min_count=3, covered_percent=80, listed=7) == plain(rows, 3, 80, 7)


def test_one_pair_in_most_rows_and_small_slices(spark, monkeypatch):
    """Frequent first words and pairs are dealt by their next word; their counts stay whole."""
    draw = random.Random(4)
    rows = [(i, f"hot pair v{draw.randrange(40)} hot u{draw.randrange(30)} z{i % 4}", "en", "s", None) for i in range(1500)]
    heads, pairs = collocations.frequent_beginnings(documents(spark, rows))
    assert "hot" in heads and "hot pair" in pairs
    assert got(documents(spark, rows).repartition(7)) == plain(rows)


def test_counts_beyond_64_bits_stay_exact(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    counts = [("en", None, None, None, 9 * 10**12), ("en", "x", None, None, left), ("en", "y", None, None, right), ("en", "x", "y", None, a)]
    frame = spark.createDataFrame(counts, "lang string, first string, second string, third string, f long")
    assert collocations.scored_phrases(frame).first().score == 10**6 * a * a // (left * right)


def test_empty_table_and_clashing_names(spark):
    assert got(documents(spark, [])) == []
    rows = spoken(3, 60)
    clashing = documents(spark, rows).selectExpr("*", "'q' as window", "1 as n", "2 as f", "'h' as head", "3 as salt", "4 as first")
    assert got(clashing) == plain(rows)


def test_counting_a_large_batch_takes_little_memory():
    """Two workers share an executor with its heap: the arrays of a slice stay far below the 124 MB of 6 MB of text."""
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(1000)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    tracemalloc.start()
    try:
        windows = sum(sum(part.column("n").to_pylist()) for part in collocations._windows(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert windows == 1_200_000 and peak < 100_000_000
