import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm.helpers import corpus, documents
from trustscore.llm import components, simhash


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = lower.encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def groups(prints):
    """prints: (doc, fingerprint); smallest doc reachable within three bits."""
    parent = list(range(len(prints)))

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    values = np.array([fp for _, fp in prints], dtype=np.uint64)
    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ value) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = root(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, least[root(i)]) for i, (doc, _) in enumerate(prints)]


def test_fingerprints_and_groups(spark):
    rows = corpus()
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(documents(spark, rows)).collect()}
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    assert {doc: fp for doc, (fp, _) in got.items()} == dict(prints)
    assert {doc: c for doc, (_, c) in got.items()} == dict(groups(prints))


def test_links_of_random_chains_and_dense_families(spark):
    draw = np.random.default_rng(3)
    values = set()
    for _ in range(30):
        value = int(draw.integers(0, 2**64, dtype=np.uint64))
        for _ in range(int(draw.integers(1, 25))):
            values.add(value)
            for bit in draw.choice(64, int(draw.integers(1, 6)), replace=False):
                value ^= 1 << int(bit)
    base = int(draw.integers(0, 2**64, dtype=np.uint64))
    values |= {base ^ sum(1 << int(b) for b in draw.choice(20, 3, replace=False)) for _ in range(300)}
    prints = sorted(values)
    frame = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in prints], "fp long")
    got = {r.fp & (1 << 64) - 1: r.root for r in simhash.linked(frame).collect()}
    classes = {}
    for number, (_, first) in enumerate(groups(list(enumerate(prints)))):
        classes.setdefault(first, set()).add(got[prints[number]])
    assert all(len(roots) == 1 for roots in classes.values())
    assert len({next(iter(roots)) for roots in classes.values()}) == len(classes)


def test_near_copies_leave_one_row_each(spark):
    rows = corpus()
    kept = simhash.drop_near_copies(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    wanted = {c for _, c in groups([(r[0], fingerprint(r[1])) for r in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_nulls_ties_clashes_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2), (3, None, 3)], "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(frame).collect()), key=str)
    assert got == [(3, 3), (None, None), (None, None)]
    assert simhash.drop_near_copies(frame).count() == 2
    assert simhash.near_groups(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 500)] + [(9, 9)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    rows = {r.node: r.root for r in got.collect()}
    assert all(rows[i] == 100 for i in range(100, 161)) and all(rows[i] == 7 for i in range(300, 500)) and rows[9] == 9
    assert got.where(F.col("root") > F.col("node")).count() == 0
