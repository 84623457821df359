"""Tiles of the network signal: what is written and shuffled grows with the texts, not with the pairs of tiles."""

import math

import numpy as np
import pyarrow as pa
import pytest

from trustscore.functions import grams
from trustscore.operators import network_signal, similarity_sums
from trustscore.session import materialized


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def tiles(spark, count):
    rows = [(product, tile, tile % 3 == 0) for product in ("p", "q") for tile in range(-1, count)]
    return spark.createDataFrame(rows, "product_id string, tile int, asking boolean")


def test_every_pair_of_tiles_meets_once_without_a_shuffle(spark):
    held = tiles(spark, 6).withColumn("asking", network_signal.F.lit(True))
    pairs = network_signal.tile_pairs(held, held)
    assert "CartesianProduct" in pairs._jdf.queryExecution().executedPlan().toString() and exchanges(pairs) == 0
    found = [(r.a_product_id, *sorted((r.a_tile, r.b_tile))) for r in pairs.collect()]
    assert sorted(found) == [(p, a, b) for p in ("p", "q") for a in range(-1, 6) for b in range(a, 6)]


def test_asking_tiles_meet_every_tile_once(spark):
    held = tiles(spark, 7)
    pairs = network_signal.tile_pairs(held.filter("asking"), held).collect()
    asking = {tile for tile in range(-1, 7) if tile % 3 == 0}
    wanted = {(p, a, b) for p in ("p", "q") for a in range(-1, 7) for b in range(a, 7) if {a, b} & asking}
    found = [(r.a_product_id, *sorted((r.a_tile, r.b_tile))) for r in pairs]
    assert len(found) == len(set(found)) and set(found) == wanted


def reviews(spark, texts):
    rows = [("p", f"r{i}", value, i) for i, value in enumerate(texts)]
    return spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")


def test_chosen_texts_stand_in_tiles_of_their_own(spark):
    frame = reviews(spark, [f"review number {i} of a long row of reviews" for i in range(30)])
    keyed = network_signal.with_canonical(frame)
    texts = network_signal.combined_texts(keyed).withColumn(
        "wanted", network_signal.F.col("canonical") == "reviewnumber7ofalongrowofreviews"
    )
    stats = network_signal.product_stats(network_signal.text_facts(keyed), 200)
    stats = stats.withColumn("asked_tiles", network_signal.F.lit(1))
    held = {r.tile: r.texts for r in network_signal.gram_tiles(texts, stats).collect()}
    assert held[-1] == ["reviewnumber7ofalongrowofreviews"] and len(held) > 3
    assert sum(map(len, held.values())) == 30


def test_weights_are_taken_without_shuffling_the_grams_of_a_text(spark):
    contents = ["abc abc", "abcd", "x", None, "abcd"]
    keyed = network_signal.with_canonical(reviews(spark, contents))
    weights = network_signal.tfidf(keyed)
    found = {(bytes(r.text_key), r.term): r.weight for r in weights.collect()}
    key = bytes(keyed.filter("review_id = 'r1'").first().text_key)

    def idf(df):
        return 1 + math.log((1 + 3) / (1 + df))

    raw = {"ab": idf(3), "bc": idf(3), "cd": idf(2), "abc": idf(3), "bcd": idf(2), "abcd": idf(2)}
    norm = math.sqrt(sum(value * value for value in raw.values()))
    assert {term: w for (k, term), w in found.items() if k == key} == pytest.approx({t: w / norm for t, w in raw.items()})
    per_text = weights.groupBy("product_id", "text_key").count()
    assert per_text.count() == 2


def test_rates_give_the_reciprocal_over_all_lengths():
    for least, most in ((18, 18), (18, 900), (18, 3e5), (5_000, 2e7)):
        rate, weight = similarity_sums.rates(least, most)
        x = np.geomspace(least, most, 500)
        assert np.abs((weight * np.exp(-np.outer(x, rate))).sum(axis=1) * x - 1).max() < 1e-10


def test_overlaps_of_many_lengths_are_summed_without_meeting():
    rng = np.random.default_rng(4)
    sizes, copies = rng.integers(9, 40_000, 300), rng.integers(1, 4, 300)
    codes, owners = (part.ravel() for part in np.meshgrid(np.arange(7) * 2**30, np.arange(300)))
    tfs = rng.integers(1, 60, len(codes))
    counts = np.zeros((300, 7))
    counts[owners, codes // 2**30] = tfs
    overlap = np.minimum(counts[:, None, :], counts[None, :, :]).sum(axis=2)
    expected = (2 * overlap / (sizes[:, None] + sizes[None, :])) @ copies
    assert similarity_sums.overlap_gains(codes, owners, tfs, sizes, copies) == pytest.approx(expected, rel=1e-9)


def test_texts_move_once_to_their_tiles(spark, monkeypatch):
    """Reading the vocabularies and weighting the tiles share one shuffle of the texts, and no tile is written for it."""
    written = []
    keyed = materialized(
        network_signal.with_canonical(reviews(spark, [f"some review {i % 9} of a row" for i in range(40)])).drop("content"), "canonical"
    )
    monkeypatch.setattr(network_signal, "materialized", lambda rows, name: written.append(name) or materialized(rows, name))
    weights = network_signal.tfidf(keyed)
    assert len({bytes(r.text_key) for r in weights.collect()}) == 9
    plan = weights._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")]
    assert final.count("REPARTITION_BY_NUM, [plan") - final.count("ReusedExchange") <= 2 and "ReusedExchange" in final
    assert written == ["stats"]


def test_copies_go_without_their_characters():
    rows = [{"product_id": p, "text_key": k, "canonical": k.decode() * 9, "length": 9} for p, k in (("p", b"a"), (None, b"a"), ("p", b"a"), ("p", b"b"))]
    batches = [pa.RecordBatch.from_pylist(rows), pa.RecordBatch.from_pylist(rows[:3])]
    sent = pa.Table.from_batches(list(network_signal._first_copies(iter(batches)))).to_pylist()
    found = [(r["product_id"], r["text_key"], r["copies"], r["canonical"] is not None) for r in sent]
    assert found == [("p", b"a", 2, True), (None, b"a", 1, True), ("p", b"b", 1, True), ("p", b"a", 2, False), (None, b"a", 1, False)]


def test_pairs_of_two_files_meet_in_one_order(spark):
    held = tiles(spark, 40).withColumn("asking", network_signal.F.lit(True))
    orders = {}
    for r in network_signal.tile_pairs(held, held).collect():
        pair = (r.a_tile // network_signal.FILE_TILES, r.b_tile // network_signal.FILE_TILES)
        orders.setdefault((r.a_product_id, *sorted(pair)), set()).add(pair)
    assert all(len(found) == 1 for found in orders.values()) and len(orders) == 2 * 21


def test_products_that_fit_one_tile_are_not_held_against_each_other(spark):
    """Many small products cost what they hold; their evidence, short texts and copies included, is that of tiles."""
    rows = [
        (product, f"{product}{i}", value, i)
        for product in ("p", "q", "s", None)
        for i, value in enumerate(
            [f"some review {i * len(product or '') % 11} of a row" for i in range(30)] + ["ab", "x", "", None, "ab ab", "some", "ab"]
        )
    ]
    rows += [("lone", "l", "a single review of some length", 0), ("few", "f", "ab", 0)]
    frame = spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")
    for measure in ("hybrid", "cosine", "dice"):
        whole = network_signal.text_evidence(frame, measure)
        tiled = network_signal.text_evidence(frame, measure, tile_characters=60)
        assert "Cartesian" not in whole._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" in tiled._jdf.queryExecution().executedPlan().toString()
        one, other = ({(r.product_id, bytes(r.text_key)): r for r in rows.collect()} for rows in (whole, tiled))
        assert one.keys() == other.keys() and len(one) > 30
        for key, row in one.items():
            assert (row.strong, row.compared) == (other[key].strong, other[key].compared)
            assert row.total == pytest.approx(other[key].total) and row.top == pytest.approx(other[key].top)


def test_few_codes_of_a_large_alphabet_are_numbered_alike():
    codes = np.array([7, 1_000_003, 7, 0, 12])
    wide, narrow = grams._numbers(codes, grams.CODE_POINTS), grams._numbers(np.tile(codes, 10**4), grams.CODE_POINTS)
    assert wide[0].tolist() == narrow[0].tolist() == [0, 7, 12, 1_000_003]
    assert wide[1].tolist() == narrow[1][:5].tolist() == [1, 3, 1, 0, 2]


@pytest.mark.parametrize("ratio", [0.01, 4, 150])
def test_postings_are_those_that_the_left_side_reads(monkeypatch, ratio):
    """However codes are dealt to columns and postings, the product is the plain one; other codes are not even sorted."""
    monkeypatch.setattr(network_signal, "DENSE_RATIO", ratio)
    draw = np.random.default_rng(3)
    a, b = (np.where(draw.random((n, 60)) < np.linspace(0.02, 0.9, 60), draw.random((n, 60)), 0.0) for n in (30, 20))
    a[:, 40:50] = 0.0
    entries = [(*np.nonzero(side), side[np.nonzero(side)]) for side in (a, b)]
    product = network_signal._Product(*entries, (30, 20), 60)
    assert product.strip(0, 30) == pytest.approx(a @ b.T) and product.strip(7, 11) == pytest.approx(a[7:11] @ b.T)
    often = np.count_nonzero(a, axis=0), np.count_nonzero(b, axis=0)
    postings = (often[0] > 0) & (often[0] * often[1] * ratio <= 30 * 20)
    assert len(product.rows_b) == len(product.values_b) == often[1][postings].sum() == product.first[-1]
