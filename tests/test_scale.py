"""What a query costs per character, per gram or per pair of tiles stays bounded."""

import itertools
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustscore.functions import grams, text
from trustscore.llm import collocations
from trustscore.operators import diagnosis, network_signal


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_normalising_collapses_once_and_looks_for_no_characters(spark):
    rows = spark.createDataFrame([("Ab  c",)], "x string")
    for column, passes in ((text.normalize_text("x"), 1), (text.canonical_text("x"), 1)):
        shown = plan(rows.select(column.alias("y")))
        assert shown.lower().count("regexp_replace") == passes and "rlike" not in shown.lower()


def test_sentences_are_split_and_sorted_once(spark):
    rows = spark.createDataFrame([("A b. A b. c. A b.",)], "x string")
    found = rows.select(diagnosis._thrice(diagnosis._sentences(F.col("x"))).alias("y"))
    assert found.first().y
    shown = plan(found).lower()
    assert shown.count("split(") == 1 and shown.count("sort_array(") == 1


def test_vocabularies_move_as_one_row_per_tile_and_bucket(spark):
    """A row per gram and tile took twice the disk and more; its order must be that of the codes of a side."""
    texts = [f"review number {i} of a long row of reviews" for i in range(40)] + ["tiny", "tiny", "abc"]
    rows = [(p, f"r{i}", value, i) for p in ("p", "q") for i, value in enumerate(texts)]
    keyed = network_signal.with_canonical(spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long"))
    stats = network_signal.product_stats(network_signal.text_facts(keyed), 300)
    tiles = network_signal.gram_tiles(network_signal.combined_texts(keyed), stats)
    schema = network_signal.VOCABULARY_SCHEMA
    packed = tiles.select("product_id", "tile", "buckets", "texts", "copies").mapInArrow(network_signal._vocabularies, schema)
    assert tiles.count() > 6 and packed.count() == 8 * tiles.count()
    short = network_signal.combined_texts(keyed.filter(F.length("canonical") < 10))
    canonical = [r.canonical for r in keyed.filter("product_id = 'p'").collect()]
    for row in network_signal.weighted_tiles(tiles, short).filter("product_id = 'p'").collect():
        _, _, _, terms = network_signal._counted(row.texts)
        frequency = [sum(term in value for value in canonical) for term in terms.to_pylist()]
        assert row.idf == pytest.approx([1 + math.log((1 + len(canonical)) / (1 + df)) for df in frequency])


def test_a_task_returns_one_row_per_text_for_all_its_pairs():
    texts = [[f"text{k}{i}abc" for i in range(5)] for k in range(4)]
    sides = []
    for k, held in enumerate(texts):
        terms = network_signal._counted(held)[3]
        sides.append({"product_id": "p", "tile": k, "keys": [value.encode() for value in held], "copies": [1] * 5,
                      "wanted": [True] * 5, "texts": held, "idf": [1.0] * len(terms)})
    pairs = [{f"{side}_{name}": value for side, half in zip("ab", pair) for name, value in half.items()}
             for pair in itertools.combinations_with_replacement(sides, 2)]
    out = pa.Table.from_batches(network_signal._block_worker("hybrid")(iter(pa.Table.from_pylist(pairs).to_batches())))
    assert out.num_rows == 20 and out["compared"].to_pylist() == [19] * 20


def test_holders_of_a_gram_are_added_up_per_slice_of_a_product():
    batch = pa.RecordBatch.from_pydict(
        {"product_id": ["p", None, "p", "q"], "copies": [1, 2, 3, 4], "canonical": ["abab", "ab", "ab", "bc"]}
    )
    found = pa.Table.from_batches(grams.gram_holders("canonical", (2, 3))(iter([batch]))).to_pylist()
    assert sorted((str(r["product_id"]), r["term"], r["copies"]) for r in found) == [
        ("None", "ab", 2), ("p", "ab", 4), ("p", "aba", 1), ("p", "ba", 1), ("p", "bab", 1), ("q", "bc", 4)
    ]


def test_splitting_into_words_takes_few_times_the_text():
    data = np.frombuffer((b"x" * 99 + b" ") * 20_000, dtype=np.uint8)
    tracemalloc.start()
    words, _, piece = collocations._words(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 20_000 and not piece.any() and peak < 8 * len(data)
