"""Sums of similarities to all other reviews of a product without comparing pairs.

The mean of N9 needs only the sum of a review's similarities, and both parts of the hybrid similarity are sums over
shared grams, so the pairs can be summed before they are formed:

* cosine: the sum over all texts is the product of a text's vector with the sum of all vectors of its product;
* Dice: the overlap of two texts is divided by the number of bigrams of both. ``1 / (m + n)`` is a sum of products
  ``weight * exp(-rate * m) * exp(-rate * n)`` of some hundred rates, to eleven digits over all lengths (``rates``), so for one
  rate a text meets only the summed factors of all others. Of one bigram, sorted by count, the sum of ``min(a, b)``
  times a factor is a running sum.

Work is linear in the grams of the texts (but for that sorting), whatever their lengths. Grams are counted where they
are used; only distinct grams per tile and the packed bigrams of the texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions.grams import count_grams, slices
from trustscore.operators import network_signal
from trustscore.session import materialized

BUCKETS = 32  # groups of bigrams of a product
DIGITS = 26.0  # natural logarithm of the accuracy of ``rates``


def rates(least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(rate, weight) such that the sum of ``weight * exp(-rate * x)`` is ``1 / x`` for ``least <= x <= most``.

    The trapezoidal rule for the integral of ``exp(-x * exp(t) + t)`` over all ``t``: its error falls exponentially
    with the step, and both tails are cut where they are below it.
    """
    step = np.pi**2 / (DIGITS + 2)
    points = np.arange(-DIGITS - np.log(most), np.log((DIGITS + 4) / least) + step, step)
    return np.exp(points), step * np.exp(points)


def _vector_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted tiles to the sum of their vectors, copies counted: one row per gram."""
    for batch in batches:
        for row in range(batch.num_rows):
            side = network_signal._Side(batch, row)
            sums = np.bincount(side.codes, weights=side.weights * side.copies[side.rows], minlength=len(side.terms))
            index = pa.array(np.full(len(sums), row))
            arrays = [batch.column(name).take(index) for name in ("product_id", "tile")]
            arrays += [pa.array(np.arange(len(sums), dtype=np.int32)), side.terms, pa.array(sums)]
            yield pa.RecordBatch.from_arrays(arrays, names=["product_id", "tile", "position", "term", "part"])


def _dot_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted tiles with the summed vector of their product (``all``) to one row per text."""
    for batch in batches:
        for row in range(batch.num_rows):
            side = network_signal._Side(batch, row)
            gained = side.weights * batch.column("all")[row].values.to_numpy()[side.codes]
            sums = np.bincount(side.rows, weights=gained, minlength=side.size)
            product = batch.column("product_id").take(pa.array(np.full(side.size, row)))
            yield pa.RecordBatch.from_arrays([product, side.keys, pa.array(sums)], names=["product_id", "text_key", "cosine_sum"])


def cosine_sums(tiles: DataFrame) -> DataFrame:
    """Per text (``product_id, text_key``) its summed cosine with all reviews of its product, itself and copies included."""
    parts = tiles.mapInArrow(_vector_parts, "product_id string, tile int, position int, term string, part double")
    product = network_signal.summed_back(parts, network_signal.sum_of_gram("part"), "all")
    dots = tiles.join(product, ["product_id", "tile"])
    return dots.mapInArrow(_dot_products, "product_id string, text_key binary, cosine_sum double")


BIGRAM_SCHEMA = (
    "product_id string, bucket int, keys array<binary>, copies array<bigint>, sizes array<int>, "
    "owners array<int>, codes array<bigint>, tfs array<int>"
)


def _packed_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles to their bigrams, packed per bucket: bigrams as pairs of code points, texts by their place."""
    for batch in batches:
        for row in range(batch.num_rows):
            texts = batch.column("texts")[row].as_py()
            lengths = np.fromiter((len(value) for value in texts), dtype=np.int64, count=len(texts))
            for start, stop in slices(lengths):
                owners, grams, tfs = count_grams(texts[start:stop], (2,))
                points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
                codes = points[::2] << 21 | points[1::2]
                bucket = codes % 1_000_003 % BUCKETS
                for number in np.unique(bucket):
                    inside = np.flatnonzero(bucket == number)
                    held, places = np.unique(owners[inside], return_inverse=True)
                    order = np.argsort(codes[inside], kind="stable")
                    row_of = {
                        "product_id": batch.column("product_id")[row].as_py(),
                        "bucket": int(number),
                        "keys": batch.column("keys")[row].values.take(pa.array(held + start)),
                        "copies": batch.column("copies")[row].values.to_numpy()[held + start],
                        "sizes": (lengths[held + start] - 1).astype(np.int32),
                        "owners": places[order].astype(np.int32),
                        "codes": codes[inside][order],
                        "tfs": tfs[inside][order].astype(np.int32),
                    }
                    arrays = [pa.array([row_of[name]]) for name in ("product_id",)]
                    arrays.append(pa.array([row_of["bucket"]], type=pa.int32()))
                    for name in ("keys", "copies", "sizes", "owners", "codes", "tfs"):
                        values = row_of[name] if name == "keys" else pa.array(row_of[name])
                        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values))
                    yield pa.RecordBatch.from_arrays(arrays, names=list(row_of))


def overlap_gains(
    codes: np.ndarray, owners: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, copies: np.ndarray
) -> np.ndarray:
    """Per text the sum over all texts of ``copies * 2 * overlap / (own size + other size)``.

    An entry says that text ``owners`` holds bigram ``codes`` ``tfs`` times.
    """
    order = np.lexsort((tfs, codes))
    codes, owners, tfs = codes[order], owners[order], tfs[order].astype(np.float64)
    first = np.concatenate([[True], codes[1:] != codes[:-1]])
    starts = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    ends = np.concatenate([starts[1:], [len(codes)]])
    gained = np.zeros(len(sizes))
    for rate, weight in zip(*rates(2.0 * sizes.min(), 2.0 * sizes.max())):
        factor = np.exp(-rate * sizes)
        share = (factor * copies)[owners]
        below = np.concatenate([[0.0], np.cumsum(tfs * share)])
        upto = np.concatenate([[0.0], np.cumsum(share)])
        # Entries up to this one count with their own tf, those after it with this one's.
        overlap = below[1:] - below[starts][group] + tfs * (upto[ends][group] - upto[1:])
        gained += 2.0 * weight * factor * np.bincount(owners, weights=overlap, minlength=len(sizes))
    return gained


def _bucket_gains(table: pa.Table) -> pa.Table:
    """All packed rows of a bucket of a product to one partial sum per text."""
    table = table.combine_chunks()

    def flat(name: str) -> pa.Array:
        return _flattened(table[name])

    counts = np.array([len(value) for value in table["keys"]])
    entries = np.array([len(value) for value in table["codes"]])
    owners = flat("owners").to_numpy() + np.repeat(np.cumsum(counts) - counts, entries)
    keys = flat("keys")
    gained = overlap_gains(
        flat("codes").to_numpy(), owners, flat("tfs").to_numpy(), flat("sizes").to_numpy(), flat("copies").to_numpy()
    )
    product = table["product_id"].combine_chunks().take(pa.array(np.zeros(len(keys), dtype=np.int64)))
    return pa.table({"product_id": product, "text_key": keys, "gain": gained})


def _flattened(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([chunk.flatten() for chunk in column.chunks])


def dice_sums(tiles: DataFrame) -> DataFrame:
    """Per text its summed Dice coefficient with all reviews of its product, itself and copies included."""
    packed = tiles.select("product_id", "keys", "copies", "texts").mapInArrow(_packed_bigrams, BIGRAM_SCHEMA)
    gains = packed.groupBy("product_id", "bucket").applyInArrow(
        _bucket_gains, "product_id string, text_key binary, gain double"
    )
    return gains.groupBy("product_id", "text_key").agg(F.sum("gain").alias("dice_sum"))


def similarity_sums(reviews: DataFrame) -> DataFrame:
    """``product_id, review_id, row_no, similarity_mean, compared_review_count`` as N6 and N9 give them, without pairs.

    A review that cannot be compared (short, blank, or alone) has no mean and count 0.
    """
    keyed = materialized(network_signal.with_canonical(reviews).drop("content"), "canonical")
    stats = materialized(network_signal.product_stats(network_signal.text_facts(keyed)), "stats")
    packed = network_signal.gram_tiles(network_signal.partly_combined(keyed), stats)
    short = network_signal.combined_texts(keyed.filter(F.length("canonical") < C.MIN_INFORMATIVE_CHARS))
    tiles = materialized(network_signal.weighted_tiles(packed, short, stats), "weighted-tiles")
    both = cosine_sums(tiles).join(dice_sums(tiles), ["product_id", "text_key"])
    # A text is as like itself and its copies as can be: 1 each, of which it is not compared with itself.
    total = C.COSINE_WEIGHT * F.col("cosine_sum") + C.DICE_WEIGHT * F.col("dice_sum") - 1.0
    summed = (
        both.join(stats.select("product_id", "informative"), "product_id")
        .where(F.col("informative") > 1)
        .select("product_id", "text_key", (F.col("informative") - 1).alias("compared"), total.alias("total"))
    )
    return keyed.join(summed, ["product_id", "text_key"], "left").select(
        "product_id",
        "review_id",
        "row_no",
        # Rounding alone can bring a sum of nothing below zero.
        F.when(F.col("total") < 0, 0.0).otherwise(F.col("total") / F.col("compared")).alias("similarity_mean"),
        F.coalesce("compared", F.lit(0)).alias("compared_review_count"),
    )
