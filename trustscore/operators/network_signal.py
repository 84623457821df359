"""Network signal: how much a review resembles the other reviews of its product.

Every pair of informative reviews of a product counts, so the work is quadratic per product by
definition. The plan keeps it bounded per task and never materialises pairs:

1. equal canonical texts collapse to one row with a multiplicity, so a flood of copies costs one row;
2. gram counts, document frequencies and weights are ordinary aggregations and one equi-join;
3. the texts of a product are shuffled once, to tiles of bounded size packed as one row each; the idf of their grams
   is brought to where they are, and only the weighted tiles are written. Every
   unordered pair of tiles is an independent block, computed strip by strip from the grams that texts share; it
   returns one partial evidence row per text (count, sum, three largest), never pairs. The tiles meet as a
   cartesian product of the written files: tasks read them where they are, so no tile is copied to disk for its
   pairs, however many there are. A product that fits one tile, short texts included, needs no tiles: its texts
   meet in one row, which is weighted and compared at once, so that many small products cost what they hold;
4. partial evidence is merged per text and joined back to the reviews.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import numbers, text
from trustscore.functions.grams import gram_counter, gram_holders, numbered_grams, slices
from trustscore.operators.reasons import no_reasons, reason, reasons
from trustscore.session import materialized

TILE_CHARACTERS = 1_500_000  # canonical characters per tile; about three gram entries each
TILE_TEXTS = 4_000  # texts per tile
USER_TILE_CHARACTERS = 400_000  # characters per tile of whole contents for a user function
FILE_TILES = 8  # tiles per file: a task holds the tiles of two files
TILES_PER_BUCKET = 8
SENT_KEYS = 500_000  # texts that a task remembers to have sent
STRIP_CELLS = 2_000_000  # cells of a block held at once, and products expanded at once
DENSE_RATIO = 150  # a product by postings costs about as much as so many dense multiplications

SimilarityFunction = Callable[[pd.Series, pd.Series], pd.Series]


# --- N1..N3: grams, document frequency, weights ------------------------------------------------


def text_key(column: Column) -> Column:
    """128 bits of SHA-256: groups long texts by a short fixed-width key."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def with_canonical(reviews: DataFrame) -> DataFrame:
    """Add the comparison form of the content and its key."""
    return reviews.withColumn("canonical", text.canonical_text("content")).withColumn(
        "text_key", text_key(F.col("canonical"))
    )


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into the configured number of partitions, exempt from coalescing.

    Rows here are few bytes and much work (a text yields thousands of grams, a tile pair a whole block),
    so partitions sized by bytes would leave most cores idle.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys)


def combined_texts(reviews: DataFrame) -> DataFrame:
    """One row per (product, canonical text) with its number of copies, as the aggregation leaves them."""
    keyed = reviews if "text_key" in reviews.columns else with_canonical(reviews)
    return (
        keyed
        .groupBy("product_id", "text_key")
        .agg(F.any_value("canonical").alias("canonical"), F.count("*").alias("copies"))
        .withColumn("length", F.length("canonical"))
    )


def distinct_texts(reviews: DataFrame) -> DataFrame:
    """One row per (product, canonical text) with its number of copies.

    The aggregation combines copies before its shuffle; only then are the distinct texts spread.
    """
    return spread(combined_texts(reviews), "product_id", "text_key")


def _first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task combined per batch; a text that an earlier batch has sent goes without its characters."""
    sent: set[tuple] = set()
    for batch in batches:
        places: dict[tuple, int] = {}
        copies: dict[tuple, int] = {}
        for place, key in enumerate(zip(batch.column("product_id").to_pylist(), batch.column("text_key").to_pylist())):
            places.setdefault(key, place)
            copies[key] = copies.get(key, 0) + 1
        rows = batch.take(pa.array(list(places.values()), type=pa.int64()))
        known = pa.array([key in sent for key in places], type=pa.bool_())
        canonical = pc.if_else(known, pa.scalar(None, pa.string()), rows.column("canonical"))
        if len(sent) > SENT_KEYS:
            sent.clear()
        sent.update(places)
        arrays = [rows.column("product_id"), rows.column("text_key"), canonical, pa.array(list(copies.values()), type=pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, rows.column("length")], names=["product_id", "text_key", "canonical", "copies", "length"])


def partly_combined(keyed: DataFrame) -> DataFrame:
    """``combined_texts`` before any shuffle: a text may have several rows, at least one of them with its characters.

    ``gram_tiles`` combines them where it brings the texts together, so that texts are shuffled once and not twice.
    """
    return keyed.select("product_id", "text_key", "canonical", F.length("canonical").alias("length")).mapInArrow(
        _first_copies, "product_id string, text_key binary, canonical string, copies bigint, length int"
    )


def text_facts(keyed: DataFrame) -> DataFrame:
    """``distinct_texts`` without the texts: what statistics and joins need is never shuffled with them."""
    return (
        keyed.withColumn("length", F.length("canonical"))
        .groupBy("product_id", "text_key")
        .agg(F.any_value("length").alias("length"), F.count("*").alias("copies"))
    )


def gram_counts(texts: DataFrame, keep: tuple[str, ...] = ("product_id", "text_key", "copies", "length")) -> DataFrame:
    """Term frequency of every character gram of every distinct text, with the columns asked for.

    A text is one row, so its counts are complete inside one task and need no shuffle.
    """
    kinds = {"product_id": "string", "text_key": "binary", "copies": "bigint", "length": "int"}
    schema = ", ".join([*(f"{name} {kinds[name]}" for name in keep), "term string, tf int"])
    return texts.select(*keep, "canonical").mapInArrow(gram_counter("canonical", C.NGRAM_SIZES, keep), schema)


def gram_copies(texts: DataFrame) -> DataFrame:
    """N1 without the texts: the ``copies`` that hold a gram, added up within a slice of a product before any row is made."""
    return texts.select("product_id", "copies", "canonical").mapInArrow(
        gram_holders("canonical", C.NGRAM_SIZES), "product_id string, term string, copies bigint"
    )


def product_stats(
    texts: DataFrame, tile_characters: int = TILE_CHARACTERS, least: int = C.MIN_INFORMATIVE_CHARS
) -> DataFrame:
    """Per product: reviews with at least one gram, informative reviews, and the tiles (``load``: not rounded) for texts of ``least``.

    ``share`` is the load of all texts with a gram: up to 1 they fit one tile.
    """
    informative, tiled = F.col("length") >= C.MIN_INFORMATIVE_CHARS, F.col("length") >= least

    def load_of(held: Column) -> Column:
        characters = F.sum(F.when(held, F.col("length")).otherwise(0)) / F.lit(float(tile_characters))
        return F.greatest(characters, F.count_if(held) / F.lit(float(TILE_TEXTS)))

    load = load_of(tiled)
    return texts.groupBy("product_id").agg(
        F.sum("copies").alias("reviews"),
        F.sum(F.when(F.col("length") >= min(C.NGRAM_SIZES), F.col("copies")).otherwise(0)).alias("with_grams"),
        F.sum(F.when(informative, F.col("copies")).otherwise(0)).alias("informative"),
        load.alias("load"),
        F.greatest(F.lit(1), F.ceil(load)).cast("int").alias("tiles"),
        load_of(F.col("length") >= min(C.NGRAM_SIZES)).alias("share"),
    )


def smoothed_idf(with_grams: Column, frequency: Column) -> Column:
    return 1.0 + F.log((1.0 + with_grams) / (1.0 + frequency))


def gram_idf(grams: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency over reviews (copies included) and smoothed inverse document frequency."""
    return (
        grams.groupBy("product_id", "term")
        .agg(F.sum("copies").alias("df"))
        .join(stats.select("product_id", "with_grams"), "product_id")
        .withColumn("idf", smoothed_idf(F.col("with_grams"), F.col("df")))
    )


# --- tiles --------------------------------------------------------------------------------------

def _places(terms: pa.Array) -> np.ndarray:
    """32 bits of every gram of up to four characters that decide its bucket."""
    points = np.array(terms.to_pylist(), dtype="<U4").view("<u4").reshape(-1, 4).astype(np.uint64)
    mixed = np.zeros(len(points), dtype=np.uint64)
    for column in points.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(32)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count) of every gram of every text by row, and the grams by code; alike for the same texts.

    Codes follow the ``_places`` of the grams, so that the grams of a bucket have neighbouring codes.
    """
    lengths = np.fromiter((len(value) for value in texts), dtype=np.int64, count=len(texts))
    rows, numbers, grams, counts, spelled = [], [], [], [], 0
    for start, stop in slices(lengths):
        found_rows, found_numbers, found_counts, found_grams = numbered_grams(texts[start:stop], C.NGRAM_SIZES)
        rows.append(found_rows + start)
        numbers.append(found_numbers + spelled)
        grams.append(found_grams)
        counts.append(found_counts)
        spelled += len(found_grams)
    rows = np.concatenate(rows)
    encoded = pa.concat_arrays(grams).dictionary_encode()
    terms = encoded.dictionary
    by_place = np.argsort(_places(terms), kind="stable")
    code_of = np.empty(len(terms), dtype=np.int64)
    code_of[by_place] = np.arange(len(terms))
    order = np.argsort(rows, kind="stable")
    codes = code_of[encoded.indices.to_numpy(zero_copy_only=False)][np.concatenate(numbers)[order]]
    return rows[order].astype(np.int32), codes.astype(np.int32), np.concatenate(counts)[order].astype(np.int32), terms.take(pa.array(by_place))


VOCABULARY_SCHEMA = "product_id string, tile int, bucket int, terms string, df array<bigint>"


def _bucket_rows(product: pa.Array, tile: pa.Array, buckets: int, terms: pa.Array, held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket of a vocabulary in the order of its places: the grams, joined by blanks, and their counts."""
    bounds = np.searchsorted(_places(terms) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), terms)
    index = pa.array(np.zeros(buckets, dtype=np.int64))
    arrays = [product.take(index), tile.take(index), pa.array(np.arange(buckets, dtype=np.int32))]
    arrays += [pc.binary_join(lists, " "), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(held))]
    yield pa.RecordBatch.from_arrays(arrays, names=["product_id", "tile", "bucket", "terms", "df"])


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles to their grams and the reviews of the tile that hold each, one row per bucket."""
    for batch in batches:
        for row in range(batch.num_rows):
            rows, codes, _, terms = _counted(batch.column("texts")[row].as_py())
            copies = batch.column("copies")[row].values.to_numpy()
            held = np.bincount(codes, weights=copies[rows], minlength=len(terms)).astype(np.int64)
            buckets = batch.column("buckets")[row].as_py()
            yield from _bucket_rows(batch.column("product_id").slice(row, 1), batch.column("tile").slice(row, 1), buckets, terms, held)


def _summed(table: pa.Table) -> pa.Table:
    """All rows of a bucket of a product: the counts of every gram summed over the tiles, for each tile that holds it."""
    table = table.combine_chunks()
    df = pa.concat_arrays([chunk.flatten() for chunk in table["df"].chunks])
    sizes = np.array([len(value) for value in table["df"]], dtype=np.int64)
    # An empty bucket joins to an empty string, which would split to one empty gram.
    filled = table["terms"].filter(pa.array(sizes > 0))
    terms = pa.concat_arrays([pc.split_pattern(chunk, " ").flatten() for chunk in filled.chunks] or [pa.array([], pa.string())])
    codes = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    total = np.zeros(len(terms), dtype=np.int64)
    np.add.at(total, codes, df.to_numpy())
    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    summed = pa.ListArray.from_arrays(bounds, pa.array(total[codes]))
    rows = pa.table({"product_id": table["product_id"], "tile": table["tile"], "bucket": table["bucket"], "df": summed})
    return rows.filter(pc.is_valid(rows["tile"]))


def tile_of(key: Column, tiles: Column) -> Column:
    return F.pmod(F.xxhash64(key), tiles.cast("bigint")).cast("int")


def buckets_of(tiles: Column) -> Column:
    """Buckets of a product's grams: one task sums a bucket of all its tiles, about TILES_PER_BUCKET vocabularies."""
    return F.greatest(F.lit(8), F.ceil(tiles / F.lit(float(TILES_PER_BUCKET)))).cast("int")


def gram_tiles(
    texts: DataFrame, stats: DataFrame, least: int = C.MIN_INFORMATIVE_CHARS, file_tiles: int = 1
) -> DataFrame:
    """Texts of ``least`` characters (informative ones) spread over the tiles of their product, one packed row per tile.

    ``wanted`` marks the texts whose evidence is asked for; without that column it is all of them. Asked texts stand in
    tiles of their own, numbered from -1 down, so that few of them make few and small tiles. ``file_tiles`` neighbours
    (``near``) share a partition. Have ``stats`` written before: Spark then knows how small they are and does not shuffle
    the texts to meet them. The texts of a tile are in the order of their keys, whenever they are read.
    """
    load = stats.agg(F.sum("load")).first()[0] or 0.0  # many small products share a partition
    spark = texts.sparkSession
    # Few bytes, much work: partitions sized by bytes would leave most cores idle.
    least_partitions = spark.sparkContext.defaultParallelism if file_tiles > 1 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least_partitions, math.ceil(load / FILE_TILES))
    wanted = F.col("wanted") if "wanted" in texts.columns else F.lit(True)
    tile = tile_of(F.col("text_key"), F.col("tiles"))
    if "wanted" in texts.columns:
        tile = F.when(F.col("wanted"), -1 - tile_of(F.col("text_key"), F.col("asked_tiles"))).otherwise(tile)
    group = ("product_id", "near", "tile", "with_grams", "buckets")
    return (
        texts.filter(F.col("length") >= least)
        .join(stats, "product_id")
        .withColumn("tile", tile)
        .withColumn("near", F.floor(F.col("tile") / F.lit(file_tiles)).cast("int"))
        .withColumn("buckets", buckets_of(F.col("tiles")))
        .select(*group, "text_key", "canonical", "copies", wanted.alias("wanted"))
        .repartition(partitions, "product_id", "near")
        .groupBy(*group, "text_key")
        .agg(
            F.sum("copies").alias("copies"), F.any_value("wanted").alias("wanted"),
            F.any_value("canonical", ignoreNulls=True).alias("canonical"),
        )
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("text_key", "copies", "wanted", "canonical"))).alias("rows"))
        .select(
            *group, F.col("rows.text_key").alias("keys"), F.col("rows.copies").alias("copies"),
            F.col("rows.wanted").alias("wanted"), F.col("rows.canonical").alias("texts"),
        )
    )


def _short_vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of short texts (``product_id, buckets, term, df``) packed per bucket like those of a tile, without a tile."""
    for batch in batches:
        products = batch.column("product_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        places = _places(batch.column("term"))
        for number in np.unique(products):
            inside = np.flatnonzero(products == number)
            inside = inside[np.argsort(places[inside], kind="stable")]
            row = int(inside[0])
            terms, held = batch.column("term").take(pa.array(inside)), batch.column("df").to_numpy()[inside]
            buckets = batch.column("buckets")[row].as_py()
            yield from _bucket_rows(batch.column("product_id").slice(row, 1), pa.nulls(1, pa.int32()), buckets, terms, held)


def short_vocabularies(texts: DataFrame, sized: DataFrame) -> DataFrame:
    """Document frequencies of texts too short to be compared: they shift the idf and nothing else."""
    counted = (
        gram_counts(texts.filter(F.col("length") < C.MIN_INFORMATIVE_CHARS), ("product_id", "copies"))
        .groupBy("product_id", "term")
        .agg(F.sum("copies").alias("df"))
    )
    buckets = sized.groupBy("product_id").agg(F.max("buckets").alias("buckets"))
    return counted.join(buckets, "product_id").mapInArrow(_short_vocabularies, VOCABULARY_SCHEMA)


def summed_back(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Per tile, ``value`` of every gram of its vocabulary in order; it may sum (``sum_of_gram``).

    The shuffled rows are distinct grams per tile and not grams per text: once by gram, and once back by tile.
    """
    return (
        rows.withColumn(name, value)
        .filter(F.col("tile").isNotNull())
        .groupBy("product_id", "tile")
        .agg(F.sort_array(F.collect_list(F.struct("position", name))).getField(name).alias(name))
    )


def sum_of_gram(column: str) -> Column:
    """Sum over all rows of a gram in its product."""
    return F.sum(column).over(Window.partitionBy("product_id", "term"))


WEIGHTED_SCHEMA = (
    "product_id string, tile int, keys array<binary>, copies array<bigint>, wanted array<boolean>, texts array<string>, "
    "df array<bigint>, with_grams bigint"
)


def _with_counts(tiles: pa.Table, counts: pa.Table) -> pa.Table:
    """Neighbouring tiles and, per tile and bucket, the counts of their grams: every tile with all its counts."""
    counts = counts.sort_by([("tile", "ascending"), ("bucket", "ascending")]).combine_chunks()
    numbers = counts["tile"].to_numpy()
    found = []
    for number in tiles["tile"].to_pylist():
        inside = slice(*np.searchsorted(numbers, (number, number + 1)))
        found.append(np.concatenate([value.values.to_numpy() for value in counts["df"][inside]]))
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(values) for values in found])]).astype(np.int32))
    df = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(found)))
    names = ("product_id", "tile", "keys", "copies", "wanted", "texts")
    return pa.table({**{name: tiles[name] for name in names}, "df": df, "with_grams": tiles["with_grams"]})


def weighted_tiles(
    tiles: DataFrame, short: DataFrame | None = None, stats: DataFrame | None = None, file_tiles: int = 1
) -> DataFrame:
    """Attach to every tile the idf of its vocabulary, fitted over the whole product and its ``short`` texts.

    Distinct grams per tile move, packed per bucket and summed there; back come counts alone, in the order of the grams,
    to the partitions where the tiles are. Both readings of the tiles take all columns and so share one shuffle; where
    ``stats`` are given, the buckets of the short texts come from them and not from a third reading.
    """
    vocabulary = tiles.mapInArrow(_vocabularies, VOCABULARY_SCHEMA)
    if short is not None:
        buckets = tiles if stats is None else stats.withColumn("buckets", buckets_of(F.col("tiles")))
        vocabulary = vocabulary.unionByName(short_vocabularies(short, buckets))
    summed = spread(vocabulary, "product_id", "bucket").groupBy("product_id", "bucket").applyInArrow(
        _summed, "product_id string, tile int, bucket int, df array<bigint>"
    )
    near = F.floor(F.col("tile") / F.lit(file_tiles)).cast("int")
    idf = F.transform("df", lambda frequency: smoothed_idf(F.col("with_grams"), frequency))
    return (
        tiles.groupBy("product_id", "near")
        .cogroup(summed.withColumn("near", near).groupBy("product_id", "near"))
        .applyInArrow(_with_counts, WEIGHTED_SCHEMA)
        .withColumn("idf", idf)
        .drop("with_grams", "df")
    )


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted tiles to one row per gram of a text."""
    for batch in batches:
        for row in range(batch.num_rows):
            side = _Side(batch, row)
            for start in range(0, len(side.rows), STRIP_CELLS):
                part = slice(start, start + STRIP_CELLS)
                texts, codes = side.rows[part], side.codes[part]
                product = batch.column("product_id").take(pa.array(np.full(len(texts), row)))
                arrays = [product, side.keys.take(pa.array(texts)), side.terms.take(pa.array(codes))]
                arrays += [pa.array(side.tfs[part]), pa.array(side.weights[part])]
                yield pa.RecordBatch.from_arrays(arrays, names=["product_id", "text_key", "term", "tf", "weight"])


def tfidf(keyed: DataFrame) -> DataFrame:
    """N3 as a long table: weight of every gram after L2 normalisation of its text (``product_id, text_key``).

    Weights are taken tile by tile, where all grams of a text are at hand, and no gram of a text is ever shuffled.
    """
    least = min(C.NGRAM_SIZES)
    stats = materialized(product_stats(text_facts(keyed), least=least), "stats")
    tiles = gram_tiles(partly_combined(keyed), stats, least)
    schema = "product_id string, text_key binary, term string, tf int, weight double"
    return weighted_tiles(tiles).mapInArrow(_weights, schema)


def written_tiles(tiles: DataFrame, count: int, name: str) -> DataFrame:
    """``count`` packed tiles in files of about FILE_TILES, with enough files that pairs of them occupy all cores."""
    cores = tiles.sparkSession.sparkContext.defaultParallelism
    files = max(math.ceil(count / FILE_TILES), math.isqrt(cores) + 1)
    # Neighbours share a file: a task then has many pairs of one product and merges their evidence.
    near = F.floor(F.col("tile") / F.lit(FILE_TILES))
    return materialized(tiles.repartition(files, F.col("product_id"), near), name)


def tile_pairs(asking: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every unordered pair of tiles of a product with an asking one, once: columns ``a_...`` (asking) and ``b_...``.

    ``tiles`` are all tiles and ``asking`` those among them that hold an asked text. The pairs are read from the
    files of both sides and never shuffled: written for every pair, tiles would take the square of the input.
    """
    a = asking.select(*[F.col(name).alias(f"a_{name}") for name in asking.columns])
    b = tiles.select(*[F.col(name).alias(f"b_{name}") for name in tiles.columns])
    a_file, b_file = (F.floor(F.col(name) / F.lit(FILE_TILES)) for name in ("a_tile", "b_tile"))
    # Of the files of two asking tiles the one that comes first, or second where the sum is odd: each has half of its
    # pairs, and all pairs of two files are in one task, which returns one row for a text and not one for either order.
    apart = F.when(F.pmod(b_file - a_file, F.lit(2)) == 0, b_file > a_file).otherwise(b_file < a_file)
    mine = F.when(a_file == b_file, F.col("b_tile") >= F.col("a_tile")).otherwise(apart)
    pair = (F.col("a_product_id") == F.col("b_product_id")) & (~F.col("b_asking") | mine)
    return a.hint("shuffle_replicate_nl").join(b, pair)


# --- N4..N6: similarity blocks ------------------------------------------------------------------


class _Evidence:
    """Evidence of the texts on one side of a block, gathered strip by strip. NaN marks pairs that do not count."""

    def __init__(self, count: int):
        self.strong = np.zeros(count, dtype=np.int64)
        self.compared = np.zeros(count, dtype=np.int64)
        self.total = np.zeros(count)
        self.top = np.full((count, C.TOP_SIMILARITIES), -1.0)

    def add(self, rows: slice, similarity: np.ndarray, copies: np.ndarray) -> None:
        counted = ~np.isnan(similarity)
        filled = np.where(counted, similarity, 0.0)
        self.strong[rows] += ((filled >= C.STRONG_SIMILARITY) & counted) @ copies
        self.total[rows] += filled @ copies.astype(np.float64)
        self.compared[rows] += counted @ copies
        ranked = np.where(counted, similarity, -1.0)
        width = min(C.TOP_SIMILARITIES, similarity.shape[1])
        best = np.argpartition(-ranked, width - 1, axis=1)[:, :width]
        values = np.take_along_axis(ranked, best, axis=1)
        repeats = np.minimum(copies[best], C.TOP_SIMILARITIES)
        # A value counts as often as its text has copies: place k holds it if it repeats more than k times.
        places = np.arange(C.TOP_SIMILARITIES)
        spread = np.where(places < repeats[:, :, None], values[:, :, None], -1.0).reshape(len(values), -1)
        both = np.concatenate([self.top[rows], spread], axis=1)
        self.top[rows] = -np.sort(-both, axis=1)[:, : C.TOP_SIMILARITIES]

    def table(self, product: str, keys: pa.Array, chosen: np.ndarray) -> dict:
        return {
            "product_id": [product] * int(chosen.sum()),
            "text_key": keys.filter(pa.array(chosen)),
            "strong": self.strong[chosen],
            "total": self.total[chosen],
            "compared": self.compared[chosen],
            "top": [[value for value in row if value >= 0] for row in self.top[chosen].tolist()],
        }


class _Product:
    """Sparse (a x codes) times (b x codes) transposed, strip by strip.

    Codes that many texts on both sides hold are multiplied as dense columns, all others through postings: each entry
    on the left meets the entries of its code on the right.
    """

    def __init__(self, a: tuple, b: tuple, shape: tuple[int, int], width: int):
        (rows_a, codes_a, values_a), (rows_b, codes_b, values_b) = a, b
        self.width = shape[1]
        often_a, often_b = np.bincount(codes_a, minlength=width), np.bincount(codes_b, minlength=width)
        dense = often_a * often_b * DENSE_RATIO > shape[0] * shape[1]
        number = np.cumsum(dense) - 1
        self.columns = int(dense.sum())
        self.left = self._by_row(rows_a, codes_a, values_a, ~dense[codes_a])
        self.left_dense = self._by_row(rows_a, number[codes_a], values_a, dense[codes_a])
        self.right_dense = np.zeros((shape[1], self.columns))
        inside = dense[codes_b]
        self.right_dense[rows_b[inside], number[codes_b[inside]]] = values_b[inside]
        # Only the postings of codes that are no dense columns and that the left side has are ever read.
        read = ~(inside | (often_a[codes_b] == 0))
        rows_b, codes_b, values_b = rows_b[read], codes_b[read], values_b[read]
        order = np.argsort(codes_b, kind="stable")
        self.rows_b, self.values_b = rows_b[order], values_b[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes_b, minlength=width))])

    @staticmethod
    def _by_row(rows: np.ndarray, codes: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> tuple:
        """The chosen entries; those of a side come by row already."""
        return rows[chosen], codes[chosen], values[chosen]

    def strip(self, low: int, high: int) -> np.ndarray:
        cells = (high - low) * self.width
        rows, codes, values = (part[slice(*np.searchsorted(self.left_dense[0], (low, high)))] for part in self.left_dense)
        dense = np.zeros((high - low, self.columns))
        dense[rows - low, codes] = values
        result = (dense @ self.right_dense.T).ravel()
        rows, codes, values = (part[slice(*np.searchsorted(self.left[0], (low, high)))] for part in self.left)
        sizes = self.first[codes + 1] - self.first[codes]
        upto = np.cumsum(sizes)
        start = 0
        while start < len(rows):
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + STRIP_CELLS, side="right")))
            part = sizes[start:stop]
            spot = np.repeat(self.first[codes[start:stop]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            cell = np.repeat((rows[start:stop] - low) * self.width, part) + self.rows_b[spot]
            result += np.bincount(cell, np.repeat(values[start:stop], part) * self.values_b[spot], minlength=cells)
            start = stop
        return result.reshape(high - low, self.width)


class _Side:
    """Informative texts of one packed tile: the columns of a row that start with ``prefix``."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str = ""):
        def values(name: str) -> pa.Array:
            return batch.column(prefix + name)[row].values

        texts = values("texts").to_pylist()
        self.keys = values("keys")
        self.size = len(texts)
        self.copies = values("copies").to_numpy()
        self.wanted = values("wanted").to_numpy(zero_copy_only=False)
        self.bigrams = np.fromiter((len(value) - 1 for value in texts), dtype=np.int64, count=self.size)
        self.rows, self.codes, self.tfs, self.terms = _counted(texts)
        raw = self.tfs * values("idf").to_numpy()[self.codes]
        norms = np.sqrt(np.bincount(self.rows, weights=raw * raw, minlength=self.size))
        self.weights = raw / norms[self.rows]


class _WholeSide(_Side):
    """Informative texts of one packed product, weighted by the grams of all its texts."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        texts = batch.column("texts")[row].values.to_pylist()
        copies = batch.column("copies")[row].values.to_numpy()
        rows, codes, tfs, self.terms = _counted(texts)
        df = np.bincount(codes, weights=copies[rows], minlength=len(self.terms))
        idf = 1.0 + np.log((1.0 + batch.column("with_grams")[row].as_py()) / (1.0 + df))
        lengths = np.fromiter((len(value) for value in texts), dtype=np.int64, count=len(texts))
        informative = lengths >= C.MIN_INFORMATIVE_CHARS
        self.keys = batch.column("keys")[row].values.filter(pa.array(informative))
        self.size = int(informative.sum())
        self.copies, self.bigrams = copies[informative], lengths[informative] - 1
        self.wanted = np.ones(self.size, dtype=bool)
        inside = informative[rows]
        self.rows = (np.cumsum(informative, dtype=np.int32) - 1)[rows[inside]]
        self.codes, self.tfs = codes[inside], tfs[inside]
        raw = self.tfs * idf[self.codes]
        norms = np.sqrt(np.bincount(self.rows, weights=raw * raw, minlength=self.size))
        self.weights = raw / norms[self.rows]


class _Sides:
    """The sides used last in a task: it meets every tile of one file with every tile of another."""

    def __init__(self):
        self.held: dict[tuple, _Side] = {}

    def get(self, batch: pa.RecordBatch, row: int, prefix: str) -> _Side:
        key = (batch.column(f"{prefix}product_id")[row].as_py(), batch.column(f"{prefix}tile")[row].as_py())
        side = self.held.pop(key, None) or _Side(batch, row, prefix)
        while len(self.held) > FILE_TILES:
            del self.held[next(iter(self.held))]
        self.held[key] = side
        return side


def _common_codes(codes_a: np.ndarray, codes_b: np.ndarray, size: int, same: bool):
    """Renumber the codes that can meet in a pair; the rest get -1."""
    if same:
        usable = np.bincount(codes_a, minlength=size) > 1
    else:
        usable = (np.bincount(codes_a, minlength=size) > 0) & (np.bincount(codes_b, minlength=size) > 0)
    renumbered = np.where(usable, np.cumsum(usable) - 1, -1)
    return renumbered, int(usable.sum())


def _largest_count(codes: np.ndarray, tfs: np.ndarray, width: int) -> np.ndarray:
    largest = np.zeros(width, dtype=np.int64)
    np.maximum.at(largest, codes, tfs)
    return largest


def _unary(rows, codes, tfs, caps, starts):
    """Turn counts into unit features so that a dot product counts the multiset overlap."""
    kept = np.minimum(tfs, caps[codes]).astype(np.int64)
    first = np.repeat(np.cumsum(kept) - kept, kept)
    level = np.arange(int(kept.sum())) - first
    return np.repeat(rows, kept), np.repeat(starts[codes], kept) + level


class _Block:
    """Similarities of the texts of two tiles, strip by strip."""

    def __init__(self, a: _Side, b: _Side, same: bool, measure: str):
        self.measure, self.bigrams = measure, (a.bigrams, b.bigrams)
        if a is b:
            terms, codes_a, codes_b = a.terms, a.codes, b.codes
        else:
            dictionary = pa.concat_arrays([a.terms, b.terms]).dictionary_encode()
            joint = dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            terms, codes_a, codes_b = dictionary.dictionary, joint[: len(a.terms)][a.codes], joint[len(a.terms) :][b.codes]
        renumbered, width = _common_codes(codes_a, codes_b, len(terms), same)
        is_bigram = pc.utf8_length(terms).to_numpy(zero_copy_only=False) == 2
        codes_a, codes_b = renumbered[codes_a], renumbered[codes_b]
        keep_a, keep_b = codes_a >= 0, codes_b >= 0
        shape = (a.size, b.size)
        if measure in ("hybrid", "cosine"):
            self.cosine = _Product(
                (a.rows[keep_a], codes_a[keep_a], a.weights[keep_a]),
                (b.rows[keep_b], codes_b[keep_b], b.weights[keep_b]),
                shape,
                width,
            )
        if measure in ("hybrid", "dice"):
            flags = np.zeros(width + 1, dtype=bool)
            flags[renumbered[renumbered >= 0]] = is_bigram[renumbered >= 0]
            keep_a &= flags[codes_a]
            keep_b &= flags[codes_b]
            rows_a, two_a, tfs_a = a.rows[keep_a], codes_a[keep_a], a.tfs[keep_a]
            rows_b, two_b, tfs_b = b.rows[keep_b], codes_b[keep_b], b.tfs[keep_b]
            caps = np.minimum(_largest_count(two_a, tfs_a, width), _largest_count(two_b, tfs_b, width))
            starts = np.cumsum(caps) - caps
            rows_a, unit_a = _unary(rows_a, two_a, tfs_a, caps, starts)
            rows_b, unit_b = _unary(rows_b, two_b, tfs_b, caps, starts)
            self.overlap = _Product(
                (rows_a, unit_a, np.ones(len(unit_a))), (rows_b, unit_b, np.ones(len(unit_b))), shape, int(caps.sum())
            )

    def strip(self, low: int, high: int) -> np.ndarray:
        cosine = dice = 0.0
        if self.measure != "dice":
            cosine = np.clip(self.cosine.strip(low, high), 0.0, 1.0)
        if self.measure != "cosine":
            bigrams_a, bigrams_b = self.bigrams
            dice = 2.0 * self.overlap.strip(low, high) / (bigrams_a[low:high, None] + bigrams_b[None, :])
        if self.measure == "cosine":
            return cosine
        if self.measure == "dice":
            return dice
        return C.COSINE_WEIGHT * cosine + C.DICE_WEIGHT * dice


EVIDENCE_SCHEMA = pa.schema(
    [
        ("product_id", pa.string()),
        ("text_key", pa.binary()),
        ("strong", pa.int64()),
        ("total", pa.float64()),
        ("compared", pa.int64()),
        ("top", pa.list_(pa.float64())),
    ]
)


def _block_worker(measure: str):
    """A ``mapInArrow`` function: pairs of tiles to partial evidence, one row per text of a task's tiles for all its pairs."""

    def block(sides: _Sides, held: dict, batch: pa.RecordBatch, row: int) -> None:
        product = batch.column("a_product_id")[row].as_py()
        tile_a, tile_b = batch.column("a_tile")[row].as_py(), batch.column("b_tile")[row].as_py()
        same = tile_a == tile_b
        a, b = sides.get(batch, row, "a_"), sides.get(batch, row, "b_")
        (left, *_), (right, *_) = (
            held.setdefault((product, tile), (_Evidence(side.size), side.keys, side.wanted)) for tile, side in ((tile_a, a), (tile_b, b))
        )
        pairs = _Block(a, b, same, measure)
        step = max(1, STRIP_CELLS // b.size)
        for low in range(0, a.size, step):
            high = min(a.size, low + step)
            asked = a.wanted[low:high].any()
            if not asked and (same or not b.wanted.any()):
                continue
            similarity = pairs.strip(low, high)
            if same:
                similarity[np.arange(high - low), np.arange(low, high)] = np.nan
            elif b.wanted.any():
                right.add(slice(None), similarity.T, a.copies[low:high])
            if asked:
                left.add(slice(low, high), similarity, b.copies)

    def tables(held: dict) -> Iterator[pa.RecordBatch]:
        for (product, _), (evidence, keys, wanted) in held.items():
            yield pa.RecordBatch.from_pydict(evidence.table(product, keys, wanted), schema=EVIDENCE_SCHEMA)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, held = _Sides(), {}
        for batch in batches:
            for row in range(batch.num_rows):
                if len(held) > 4 * FILE_TILES:
                    yield from tables(held)
                    held = {}
                block(sides, held, batch, row)
        yield from tables(held)

    return blocks


BLOCK_SCHEMA = (
    "product_id string, text_key binary, strong bigint, total double, compared bigint, top array<double>"
)


def _whole_worker(measure: str):
    """A ``mapInArrow`` function: packed products to the evidence of their informative texts."""

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                side = _WholeSide(batch, row)
                if not side.size:
                    continue
                evidence, pairs = _Evidence(side.size), _Block(side, side, True, measure)
                step = max(1, STRIP_CELLS // side.size)
                for low in range(0, side.size, step):
                    high = min(side.size, low + step)
                    similarity = pairs.strip(low, high)
                    similarity[np.arange(high - low), np.arange(low, high)] = np.nan
                    evidence.add(slice(low, high), similarity, side.copies)
                found = evidence.table(batch.column("product_id")[row].as_py(), side.keys, side.wanted)
                yield pa.RecordBatch.from_pydict(found, schema=EVIDENCE_SCHEMA)

    return worker


def whole_evidence(texts: DataFrame, stats: DataFrame, measure: str) -> DataFrame:
    """Evidence of the texts of products that fit one tile each: a row holds all texts of a product that have a gram."""
    load = stats.agg(F.sum("share")).first()[0] or 0.0
    partitions = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(load))
    group = ("product_id", "with_grams")
    return (
        texts.filter(F.col("length") >= min(C.NGRAM_SIZES))
        .join(stats.select(*group), "product_id")
        .select(*group, "text_key", "canonical", "copies")
        .repartition(partitions, "product_id")
        .groupBy(*group, "text_key")
        .agg(F.sum("copies").alias("copies"), F.any_value("canonical", ignoreNulls=True).alias("canonical"))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("text_key", "copies", "canonical"))).alias("rows"))
        .select(
            *group, F.col("rows.text_key").alias("keys"), F.col("rows.copies").alias("copies"), F.col("rows.canonical").alias("texts")
        )
        .mapInArrow(_whole_worker(measure), BLOCK_SCHEMA)
    )


def merge_evidence(partials: DataFrame) -> DataFrame:
    """Combine the partial rows of a text over all its tile pairs."""
    return partials.groupBy("product_id", "text_key").agg(
        F.sum("strong").alias("strong"),
        F.sum("total").alias("total"),
        F.sum("compared").alias("compared"),
        F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, C.TOP_SIMILARITIES).alias("top"),
    )


def _tiled_evidence(keyed: DataFrame, texts: DataFrame, stats: DataFrame, measure: str, chosen: bool) -> DataFrame:
    """Evidence of the texts of the products in ``stats``, tile by tile; of the wanted ones where some are ``chosen``."""
    packed = gram_tiles(texts, stats, file_tiles=FILE_TILES)
    few = keyed.filter(F.length("canonical") < C.MIN_INFORMATIVE_CHARS)
    weighted = weighted_tiles(packed, combined_texts(few), stats, FILE_TILES).withColumn("asking", F.array_contains("wanted", True))
    # Neighbours share a file: a task then has many pairs of one product and merges their evidence.
    tiles = asking = materialized(weighted, "weighted-tiles")
    if chosen:
        asking = tiles.filter("asking")
        asking = written_tiles(asking, asking.count(), "asking-tiles")
    return merge_evidence(tile_pairs(asking, tiles).mapInArrow(_block_worker(measure), BLOCK_SCHEMA))


def text_evidence(
    reviews: DataFrame, measure: str = "hybrid", tile_characters: int = TILE_CHARACTERS, wanted: DataFrame | None = None
) -> DataFrame:
    """N4 (cosine), N5 (Dice) or N6 (hybrid): evidence per distinct text against all other reviews.

    Copies of the same canonical text are pairs with similarity exactly 1. With ``wanted`` (product_id, text_key)
    only those texts get evidence, and only the blocks that hold one of them are computed.
    """
    keyed = reviews if "text_key" in reviews.columns else with_canonical(reviews)
    texts, facts = partly_combined(keyed), text_facts(keyed)
    if wanted is not None:
        marked = wanted.select("product_id", "text_key").distinct().withColumn("wanted", F.lit(True))
        texts, facts = (
            rows.join(marked, ["product_id", "text_key"], "left").fillna(False, ["wanted"]) for rows in (texts, facts)
        )
    stats = product_stats(facts, tile_characters)
    if wanted is not None:
        asked = product_stats(facts.filter("wanted"), tile_characters)
        stats = stats.join(asked.select("product_id", F.col("tiles").alias("asked_tiles")), "product_id", "left")
        facts = facts.filter("wanted")
    stats = materialized(stats, "stats")
    # Chosen texts stand in tiles of their own, so their products are tiled whatever their size.
    whole = F.lit(False) if wanted is not None else F.col("share") <= 1
    evidence = []
    if not stats.filter(whole).isEmpty():
        evidence.append(whole_evidence(texts, stats.filter(whole), measure))
    if not stats.filter(~whole).isEmpty() or not evidence:
        evidence.append(_tiled_evidence(keyed, texts, stats.filter(~whole), measure, wanted is not None))
    twins = F.col("copies") - 1
    ones = F.array_repeat(F.lit(1.0), F.least(twins, F.lit(C.TOP_SIMILARITIES)).cast("int"))
    return (
        facts.filter(F.col("length") >= C.MIN_INFORMATIVE_CHARS)
        .select("product_id", "text_key", "copies")
        .join(reduce(DataFrame.unionByName, evidence), ["product_id", "text_key"], "left")
        .select(
            "product_id",
            "text_key",
            (F.coalesce("strong", F.lit(0)) + twins).alias("strong"),
            (F.coalesce("total", F.lit(0.0)) + twins).alias("total"),
            (F.coalesce("compared", F.lit(0)) + twins).alias("compared"),
            F.slice(
                F.concat(ones, F.coalesce("top", F.array().cast("array<double>"))), 1, C.TOP_SIMILARITIES
            ).alias("top"),
        )
    )


# --- N9..N12: features, score, reasons ----------------------------------------------------------


def with_features(rows: DataFrame) -> DataFrame:
    """Public features from (strong, total, compared, top); all null when nothing was compared."""
    some = F.coalesce(F.col("compared"), F.lit(0)) > 0
    top_sum = F.aggregate("top", F.lit(0.0), lambda total, value: total + value)
    return rows.select(
        "*",
        F.when(some, F.col("strong")).alias("similar_review_count"),
        F.when(some, F.array_max("top")).alias("similarity_max"),
        F.when(some, F.col("total") / F.col("compared")).alias("similarity_mean"),
        F.when(some, top_sum / F.size("top")).alias("top3_mean_similarity"),
        F.coalesce("compared", F.lit(0)).alias("compared_review_count"),
    ).drop("strong", "total", "compared", "top")


def raw_network_score(similar: Column, largest: Column, top_mean: Column) -> Column:
    """N10 before rounding: quadratic penalties for the closest reviews, saturating penalty for how many."""
    closest = numbers.above_floor(largest, C.SCORE_FLOOR_SIMILARITY)
    near = numbers.above_floor(top_mean, C.SCORE_FLOOR_SIMILARITY)
    score = 100.0 - 55.0 * closest * closest - 30.0 * near * near - 15.0 * numbers.saturation(similar)
    return numbers.clip(score, 0.0, 100.0)


def with_network_score(features: DataFrame) -> DataFrame:
    """Score to one decimal and the similarity reason; null score without features."""
    similar = F.col("similar_review_count")
    known = F.col("similarity_max").isNotNull()
    score = raw_network_score(similar, F.col("similarity_max"), F.col("top3_mean_similarity"))
    return features.withColumn("network_score", F.when(known, numbers.round_one(score))).withColumn(
        "network_reasons",
        F.coalesce(
            reasons(
                reason("SIMILAR_REVIEW_CLUSTER", similar >= C.CLUSTER_SIZE),
                reason("SIMILAR_REVIEW_PATTERN", (similar >= 1) & (similar < C.CLUSTER_SIZE)),
            ),
            no_reasons(),
        ),
    )


def network_signal(
    reviews: DataFrame, measure: str = "hybrid", tile_characters: int = TILE_CHARACTERS
) -> DataFrame:
    """N6 to N12 for whole products: one row per review, features null where nothing could be compared.

    A short review and a lone informative review have no evidence and get ``similarity_unavailable``.
    The canonical form is computed and written once, because grams, statistics and the final join all
    need it; the content itself is not carried into the result.
    """
    keyed = materialized(with_canonical(reviews).drop("content"), "canonical")
    joined = keyed.drop("canonical").join(
        text_evidence(keyed, measure, tile_characters), ["product_id", "text_key"], "left"
    )
    scored = with_network_score(with_features(joined.drop("text_key")))
    return scored.withColumn(
        "network_unavailable_reason", F.when(F.col("network_score").isNull(), F.lit("similarity_unavailable"))
    )


# --- N7, N8: other similarities -----------------------------------------------------------------


def _with_facts(reviews: DataFrame, key: str, keyed_text: Column) -> DataFrame:
    """Key and text facts of every review, computed once and written without the texts."""
    facts = reviews.withColumns(
        {
            key: text_key(keyed_text),
            "is_blank": text.is_blank("content"),
            "is_informative": text.is_informative(text.canonical_text("content")),
        }
    )
    return materialized(facts.drop("content"), "facts")


def _adapter_signal(facts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Join evidence to reviews and tell apart why a review has none."""
    shared = facts.groupBy("product_id").agg(F.count_if(~F.col("is_blank")).alias("non_blank"))
    own = F.when(F.col("is_blank"), 0).otherwise(1)
    joined = (
        facts.join(evidence, ["product_id", key], "left")
        .join(shared, "product_id", "left")
        .withColumn("candidates", F.coalesce("non_blank", F.lit(0)) - own)
    )
    for column in ("strong", "total", "compared", "top"):
        joined = joined.withColumn(column, F.when(F.col("is_informative"), F.col(column)))
    scored = with_network_score(with_features(joined))
    return scored.withColumn(
        "network_unavailable_reason",
        F.when(F.col("network_score").isNotNull(), None)
        .when(F.col("is_blank") | (F.col("candidates") < 1), "no_comparison_reviews")
        .when(~F.col("is_informative"), "insufficient_text_information")
        .otherwise("similarity_unavailable"),
    ).drop("is_blank", "is_informative", "non_blank", "candidates", key)


def exact_match_signal(reviews: DataFrame) -> DataFrame:
    """Similarity 1 for equal normalised texts and 0 otherwise.

    The evidence of a review follows from the size of its group alone, so this is two aggregations and
    no pairs. Informative texts are never blank, so no comparison is undefined.
    """
    facts = _with_facts(reviews, "match_key", text.normalize_text("content"))
    groups = (
        facts.filter("is_informative")
        .groupBy("product_id", "match_key")
        .agg(F.count("*").alias("same"))
    )
    totals = groups.groupBy("product_id").agg(F.sum("same").alias("informative"))
    twins, others = F.col("same") - 1, F.col("informative") - 1
    ones = F.least(twins, F.lit(C.TOP_SIMILARITIES))
    length = F.least(others, F.lit(C.TOP_SIMILARITIES))
    evidence = groups.join(totals, "product_id").select(
        "product_id",
        "match_key",
        twins.alias("strong"),
        twins.cast("double").alias("total"),
        others.alias("compared"),
        F.concat(
            F.array_repeat(F.lit(1.0), ones.cast("int")), F.array_repeat(F.lit(0.0), (length - ones).cast("int"))
        ).alias("top"),
    )
    return _adapter_signal(facts, evidence, "match_key")


def _user_block_worker(similarity: SimilarityFunction):
    def checked(left: list[str], right: list[str]) -> np.ndarray:
        values = similarity(pd.Series(left, dtype=object), pd.Series(right, dtype=object))
        values = pd.to_numeric(values, errors="raise").to_numpy(dtype=np.float64)
        known = values[~np.isnan(values)]
        if ((known < 0) | (known > 1)).any():
            raise ValueError("similarity function must return a value between 0 and 1")
        return values

    def directed(targets: pa.Table, candidates: pa.Table, product: str, same: bool) -> dict:
        contents = candidates["content"].to_pylist()
        keys = candidates["content_key"].to_pylist()
        copies = candidates["copies"].to_numpy()
        block = np.full((len(targets), len(contents)), np.nan)
        counts = np.tile(copies, (len(targets), 1))
        for row, (content, key) in enumerate(zip(targets["content"].to_pylist(), targets["content_key"].to_pylist())):
            block[row] = checked([content] * len(contents), contents)
            if same:
                counts[row, keys.index(key)] -= 1  # not compared with itself, only with its copies
        tops, strong, total, compared = [], [], [], []
        for values, weights in zip(block, counts):
            use = ~np.isnan(values) & (weights > 0)
            values, weights = values[use], weights[use]
            strong.append(int(weights[values >= C.STRONG_SIMILARITY].sum()))
            total.append(float(values @ weights))
            compared.append(int(weights.sum()))
            order = np.argsort(-values, kind="stable")[: C.TOP_SIMILARITIES]
            repeated = np.repeat(values[order], np.minimum(weights[order], C.TOP_SIMILARITIES))
            tops.append(repeated[: C.TOP_SIMILARITIES].tolist())
        return {
            "product_id": [product] * len(targets),
            "content_key": targets["content_key"].to_pylist(),
            "strong": strong, "total": total, "compared": compared, "top": tops,
        }

    def side(batch: pa.RecordBatch, row: int, prefix: str) -> pa.Table:
        names = ("content_key", "content", "copies")
        return pa.table({name: batch.column(f"{prefix}{name}")[row].values for name in names})

    def merged(old: dict | None, new: dict) -> dict:
        if old is None:
            return new
        for name in ("strong", "total", "compared"):
            new[name] = [x + y for x, y in zip(old[name], new[name])]
        new["top"] = [sorted(x + y, reverse=True)[: C.TOP_SIMILARITIES] for x, y in zip(old["top"], new["top"])]
        return new

    def tables(held: dict) -> Iterator[pa.RecordBatch]:
        for part in held.values():
            part["text_key"] = part.pop("content_key")
            yield pa.RecordBatch.from_pydict(part, schema=EVIDENCE_SCHEMA)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                if len(held) > 4 * FILE_TILES:
                    yield from tables(held)
                    held = {}
                product = batch.column("a_product_id")[row].as_py()
                tile_a, tile_b = batch.column("a_tile")[row].as_py(), batch.column("b_tile")[row].as_py()
                same = tile_a == tile_b
                a, b = side(batch, row, "a_"), side(batch, row, "b_")
                held[product, tile_a] = merged(held.get((product, tile_a)), directed(a, b, product, same))
                if not same:
                    held[product, tile_b] = merged(held.get((product, tile_b)), directed(b, a, product, False))
        yield from tables(held)

    return blocks


def user_similarity_signal(
    reviews: DataFrame, similarity: SimilarityFunction, tile_characters: int = USER_TILE_CHARACTERS
) -> DataFrame:
    """Evidence from a user's vectorised ``similarity(target_texts, candidate_texts)``.

    A null result skips the pair, a value outside 0..1 fails the job. Both directions are computed, so
    the function need not be symmetric; it must be deterministic, because equal contents are computed
    once. Tiles bound each task exactly as for the built-in similarity.
    """
    own_key = F.coalesce("content", F.lit(""))
    facts = _with_facts(reviews, "content_key", own_key)
    keyed = reviews.withColumn("content_key", text_key(own_key))
    contents = (
        keyed.filter(text.is_informative(text.canonical_text("content")))
        .groupBy("product_id", "content_key")
        .agg(F.any_value("content").alias("content"), F.count("*").alias("copies"))
    )
    tiles = contents.groupBy("product_id").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.length("content")) / F.lit(float(tile_characters)))).cast("int").alias("tiles")
    )
    placed = contents.join(tiles, "product_id").withColumn("tile", tile_of(F.col("content_key"), F.col("tiles")))
    packed = placed.groupBy("product_id", "tile").agg(
        *[F.collect_list(F.struct("content_key", "content", "copies")).alias("rows"), F.lit(True).alias("asking")]
    )
    columns = [F.col(f"rows.{name}").alias(name) for name in ("content_key", "content", "copies")]
    count = tiles.agg(F.sum("tiles")).first()[0] or 0
    held = written_tiles(packed.select("product_id", "tile", *columns, "asking"), count, "content-tiles")
    partials = tile_pairs(held, held).mapInArrow(_user_block_worker(similarity), BLOCK_SCHEMA)
    evidence = merge_evidence(partials).withColumnRenamed("text_key", "content_key")
    return _adapter_signal(facts, evidence, "content_key")


# --- N13: chosen targets ------------------------------------------------------------------------


def target_signal(reviews: DataFrame, targets: DataFrame) -> DataFrame:
    """Evidence for chosen (product_id, review_id) targets against their product's other reviews.

    The product is packed once as for the whole signal; only blocks that hold a target are computed, so the
    work is linear in the product. Products without a target are left out before any gram is made.
    """
    concerned = reviews.join(targets.select("product_id").distinct(), "product_id", "left_semi")
    reviews = materialized(with_canonical(concerned).drop("content"), "canonical")
    counts = reviews.groupBy("product_id").agg(F.count("*").alias("reviews"))
    chosen = reviews.join(targets.select("product_id", "review_id"), ["product_id", "review_id"], "left_semi").select(
        "product_id", "review_id", "text_key", "row_no"
    )
    joined = (
        chosen.join(text_evidence(reviews, wanted=chosen), ["product_id", "text_key"], "left")
        .join(counts, "product_id")
        .drop("text_key")
    )
    scored = with_network_score(with_features(joined))
    return scored.withColumn(
        "network_unavailable_reason",
        F.when(F.col("network_score").isNotNull(), None)
        .when(F.col("reviews") < 2, "no_comparison_reviews")
        .otherwise("similarity_unavailable"),
    ).drop("reviews")
