"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. The Manhattan
distance of two vectors never exceeds the number of differing bits, so fingerprints within ``3`` bits lie within
``3`` on the grid, and one half of the vector (16 segments) lies within ``1``. Each half is a grid: every
fingerprint stands in the cell of its counts and looks into its own cell and those one step up, so each pair
within one step meets once from the lower side. Pairs that meet are verified on the fingerprints themselves
inside the join. Equal fingerprints are one row from the start.

Fingerprints that agree outside one aligned group of three bits differ in at most three: such families are first
linked to their smallest member (stars, not pairs), and the grid join returns only links between families.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other;
texts under three words take the whole word sequence as their shingle; a null doc_id counts as the largest;
repeated rows share a fingerprint; an empty table gives an empty result; other columns are ignored by
``near_groups`` and returned unchanged by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore.llm.components import components
from trustscore.session import materialized

LARGEST = (1 << 63) - 1
DISTANCE = 3  # the halves and the families below rest on it
SHINGLE = 3
SEED = 42
_BLOCK = 65_536
_FAMILIES = [7 << bit & ((1 << 64) - 1) for bit in range(0, 64, 3)]


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 hashes of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    count, sums = len(starts), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, count, _BLOCK):
        pairs = zip(starts[low : low + _BLOCK].tolist(), ends[low : low + _BLOCK].tolist())
        hashes = np.array([digest(flat[a:b], SEED) for a, b in pairs], dtype=">u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > count).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bits(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(_signed(mask)))


def _families(points: DataFrame) -> DataFrame:
    """Links of each fingerprint to the smallest one that agrees with it outside one group of three bits."""
    keys = F.array(
        *[
            F.struct(F.lit(number).alias("group"), _bits(F.col("fp"), ~mask & ((1 << 64) - 1)).alias("rest"))
            for number, mask in enumerate(_FAMILIES)
        ]
    )
    spread = points.select("fp", F.explode(keys).alias("key")).select("fp", "key.group", "key.rest")
    # Families of one are dropped before any fingerprint is joined back.
    heads = (
        spread.groupBy("group", "rest")
        .agg(F.min("fp").alias("head"), F.max("fp").alias("tail"))
        .where("head < tail")
    )
    return spread.join(heads, ["group", "rest"]).where("fp > head").select(F.col("fp").alias("a"), F.col("head").alias("b"))


def _counts(half: Column) -> Column:
    """The sixteen two-bit counts of a 32-bit half at once: low bits plus high bits of each segment."""
    return half.bitwiseAND(F.lit(0x55555555)) + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def _cells(points: DataFrame) -> DataFrame:
    """Each point with its cell in either half of the grid: ``half, cell``."""
    halves = F.array(
        F.struct(F.lit(0).alias("half"), _counts(_bits(F.col("fp"), 0xFFFFFFFF)).alias("cell")),
        F.struct(F.lit(1).alias("half"), _counts(F.shiftrightunsigned("fp", 32)).alias("cell")),
    )
    return points.select(*points.columns, F.explode(halves).alias("h")).select(*points.columns, "h.half", "h.cell")


def _grid_links(points: DataFrame) -> DataFrame:
    """Links within the distance between points of different families (``fp``, ``family``)."""
    home = _cells(points)
    looks = home.select(
        F.col("fp").alias("other"),
        F.col("family").alias("other_family"),
        "half",
        F.explode(
            F.expr(
                "concat(array(cell), transform(filter(sequence(0, 15), s -> (shiftright(cell, 2 * s) & 3) < 2),"
                " s -> cell + shiftleft(1L, 2 * s)))"
            )
        ).alias("cell"),
    )
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    met = home.join(
        looks,
        (home["half"] == looks["half"])
        & (home["cell"] == looks["cell"])
        & (F.col("family") != F.col("other_family"))
        & (far <= DISTANCE),
    )
    return met.select(F.least("family", "other_family").alias("a"), F.greatest("family", "other_family").alias("b")).distinct()


def linked(fingerprints: DataFrame) -> DataFrame:
    """``fp, root`` for every distinct fingerprint: the smallest fingerprint it is linked to, itself included."""
    points = materialized(fingerprints.select("fp").distinct(), "fingerprints")
    family = components(_families(points)).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    grouped = materialized(
        points.join(family, "fp", "left").select("fp", F.coalesce("family", "fp").alias("family")), "families"
    )
    joined = components(_grid_links(grouped)).select(F.col("node").alias("family"), "root")
    return grouped.join(joined, "family", "left").select("fp", F.coalesce("root", "family").alias("root"))


def near_groups(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp`` (64 bits) and ``component_id``, the smallest doc_id reachable."""
    rows = materialized(documents.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash")
    roots = materialized(linked(rows), "roots")
    classes = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LARGEST))).alias("d"))
    least = classes.join(roots, "fp").groupBy("root").agg(F.min("d").alias("component_id"))
    by_print = roots.join(least, "root").select("fp", F.nullif("component_id", F.lit(LARGEST)).alias("component_id"))
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest doc_id, with all its columns."""
    names = documents.columns
    place = {name: f"c{i}" for i, name in enumerate(names)}
    held = materialized(
        documents.toDF(*place.values()).withColumn("_row", F.monotonically_increasing_id()), "numbered"
    )
    texts = held.select(F.col("_row").alias("doc_id"), F.col(place["text"]).alias("text"))
    prints = materialized(texts.mapInArrow(_fingerprints, "doc_id long, fp long"), "simhash").withColumnRenamed("doc_id", "_row")
    ids = held.select("_row", F.coalesce(place["doc_id"], F.lit(LARGEST)).alias("d"))
    first = F.min(F.struct("d", "_row")).alias("first")
    # Fingerprints first: copies of one text are one row before they meet their group.
    classes = prints.join(ids, "_row").groupBy("fp").agg(first)
    stays = classes.join(linked(prints), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first._row")
    return held.join(stays, "_row", "left_semi").select(*place.values()).toDF(*names)
