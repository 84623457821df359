"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted words by its weight; a source that would pass ``epochs`` times its own
words is clamped there and its excess is shared by the others in proportion, again and again until none is above.
Each round is one aggregation over the small table of sources and brings two numbers to the driver.

A source then takes every document as often as its whole number of epochs, and for the fraction that is left the
documents of a seeded order up to the target: the one document at the cut gives only its first words, so the words
taken meet the target to the word. Running sums are taken per bucket of the seeded order and shifted by bucket
offsets, so no source is sorted in one task.

Defined cases: null and empty texts have size 0 and are taken zero words; a null source is a source of its own,
last in order; a null doc_id has its own place in the seeded order; repeated rows are documents each, ties in the
order are cut in any order with the same counts; sources without words have target 0; an empty table gives an empty
result. ``mixed`` returns the columns it was given, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustscore.session import materialized

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 1_024
HEX_DIGITS = 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, seed: str) -> Column:
    """Place of a document in the seeded order, below 16**15."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by the code points of ``source``, null last, without sorting all sources in one task."""
    held = materialized(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_inside"),
        ),
        "sources",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    offsets = held.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return held.join(offsets, "_part").withColumn("rank", F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Add ``target`` to a table with ``source_size`` and ``weight``."""
    cap = F.col("source_size") * F.lit(float(epochs))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, count = None, -1
    while True:
        # weight * words > cap * weights says "above the cap" without a division.
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) > cap * F.lit(level[1])
        clamped, held, weights = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight").cast("double")))
        ).first()
        if clamped == count or not weights:
            target = cap if not weights else F.when(over, cap).otherwise(F.col("weight") * F.lit(level[0]) / F.lit(level[1]))
            return sources.withColumn("target", target)
        count, level = clamped, (share * total - float(held or 0), float(weights))


def _takes(rows: DataFrame, weights: tuple[int, ...], share: float, epochs: float, seed: str) -> DataFrame:
    """``taken`` words for rows of ``_row, doc_id, source, size``."""
    sized = materialized(rows.withColumn("h", _place(F.col("doc_id"), seed)), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked = ranked_sources(sources)
    cycle = F.array(*[F.lit(weight) for weight in weights])
    weighted = ranked.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int")))
    targets = materialized(water_fill(weighted, share, epochs), "targets")
    largest = targets.agg(F.max("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, largest) / BUCKET_ROWS)))
    bucketed = sized.withColumn("bucket", F.shiftright("h", 4 * HEX_DIGITS - bits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    known = (
        buckets.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "bucket", "offset", "source_size", "target", whole.alias("whole"))
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    inside = Window.partitionBy("d.source", "d.bucket").orderBy("h", "doc_id", "size", "_row")
    earlier = F.col("offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        bucketed.alias("d")
        .join(known.alias("k"), F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.bucket") == F.col("k.bucket")))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - earlier)))
        .select(
            "_row",
            "doc_id",
            "size",
            "source_size",
            "target",
            "whole",
            "extra",
            (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        )
    )


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """How much of every document the mix takes: ``doc_id, size, source_size, target, taken``.

    Sources by code point take the ``weights`` in turn; together they get ``share`` times all words, and none more
    than ``epochs`` times its own.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    takes = _takes(rows.withColumn("_row", F.monotonically_increasing_id()), weights, share, epochs, seed)
    return takes.select("doc_id", "size", "source_size", "target", "taken")


def mixed(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: str = "mix-1",
) -> DataFrame:
    """The mix itself: the rows of ``documents`` as often as they are taken, a part of a document as its first words."""
    names = documents.columns
    place = {name: f"c{i}" for i, name in enumerate(names)}
    held = materialized(
        documents.toDF(*place.values()).withColumn("_row", F.monotonically_increasing_id()), "numbered"
    )
    rows = held.select(
        "_row",
        F.col(place["doc_id"]).alias("doc_id"),
        F.col(place["source"]).alias("source"),
        word_count(F.col(place["text"])).alias("size"),
    )
    takes = _takes(rows, weights, share, epochs, seed).where("taken > 0").select("_row", "size", "whole", "extra")
    text = F.col(place["text"])
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("extra").cast("int")), " ")
    copies = F.concat(
        F.array_repeat(F.lit(False), F.col("whole").cast("int") + F.when(F.col("extra") == F.col("size"), 1).otherwise(0)),
        F.when(F.col("extra").between(1, F.col("size") - 1), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    return (
        held.join(takes, "_row")
        .withColumn("cut", F.explode(copies))
        .withColumn(place["text"], F.when(F.col("cut"), part).otherwise(text))
        .select(*place.values())
        .toDF(*names)
    )
