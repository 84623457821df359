"""Exact de-duplication through content-defined chunk recipes.

Each text is normalised (every run of ``[\\x20\\x09-\\x0D]`` becomes one space) and cut where a rolling hash of
the last 16 bytes is rare, so equal passages give equal chunks. A chunk is named by a 64-bit hash; the
names are verified against SHA-256 digests over the whole table, and names that stand for several contents
get a variant number, so equal identifiers always mean equal chunks. Two texts are equal exactly when their
ordered identifier lists are. Only names, digests and lists move between tasks, never texts, however long.

Defined cases: null text counts as empty (an empty list); a null doc_id counts as the largest; of rows that
share the smallest doc_id one stays; an empty table gives an empty result; other columns are ignored by
``exact_groups`` and returned unchanged by ``drop_exact_copies``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustscore.llm.words import SLICE_BYTES, list_array, mix
from trustscore.session import materialized

LARGEST = (1 << 63) - 1
CHUNK_BITS = 10  # chunks of about 1,024 bytes
LONGEST_CHUNK = 8_192
_REACH = 16
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with every run of white space turned into one space, at its ends too."""
    raw = (text or "").encode()
    if not raw:
        return raw
    words = raw.split()
    if not words:
        return b" "
    lead = b" " if raw[:1].isspace() else b""
    tail = b" " if raw[-1:].isspace() else b""
    return lead + b" ".join(words) + tail


def cut_points(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text. They depend on the text alone: a gap of zero bytes goes before each."""
    gap = bytes(_REACH)
    data = np.frombuffer(gap + gap.join(texts), dtype=np.uint8)
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8):
        wider = rolled.copy()
        wider[step:] += rolled[:-step] << np.uint64(step)
        rolled = wider
    rare = np.flatnonzero(rolled >> np.uint64(64 - CHUNK_BITS) == 0)
    ends, start = [], _REACH
    for text in texts:
        stop = start + len(text)
        low, high = np.searchsorted(rare, (start, stop))
        own, last = [], 0
        for cut in [*(rare[low:high] - start + 1).tolist(), len(text)]:
            while cut - last > LONGEST_CHUNK:
                last += LONGEST_CHUNK
                own.append(last)
            if cut > last:
                own.append(cut)
                last = cut
        ends.append(own)
        start = stop + _REACH
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: digest of the normalised text, chunk names and chunk digests of each row."""
    for batch in batches:
        column, start = batch.column("text"), 0
        while start < batch.num_rows:
            texts, held = [], 0
            while start + len(texts) < batch.num_rows and (not texts or held < SLICE_BYTES):
                texts.append(normalised(column[start + len(texts)].as_py()))
                held += len(texts[-1])
            names, digests, counts, whole = [], [], [], []
            for text, ends in zip(texts, cut_points(texts)):
                last = 0
                for end in ends:
                    piece = text[last:end]
                    names.append(xxhash.xxh64_intdigest(piece))
                    digests.append(hashlib.sha256(piece).digest())
                    last = end
                counts.append(len(ends))
                whole.append(hashlib.sha256(text).hexdigest())
            names = np.array(names, dtype=np.uint64).view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_row").slice(start, len(texts)),
                    batch.column("doc_id").slice(start, len(texts)),
                    pa.array(whole, pa.string()),
                    list_array(names, np.array(counts)),
                    pa.ListArray.from_arrays(offsets, pa.array(digests, pa.binary())),
                ],
                names=["_row", "doc_id", "text_sha256", "names", "digests"],
            )
            start += len(texts)


def _groups(numbered: DataFrame) -> DataFrame:
    """Every row of ``_row, doc_id, text`` with the row of its group that stays."""
    rows = materialized(
        numbered.select("_row", "doc_id", "text").mapInArrow(
            _recipes, "_row long, doc_id long, text_sha256 string, names array<long>, digests array<binary>"
        ),
        "recipes",
    )
    chunks = rows.select("_row", F.posexplode(F.arrays_zip("names", "digests")).alias("at", "chunk")).select(
        "_row", "at", F.col("chunk.names").alias("name"), F.col("chunk.digests").alias("digest")
    )
    # One digest per name is the rule, variant 1; only names with more digests are joined back.
    several = materialized(
        chunks.groupBy("name")
        .agg(F.sort_array(F.collect_set("digest")).alias("variants"))
        .where(F.size("variants") > 1),
        "variants",
    )
    variant = F.coalesce(F.expr("array_position(variants, digest)"), F.lit(1).cast("long")).alias("variant")
    entry = F.struct("at", "name", variant)
    lists = (
        chunks.join(several, "name", "left")
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(entry)).alias("recipe"))
        .select("_row", F.expr("transform(recipe, e -> struct(e.name, e.variant))").alias("recipe"))
    )
    empty = F.expr("cast(array() as array<struct<name: bigint, variant: bigint>>)")
    known = (
        rows.select("_row", "doc_id", "text_sha256")
        .join(lists, "_row", "left")
        .withColumn("recipe", F.coalesce("recipe", empty))
    )
    first = F.struct(F.coalesce("doc_id", F.lit(LARGEST)).alias("d"), "_row", "doc_id")
    groups = known.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    return known.join(groups, "recipe").select(
        "_row",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first._row")).alias("kept"),
        "text_sha256",
    )


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    numbered = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return _groups(numbered).drop("_row")


def drop_exact_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    names = documents.columns
    held = materialized(
        documents.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_row", F.monotonically_increasing_id()),
        "numbered",
    )
    place = {name: f"c{i}" for i, name in enumerate(names)}
    numbered = held.select("_row", F.col(place["doc_id"]).alias("doc_id"), F.col(place["text"]).alias("text"))
    stays = _groups(numbered).where("kept").select("_row")
    return held.join(stays, "_row", "left_semi").drop("_row").toDF(*names)
