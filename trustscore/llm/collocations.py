"""Phrases of two and three words whose words occur together more often than apart, per language.

Top-order marginalisation: only the longest windows are counted. Every word gives one row of itself and its two
lead columns, padded where its piece ends; counts of shorter phrases are sums over their continuations, so a
ROLLUP over prefixes replaces an explosion per phrase length. A task combines equal windows of a slice of text
before they move. Windows then meet by their first word, which makes the sums of its pairs final where they are
taken: pairs below the minimum count lose their second word there, and the ROLLUP carries only words and the pairs
that still matter. First words that a sample finds frequent are dealt over many tasks by their second word,
frequent pairs by their third; for them the ROLLUP adds the parts. The sample (``SAMPLE`` rows) decides on that
alone, never on a count.

A phrase is scored at its worst cut, in exact decimal arithmetic, dropped where a longer candidate holds it and
is nearly as frequent, and each language lists its best.

Defined cases: null and empty texts have no words; a null language is ``und`` and joins rows that say so; texts of
any length are sliced by rows and counted whole; equal scores and counts are ordered by phrase; repeated rows count
each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustscore.llm.words import slices, text_buffer
from trustscore.session import materialized

MIN_COUNT = 10
COVERED_PERCENT = 50
LISTED = 2_000
UNKNOWN = "und"
SAMPLE = 10_000  # rows read to find first words and pairs worth dealing over many tasks
HOT_SHARE = 4_000  # those begin more than one in this many of the sampled windows, so there are fewer of them
SALTS = 256
_BUCKETS = 64
# Few windows of a slice repeat, and a slice three times as long has only 5 % fewer rows, but its arrays add up.
_SLICE = 2_000_000
_SPACE = pa.scalar(" ", pa.large_string())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of consecutive texts, with the row and the piece of each (pieces of different rows may share a number)."""
    inside = ~_OUTSIDE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    del edge, begins, finishes
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))]
    )
    # Breaks before a word, looked up: counted at every byte they would take eight times the text.
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    return words, np.searchsorted(offsets, starts, side="right") - 1, piece


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(values)
    return codes.astype(np.int64), distinct


def _counted(words: pa.Array, row: np.ndarray, piece: np.ndarray, langs: pa.Array) -> pa.RecordBatch:
    """Distinct windows ``first SPACE second SPACE third`` (missing words empty) of each language and their counts."""
    coded = words.dictionary_encode()
    first = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    lang_coded = langs.dictionary_encode()
    lang = lang_coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    base = len(coded.dictionary) + 1

    def lead(step: int) -> np.ndarray:
        found = np.zeros(len(first), dtype=np.int64)
        same = (piece[step:] == piece[:-step]) & (row[step:] == row[:-step])
        found[:-step][same] = first[step:][same]
        return found

    heads, head_values = _numbered(lang * base + first)
    pairs, pair_values = _numbered(heads * base + lead(1))
    del heads, lang
    whole, whole_values = _numbered(pairs * base + lead(2))
    counts = np.bincount(whole, minlength=len(whole_values))
    del pairs, whole, first

    pair_of, third = np.divmod(whole_values, base)
    head_of, second = np.divmod(pair_values[pair_of], base)
    lang_of, start = np.divmod(head_values[head_of], base)
    spelled = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary])
    window = pc.binary_join_element_wise(*[spelled.take(pa.array(words)) for words in (start, second, third)], _SPACE)
    return pa.RecordBatch.from_arrays(
        [lang_coded.dictionary.take(pa.array(lang_of)).cast(pa.string()), window.cast(pa.string()), pa.array(counts, pa.int64())],
        names=["lang", "window", "n"],
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for start, stop in slices(offsets, _SLICE):
            part = offsets[start : stop + 1]
            words, row, piece = _words(data[part[0] : part[-1]], part - part[0])
            if len(words):
                counted = _counted(words, row, piece, batch.column("lang").slice(start, stop - start))
                del words, row, piece
                yield counted
                del counted
            # What a slice freed goes back before the next one: two workers share an executor with its heap.
            pa.default_memory_pool().release_unused()


def count_windows(documents: DataFrame) -> DataFrame:
    """``lang, window, n``: longest windows, combined within a slice of a task only."""
    rows = documents.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    return rows.mapInArrow(_windows, "lang string, window string, n long")


def _parts() -> tuple[Column, Column, Column, Column]:
    """The first word of ``window``, its first two, its second and its third."""
    pair = F.substring_index("window", " ", 2)
    return F.substring_index("window", " ", 1), pair, F.substring_index(pair, " ", -1), F.substring_index("window", " ", -1)


def frequent_beginnings(documents: DataFrame) -> tuple[list[str], list[str]]:
    """First words and first pairs of more than one in ``HOT_SHARE`` windows of a sample."""
    rows = documents.count()
    sampled = documents.sample(fraction=min(1.0, SAMPLE / max(rows, 1)), seed=13)
    first, pair, _, _ = _parts()
    counted = count_windows(sampled).select(first.alias("first"), pair.alias("pair"), "n")
    pairs = materialized(counted.groupBy("first", "pair").agg(F.sum("n").alias("n")), "sampled-pairs")
    least = (pairs.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    heads = pairs.groupBy("first").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("first")
    pairs = pairs.where(F.col("n") > least).select("pair")
    return [row[0] for row in heads.collect()], [row[0] for row in pairs.collect()]


def phrase_counts(documents: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, first, second, third, f``: phrases found ``min_count`` times or more, and each language's words in all.

    Missing words are null; the row of a language has no word and any count.
    """
    hot_heads, hot_pairs = frequent_beginnings(documents)
    first, pair, second, third = _parts()
    # Below zero: all windows of the first word are together; up to SALTS: all of the pair are; above: neither.
    salt = (
        F.when(pair.isin(hot_pairs), F.pmod(F.xxhash64(third), F.lit(SALTS)) + SALTS)
        .when(first.isin(hot_heads), F.pmod(F.xxhash64(second), F.lit(SALTS)))
        .otherwise(-1)
        .cast("int")
    )
    met = count_windows(documents).repartition(F.col("lang"), first, salt)
    # Each window counts for itself and, without its third word, for its pair.
    counted = (
        met.select("lang", first.alias("first"), salt.alias("salt"), second.alias("second"), third.alias("third"), "n")
        .select("lang", "first", "salt", "second", F.explode(F.array("third", F.lit(None))).alias("third"), "n")
        .groupBy("lang", "first", "salt", "second", "third")
        .agg(F.sum("n").alias("f"))
    )
    is_pair = F.col("third").isNull()
    matters = (F.col("salt") >= SALTS) | (F.col("f") >= min_count)
    no_second = F.lit(" ")
    parts = counted.where(is_pair | ((F.col("third") != "") & (F.col("f") >= min_count))).select(
        "lang",
        "first",
        F.when(is_pair & ~matters, no_second).otherwise(F.concat_ws(" ", "second", F.coalesce("third", F.lit("")))).alias("rest"),
        "f",
        F.when(is_pair, F.col("f")).otherwise(0).alias("share"),
    )
    # Whole phrases stand for themselves; words and languages are the sums of their pairs.
    summed = parts.rollup("lang", "first", "rest").agg(
        F.sum("f").alias("own"), F.sum("share").alias("share"), F.grouping_id().alias("missing")
    )
    second = F.substring_index("rest", " ", 1)
    third = F.nullif(F.substring_index("rest", " ", -1), F.lit(""))
    counts = summed.select(
        "lang",
        "first",
        second.alias("second"),
        third.alias("third"),
        F.when(F.col("missing") == 0, F.col("own")).otherwise(F.col("share")).alias("f"),
        "missing",
    ).where((F.col("missing") == 3) | ((F.col("missing") < 3) & (F.col("f") >= min_count) & (F.coalesce("second", F.lit("-")) != "")))
    return materialized(counts.drop("missing"), "phrase-counts")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 a a / (left right))`` in whole decimals."""
    wide = [value.cast("decimal(16,0)") for value in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])


def scored_phrases(counts: DataFrame, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """Candidates no longer candidate covers: ``lang, phrase, a, l, r, n, score``, cut where the score is lowest."""
    total = counts.where("first is null").select("lang", F.col("f").alias("n"))
    one = counts.where("first is not null and second is null").select("lang", "first", "f")
    two = counts.where("second is not null and third is null").select("lang", "first", "second", "f")
    three = counts.where("third is not null").select("lang", "first", "second", "third", F.col("f").alias("a"))

    def words(name: str, as_name: str) -> DataFrame:
        return one.select("lang", F.col("first").alias(name), F.col("f").alias(as_name))

    def pairs(names: tuple[str, str], as_name: str) -> DataFrame:
        return two.select("lang", F.col("first").alias(names[0]), F.col("second").alias(names[1]), F.col("f").alias(as_name))

    # Parts of a candidate are at least as frequent as it is, so all of them are among the counts.
    triples = (
        three.join(pairs(("first", "second"), "l2"), ["lang", "first", "second"])
        .join(pairs(("second", "third"), "r1"), ["lang", "second", "third"])
        .join(words("first", "l1"), ["lang", "first"])
        .join(words("third", "r2"), ["lang", "third"])
        .withColumn("s1", _score(F.col("a"), F.col("l1"), F.col("r1")))
        .withColumn("s2", _score(F.col("a"), F.col("l2"), F.col("r2")))
        .select(
            "lang",
            F.concat_ws(" ", "first", "second", "third").alias("phrase"),
            "a",
            F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
            F.when(F.col("s1") <= F.col("s2"), F.col("r1")).otherwise(F.col("r2")).alias("r"),
            F.least("s1", "s2").alias("score"),
        )
    )
    held = F.array(
        F.struct(F.col("first").alias("first"), F.col("second").alias("second")),
        F.struct(F.col("second").alias("first"), F.col("third").alias("second")),
    )
    longer = (
        three.select("lang", "a", F.explode(held).alias("p"))
        .groupBy("lang", "p.first", "p.second")
        .agg(F.max("a").alias("longer"))
    )
    doubles = (
        two.withColumnRenamed("f", "a")
        .join(longer, ["lang", "first", "second"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
        .join(words("first", "l"), ["lang", "first"])
        .join(words("second", "r"), ["lang", "second"])
        .select(
            "lang",
            F.concat_ws(" ", "first", "second").alias("phrase"),
            "a",
            "l",
            "r",
            _score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
        )
    )
    return doubles.unionByName(triples).join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best_phrases(scored: DataFrame, listed: int = LISTED) -> DataFrame:
    """The first ``listed`` phrases of each language with their ``rank`` from 1.

    Each bucket of a language gives its own best first, so no task sees all its phrases.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(_BUCKETS))
    near = scored.withColumn("bucket", bucket).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    )
    ranked = near.where(F.col("place") <= listed).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.where(F.col("rank") <= listed).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(
    documents: DataFrame, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, listed: int = LISTED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two and three words."""
    return best_phrases(scored_phrases(phrase_counts(documents, min_count), covered_percent), listed)
