"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are cut into words. A window is ``window`` consecutive words of a benchmark item, or the whole item where it
has fewer. Word k-grams are hashed, and of every run of consecutive k-grams that spans one window the smallest hash
is kept: two texts that share a window share all hashes in it, hence the kept one, so a join of kept hashes
misses no shared window. A hit is then extended on both sides, word by word, as far as a window through it
reaches; only equal words count, so a collision of hashes is never a result.

Documents are looked up in two steps. First every text leaves its digest, its number of words and its kept hashes;
joined with the hashes of the items these give the texts with a hit, one row per text however many copies it has.
Only those are cut into words again, and only at the positions of shared hashes. Equal surroundings of item
hashes are one row. Words inside a hit are counted by position, items by id, so nothing is gathered but the ids
of one document's items.

Defined cases: null and empty texts have no words, match nothing and are not contaminated; an item without
words matches nothing; items of equal id count once; items with a null id mark words but are not listed; equal
rows and repeated ids give one row each; empty tables give empty results or clean documents; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore.session import materialized

WINDOW = 10
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    # For ASCII texts lower() is the same and much cheaper.
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )
    return F.array_remove(F.split(lower, BETWEEN_WORDS), "")


def gram_size(window: int) -> int:
    """Words in a k-gram: half a window, so that about a quarter of all k-grams are kept."""
    return (window + 1) // 2


def _part(values: Column, start: int | Column, length: Column) -> Column:
    return F.slice(values, start, F.greatest(length, F.lit(0)))


def gram_hashes(words: Column, window: int) -> Column:
    """Hash of the k-gram at every position where one fits."""
    size = gram_size(window)
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda at: F.xxhash64(F.lit(window), *[F.get(words, at + i) for i in range(size)]))


def _runs(frame: DataFrame, name: str, length: int, pick) -> DataFrame:
    """Replace the list ``name`` by ``pick`` of two (least or greatest) over every ``length`` consecutive values.

    Spans double from step to step, each step a projection of its own, so that no list is computed twice.
    """
    span = 1
    while span < length:
        step = min(span, length - span)
        rest = F.size(name) - step
        pairs = _part(F.col(name), 1, rest), _part(F.col(name), F.lit(1 + step), rest)
        frame = frame.withColumn(name, F.zip_with(*pairs, lambda a, b: pick(a, b)))
        span += step
    return frame


def with_window_minima(frame: DataFrame, name: str, window: int) -> DataFrame:
    """Add the list ``name``: the smallest k-gram hash of every window of the list ``words``."""
    hashed = frame.withColumn(name, gram_hashes(F.col("words"), window))
    return _runs(hashed, name, window - gram_size(window) + 1, F.least)


def _with_kept_positions(frame: DataFrame, window: int) -> DataFrame:
    """Add ``hashes`` and ``at``: positions of the k-grams that are the smallest of a window through them, ties included."""
    reach = window - gram_size(window) + 1
    edge = F.array_repeat(F.lit(-(1 << 63)), reach - 1)
    lowest = with_window_minima(frame, "low", window)
    highest = _runs(lowest.withColumn("low", F.concat(edge, "low", edge)), "low", reach, F.greatest)
    hashed = highest.withColumn("hashes", gram_hashes(F.col("words"), window))
    kept = F.transform("hashes", lambda h, at: F.when((F.size("hashes") >= reach) & (h == F.get("low", at)), at))
    return hashed.withColumn("at", F.filter(kept, lambda at: at.isNotNull())).drop("low")


def _marks(rows: DataFrame, window: int, only: Column | None = None) -> DataFrame:
    """One row per kept k-gram of ``words``: its hash ``mark`` and the words ``before`` (backwards) and ``after`` it.

    Both sides reach as far as a window through the k-gram does. ``only`` restricts the hashes.
    """
    size = gram_size(window)
    kept = _with_kept_positions(rows, window)
    if only is not None:
        kept = kept.withColumn("at", F.filter("at", lambda at: F.array_contains(only, F.get("hashes", at))))

    def surroundings(at: Column) -> Column:
        left = F.least(at, F.lit(window - size))
        return F.struct(
            at.alias("at"),
            F.get("hashes", at).alias("mark"),
            F.reverse(F.slice("words", at - left + 1, left)).alias("before"),
            F.slice("words", at + 1, F.lit(window)).alias("after"),
        )

    others = [name for name in rows.columns if name != "words"]
    return kept.select(*others, F.explode(F.transform("at", surroundings)).alias("m")).select(*others, "m.*")


def _common(left: Column, right: Column) -> Column:
    """Number of equal words at the heads of two lists."""
    differs = F.array_position(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(left), F.size(right))).cast("int")


def benchmark_marks(items: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """Kept k-grams of all items (``item_id, span, mark, before, after``) and the window lengths that occur.

    ``span`` is the window length of the item: ``window``, or the item's number of words where it has fewer.
    """
    cut = materialized(
        items.select("item_id", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("span", F.least(F.size("words"), F.lit(window))),
        "item-words",
    )
    spans = sorted(row.span for row in cut.select("span").distinct().collect())  # at most `window` numbers
    marks = None
    for span in spans:
        own = _marks(cut.where(F.col("span") == span), span)
        marks = own if marks is None else marks.unionByName(own)
    return marks, spans


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of ``benchmark`` (``item_id, text``) occurs in ``documents`` (``doc_id, text``), as three tables.

    ``rows``: ``doc_id, n_words`` and the text's ``digest``, one row per document; ``spans``: ``digest, start, stop``,
    the word ranges (from zero, stop exclusive) found in a text; ``items``: ``digest, item_id``, once each.
    """
    spark = documents.sparkSession
    marks, spans = benchmark_marks(benchmark, window)
    texts = documents.select("doc_id", "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    words = texts.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    for span in spans:
        words = with_window_minima(words, f"minima{span}", span)
    minima = [F.array_distinct(f"minima{span}") for span in spans]
    kept = F.concat(*minima) if minima else F.expr("cast(array() as array<bigint>)")
    facts = materialized(
        words.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), kept.alias("kept")), "winnowed"
    )
    rows = facts.select("doc_id", "digest", "n_words")
    if marks is None:
        nothing = spark.createDataFrame([], "digest binary, start int, stop int, item_id string")
        return rows, nothing.select("digest", "start", "stop"), nothing.select("digest", "item_id")

    surroundings = F.sha2(F.to_json(F.struct("span", "mark", "before", "after")), 256).alias("place")
    marks = materialized(marks.select("item_id", "span", "mark", "before", "after", surroundings), "item-marks")
    places = marks.select("place", "span", "mark", "before", "after").dropDuplicates(["place"])

    shared = (
        facts.select("doc_id", "digest", F.explode("kept").alias("mark"))
        .join(marks.select("mark").distinct(), "mark")
        .groupBy("digest", "mark")
        .agg(F.min("doc_id").alias("doc_id"))
    )
    # The marks of one text: no more than it has words.
    hit = shared.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.collect_set("mark").alias("shared"))
    again = (
        texts.join(hit.withColumnRenamed("doc_id", "one"), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("one")))
        .select("digest", "shared", words_of(F.col("text")).alias("words"))
    )
    again = materialized(again, "hit-texts")
    found = None
    for span in spans:
        own = _marks(again, span, F.col("shared")).select("digest", "at", "mark", "before", "after")
        own = own.withColumn("span", F.lit(span))
        found = own if found is None else found.unionByName(own)
    theirs = places.select("place", "span", "mark", F.col("before").alias("item_before"), F.col("after").alias("item_after"))
    extended = (
        found.join(theirs, ["mark", "span"])
        .withColumn("left", _common(F.col("before"), F.col("item_before")))
        .withColumn("right", _common(F.col("after"), F.col("item_after")))
        .where(F.col("left") + F.col("right") >= F.col("span"))
    )
    hits = materialized(
        extended.select(
            "digest", "place", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop")
        ).distinct(),
        "hits",
    )
    items = hits.select("digest", "place").distinct().join(marks.select("place", "item_id"), "place")
    return (
        rows,
        hits.select("digest", "start", "stop").distinct(),
        items.where(F.col("item_id").isNotNull()).select("digest", "item_id").distinct(),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit`` (words inside a found window) and ``items``, the sorted ids."""
    rows, spans, items = find_leaks(documents, benchmark, window)
    inside = (
        spans.select("digest", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at"))
        .distinct()
        .groupBy("digest")
        .agg(F.count("*").alias("n_hit"))
    )
    listed = items.groupBy("digest").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    return (
        rows.join(inside, "digest", "left")
        .join(listed, "digest", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        )
    )
