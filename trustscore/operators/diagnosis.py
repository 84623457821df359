"""Rule-based diagnosis of suspicious reviews: reason type, text pattern, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import text
from trustscore.functions.repetition import token_repetition
from trustscore.operators import diagnosis_join
from trustscore.operators.validation import enforce

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# --- G1, G2: repetition -------------------------------------------------------------------------


def _third_alike(ordered: Column) -> Column:
    shifted = F.slice(ordered, F.lit(3), F.greatest(F.size(ordered) - 2, F.lit(0)))
    pairs = F.zip_with(ordered, shifted, lambda first, third: F.coalesce(first == third, F.lit(False)))
    return F.exists(pairs, lambda same: same)


def _thrice(sentences: Column) -> Column:
    """Some sentence of at least two characters occurs three times: equal neighbours two apart once sorted."""
    ordered = F.sort_array(F.filter(sentences, lambda sentence: F.length(sentence) >= 2))
    # Named by a lambda, the sorted sentences are made once and not for each use.
    return F.transform(F.array(ordered), _third_alike)[0]


def _sentences(content: Column, clean=text.collapse_spaces) -> Column:
    return F.transform(F.split(content, C.SENTENCE_BREAK), clean)


def repetition_flags(rows: DataFrame, column: str = "review") -> DataFrame:
    """G1 ``abnormal_repetition`` and G2 ``clear_repetition``.

    G1 collapses white space first, so lines do not end sentences, and keeps case; G2 splits at line ends
    and ignores case. The token rules share one pass over the text.
    """
    content = _text(column)
    # A file may be one partition, and a row here is much work: spread the rows before the costly part.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(partitions, F.xxhash64(content))
    # Splitting and folding commute with sentence breaks, so the whole text is folded once.
    return (
        rows.withColumn("_flat", text.collapse_spaces(content))
        .withColumn("_blocks", token_repetition(F.col("_flat")))
        .withColumn("_abnormal_sentence", _thrice(_sentences(F.col("_flat"), F.trim)))
        .withColumn("_folded", text.casefold(content))
        .withColumn("_clear_sentence", _thrice(_sentences(F.col("_folded"))))
        .withColumn(
            "abnormal_repetition", F.col("_abnormal_sentence") | F.col("_blocks.triple") | F.col("_blocks.covering")
        )
        .withColumn("clear_repetition", F.col("_clear_sentence") | F.col("_blocks.triple"))
        .drop("_flat", "_blocks", "_abnormal_sentence", "_folded", "_clear_sentence")
    )


def abnormal_repetition(rows: DataFrame, column: str = "review") -> DataFrame:
    """G1."""
    return repetition_flags(rows, column).drop("clear_repetition")


def clear_repetition(rows: DataFrame, column: str = "review") -> DataFrame:
    """G2."""
    return repetition_flags(rows, column).drop("abnormal_repetition")


# --- G3: reason type ----------------------------------------------------------------------------


def joined_evidence(*columns: Column) -> Column:
    """Non-empty parts joined by a blank, in the given order."""
    return F.concat_ws(" ", *[F.when(F.length(column) > 0, column) for column in columns])


def classify_reason(rows: DataFrame) -> DataFrame:
    """Add ``diagnostic_type``. Relations to other reviews come first, then what the text itself shows."""
    prepared = repetition_flags(
        rows.withColumn(
            "_evidence", joined_evidence(text.collapse_spaces(C.NOTE_COLUMN), text.collapse_spaces("collection_reason"))
        ).withColumn("_review", text.collapse_spaces("review")),
        "_review",
    )
    evidence = F.col("_evidence")
    lacks = text.matches_any(evidence, C.LACK_OF_EXPERIENCE_EVIDENCE)
    personal = text.matches_any(F.concat_ws(" ", F.col("_review"), evidence), C.EXPERIENCE_EVIDENCE)
    kind = (
        F.when(text.matches_any(evidence, C.NETWORK_EVIDENCE), "NETWORK_STRONG")
        .when(F.col("abnormal_repetition"), "TEXT_STRONG")
        .when(text.matches_any(evidence, C.PRODUCT_COPY_EVIDENCE) & (lacks | ~personal), "TEXT_STRONG")
        .when(text.matches_any(evidence, C.PROMOTION_EVIDENCE) & lacks, "TEXT_STRONG")
        .otherwise("TEXT_WEAK")
    )
    return prepared.withColumn("diagnostic_type", kind).drop(
        "_evidence", "_review", "abnormal_repetition", "clear_repetition"
    )


# --- G4..G8: text pattern -----------------------------------------------------------------------


def _is_heading(line: Column) -> Column:
    plain = text.strip(F.regexp_replace(line, r"^[^가-힣A-Za-z0-9]+", ""))
    return plain.rlike(text.java_pattern(f"^{C.SECTION_HEADING}\\z"))


def _is_item(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(C.WORD))
    ends_sentence = line.rlike(text.java_pattern(f"{C.SENTENCE_ENDING}\\z"))
    return words.between(1, 6) & F.length(line).between(2, 40) & ~ends_sentence


def _heading_with_items(lines: Column) -> Column:
    """A heading followed by three short items; blank lines before the first item are skipped."""

    def state(open_: Column, items: Column, found: Column) -> Column:
        return F.struct(open_.alias("open"), items.alias("items"), found.alias("found"))

    def step(held: Column, line: Column) -> Column:
        blank = F.length(line) == 0
        item = held["open"] & ~blank & _is_item(line)
        items = F.when(item, held["items"] + 1).otherwise(held["items"])
        stays_open = item | (held["open"] & blank & (held["items"] == 0))
        return F.when(_is_heading(line), state(F.lit(True), F.lit(0), held["found"])).otherwise(
            state(stays_open, items, held["found"] | (item & (items >= 3)))
        )

    start = state(F.lit(False), F.lit(0), F.lit(False))
    return F.aggregate(lines, start, step, lambda held: held["found"])


def structured_info(rows: DataFrame, column: str = "review") -> DataFrame:
    """List markers, labelled sections, or a heading with items."""
    lines = F.transform(F.split(_text(column), LINE_BREAK), text.strip)
    markers = F.size(F.filter(F.col("_lines"), lambda line: line.rlike(text.java_pattern(f"^{C.LIST_MARKER}"))))
    sections = F.regexp_count(_text(column), F.lit(text.java_pattern(C.SECTION_LABEL)))
    return (
        rows.withColumn("_lines", lines)
        .withColumn(
            "structured_info",
            (markers >= 2) | (sections >= 3) | _heading_with_items(F.col("_lines")),
        )
        .drop("_lines")
    )


def personal_experience(column: Column) -> Column:
    """G5."""
    return text.matches_any(column, C.PERSONAL_EXPERIENCE)


def product_copy_count(column: Column) -> Column:
    """G6."""
    return text.matching_count(column, C.PRODUCT_COPY_SIGNALS)


def promo_cta(column: Column) -> Column:
    """G7."""
    return text.matches_any(column, C.PROMOTIONAL_CTA)


def classify_pattern(rows: DataFrame) -> DataFrame:
    """Add ``p_text_pattern`` and ``reason``; the review decides, evidence only supports product copy."""
    content = _text("review")
    evidence = joined_evidence(text.strip(_text("collection_reason")), text.strip(_text(C.NOTE_COLUMN)))
    featured = (
        structured_info(repetition_flags(rows))
        .withColumn("_personal", personal_experience(content))
        .withColumn("_copy", product_copy_count(content))
        .withColumn("_supported", text.matches_any(evidence, C.COPY_SUPPORTING_EVIDENCE))
    )
    copied = (F.col("_copy") >= 2) | ((F.col("_copy") >= 1) & F.col("_supported"))
    pattern = (
        F.when(F.col("clear_repetition"), "REPETITION")
        .when(F.col("structured_info"), "STRUCTURED_INFO")
        .when(~F.col("_personal") & copied, "PRODUCT_COPY")
        .when(~F.col("_personal") & promo_cta(content), "PROMOTIONAL_CTA")
        .otherwise("AMBIGUOUS_TEXT_STRONG")
    )
    sentences = F.create_map(*[F.lit(part) for pair in C.PATTERN_REASONS.items() for part in pair])
    return (
        featured.withColumn("p_text_pattern", pattern)
        .withColumn("reason", sentences[F.col("p_text_pattern")])
        .drop("_personal", "_copy", "_supported", "structured_info", "clear_repetition", "abnormal_repetition")
    )


def usable_text_strong(master: DataFrame, diagnoses: DataFrame, check: bool = True) -> DataFrame:
    """Pattern and candidate flag of the retained suspicious rows diagnosed TEXT_STRONG."""
    everything = master.withColumn("split", F.lit("all"))
    attached = diagnosis_join.attach_by_id(everything, master, diagnoses, check)
    evidence = diagnoses.select("master_id", "collection_reason", C.NOTE_COLUMN)
    strong = attached.filter(F.col("diagnostic_type") == "TEXT_STRONG").join(evidence, "master_id")
    return classify_pattern(strong).select(
        "master_id",
        "review",
        F.col("diagnostic_type").alias("previous_diagnostic_type"),
        "p_text_pattern",
        (F.col("p_text_pattern") != C.PATTERNS[-1]).alias("p_text_v2_positive_candidate"),
        "reason",
    )


# --- G10..G12: checks and summaries -------------------------------------------------------------


def check_expectations(rows: DataFrame, expected: DataFrame, observed_column: str) -> DataFrame:
    """Expected (master_id, expected) that the rows miss or contradict; empty when all hold."""
    observed = rows.select(
        text.master_id("master_id").alias("master_id"), F.col(observed_column).alias("observed")
    )
    return (
        expected.join(observed, "master_id", "left")
        .filter(~F.col("expected").eqNullSafe(F.col("observed")))
        .select("master_id", "expected", F.coalesce("observed", F.lit("MISSING")).alias("observed"))
    )


def require_expectations(rows: DataFrame, expected: DataFrame, observed_column: str) -> None:
    """G10, strict form: raise when an expectation fails."""
    enforce(check_expectations(rows, expected, observed_column), "expectations", ValueError)


def value_summary(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Count and percentage per listed value (zero included) and in total."""
    counted = rows.rollup(column).agg(F.count("*").alias("rows"))
    named = counted.withColumn(column, F.coalesce(column, F.lit("TOTAL")))
    listed = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in (*values, "TOTAL")])).alias(column))
    filled = listed.join(named, column, "left").fillna(0, ["rows"])
    total = F.max(F.when(F.col(column) == "TOTAL", F.col("rows"))).over(Window.partitionBy())
    return filled.withColumn("percent", F.coalesce(F.try_divide(F.col("rows") * 100.0, total), F.lit(0.0)))


def type_summary(rows: DataFrame) -> DataFrame:
    """Rows and share per diagnostic type."""
    return value_summary(rows, "diagnostic_type", C.DIAGNOSTIC_TYPES)


def pattern_summary(rows: DataFrame) -> DataFrame:
    """Rows and share per text pattern; all but the ambiguous one are candidates."""
    return value_summary(rows, "p_text_pattern", C.PATTERNS).withColumn(
        "candidate", F.when(F.col("p_text_pattern") != "TOTAL", F.col("p_text_pattern") != C.PATTERNS[-1])
    )


def samples(rows: DataFrame, count: int = 5, order: str = "row_no") -> DataFrame:
    """The first rows of every type; only the first few of each task are shuffled."""
    ranked = F.row_number().over(Window.partitionBy("diagnostic_type").orderBy(order))
    return (
        rows.withColumn("sample_no", ranked)
        .filter(F.col("sample_no") <= count)
        .withColumn("review", text.abbreviate("review"))
    )
