"""Keys, mapping of collected reviews to analysis inputs, and contract checks that return violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import numbers, text
from trustscore.operators.meta import classify_rti

KEY_SEPARATOR = ":"

# Fields of an analysis input that collected reviews cannot provide.
UNOBSERVED = {
    "user_id": "string",
    "verified_purchase": "boolean",
    "account_created_at": "timestamp",
    "user_review_dates": "array<timestamp>",
}


class ContractViolation(ValueError):
    """A batch breaks a rule that the caller asked to enforce."""


def enforce(violations: DataFrame, what: str, error: type[Exception] = ContractViolation) -> None:
    """Raise when a table of violations has rows, with their number and the first as an example.

    The whole table stays with the caller, who can write it.
    """
    count = violations.count()
    if count:
        example = violations.orderBy(*violations.columns).first().asDict()
        raise error(f"{what}: {count} violations, for example {example}")


def scoped_key(platform: Column | str, native_id: Column | str) -> Column:
    """Platform-scoped identifier."""
    return F.concat_ws(KEY_SEPARATOR, platform, native_id)


def mixed_batches(reviews: DataFrame, batch: str) -> DataFrame:
    """Batches whose reviews come from more than one (platform, product): how many, and the first by name.

    ``batch_origins`` lists them all, one row each.
    """
    counted = batch_origins(reviews, batch).groupBy(batch).agg(
        F.count("*").alias("origin_count"), F.min("origin").alias("first_origin")
    )
    return counted.filter(F.col("origin_count") > 1)


def batch_origins(reviews: DataFrame, batch: str) -> DataFrame:
    """The distinct origins of every batch."""
    return reviews.select(batch, scoped_key("platform", "product_id").alias("origin")).distinct()


def resolve_product_key(reviews: DataFrame, product_key: str | None = None, batch: str | None = None) -> DataFrame:
    """Add ``product_key``: the explicit key, or the scoped key of the review's own product.

    Without an explicit key a batch must have one origin; with ``batch`` that is checked per batch,
    otherwise over all rows.
    """
    if product_key is not None:
        if not product_key.strip():
            raise ValueError("product_key must not be blank")
        return reviews.withColumn("product_key", F.lit(product_key))
    grouped = reviews if batch else reviews.withColumn("_batch", F.lit(0))
    key = batch or "_batch"
    if grouped.isEmpty():
        raise ValueError("reviews must not be empty")
    enforce(mixed_batches(grouped, key), "a batch without a product_key must come from one product")
    return reviews.withColumn("product_key", scoped_key("platform", "product_id"))


def to_analysis_inputs(keyed: DataFrame) -> DataFrame:
    """Collected reviews (with ``product_key``) to analysis inputs; display authors never become user ids."""
    return keyed.select(
        *[name for name in ("platform", "row_no") if name in keyed.columns],
        scoped_key("platform", "review_id").alias("review_id"),
        F.col("product_key").alias("product_id"),
        "content",
        F.col("written_at").alias("review_date"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in UNOBSERVED.items()],
    )


def to_inputs_from_rows(rows: DataFrame, platform: str, product_id: str) -> DataFrame:
    """Loosely shaped rows of one product to analysis inputs.

    ``review_date`` falls back to ``written_at`` only when the column is absent, not when a value is null.
    """
    if not platform.strip():
        raise ValueError("platform must not be blank")
    foreign = F.lit(False)
    if "platform" in rows.columns:
        foreign = foreign | ~F.col("platform").eqNullSafe(F.lit(platform))
    if "product_id" in rows.columns:
        foreign = foreign | ~F.col("product_id").cast("string").eqNullSafe(F.lit(product_id))
    if not rows.filter(foreign).isEmpty():
        raise ContractViolation("some rows belong to another platform or product")
    if "review_date" in rows.columns:
        review_date = F.col("review_date")
    elif "written_at" in rows.columns:
        review_date = F.col("written_at")
    else:
        review_date = F.lit(None)
    content = F.col("content") if "content" in rows.columns else F.lit(None)
    return rows.select(
        F.lit(platform).alias("platform"),
        *[name for name in ("row_no",) if name in rows.columns],
        F.col("review_id").cast("string").alias("review_id"),
        F.lit(product_id).alias("product_id"),
        F.coalesce(content, F.lit("")).alias("content"),
        review_date.cast("timestamp").alias("review_date"),
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in UNOBSERVED.items()
        ],
    )


def validate_inputs(reviews: DataFrame, product_id: str | None = None) -> DataFrame:
    """P5: violations (product_id, review_id, violation, rows) of a review batch."""

    def row_level(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    checks = [
        row_level(text.is_blank("product_id"), "blank_product_id"),
        row_level(text.is_blank("review_id"), "blank_review_id"),
    ]
    if product_id is not None:
        checks.append(row_level(~F.col("product_id").eqNullSafe(F.lit(product_id)), "foreign_product_id"))
    counted = reviews.groupBy("product_id", "review_id").agg(F.count("*").alias("rows"))
    duplicate = row_level((F.col("rows") > 1) & ~text.is_blank("review_id"), "duplicate_review_id")
    found = F.explode(F.array_compact(F.array(*checks, duplicate)))
    return counted.select("product_id", "review_id", found.alias("violation"), "rows")


def require_valid(reviews: DataFrame, product_id: str | None = None) -> DataFrame:
    """P5, strict: raise when there are violations, else return the batch unchanged."""
    enforce(validate_inputs(reviews, product_id), "review batch")
    return reviews


SCORE_COLUMNS = ("rti", "text_score", "behavior_score", "network_score")


def validate_scores(flat: DataFrame) -> DataFrame:
    """Public scores that are null, not finite, or neither -1 nor within 0..100."""
    bad = F.array_compact(F.array(*[F.when(~numbers.is_score(F.col(name)), F.lit(name)) for name in SCORE_COLUMNS]))
    return flat.select("review_id", F.explode(bad).alias("column"))


def validate_contract(flat: DataFrame) -> DataFrame:
    """Rows whose index or level contradicts their signals.

    A null or NaN index or signal is neither a score nor missing (-1): a violation of ``rti_availability``. A null or
    NaN index has no level.
    """

    def unknown(column: Column) -> Column:
        return column.isNull() | F.isnan(column.cast("double"))

    rti = F.col("rti")
    signals = [F.col(f"{name}_score") for name in C.SIGNALS]
    all_missing = (signals[0] == -1) & (signals[1] == -1) & (signals[2] == -1)
    broken = unknown(rti) | unknown(signals[0]) | unknown(signals[1]) | unknown(signals[2])
    expected = F.when(~unknown(rti) & (rti != -1), classify_rti(rti))
    problems = F.array_compact(
        F.array(
            F.when(broken | ((rti == -1) != all_missing), F.lit("rti_availability")),
            F.when(~F.col("level").eqNullSafe(expected), F.lit("level")),
        )
    )
    return flat.select("review_id", F.explode(problems).alias("violation"))
