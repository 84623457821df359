"""Labelled texts: selection, de-duplication, conflict removal, split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import numbers, ranking, text
from trustscore.operators.network_signal import text_key
from trustscore.session import materialized


class InsufficientData(ValueError):
    """A class has too few rows for train, validation and test."""


def _cleaned(column: str) -> Column:
    return text.strip(F.coalesce(F.col(column).cast("string"), F.lit("")))


def select_labelled(
    rows: DataFrame,
    text_column: str = "review",
    label_column: str = "final_label",
    flag_column: str | None = None,
    flag_value: str = "YES",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(row_no, text, label) of usable rows; labels are matched trimmed and in any case."""
    name = F.upper(_cleaned(label_column))
    label = F.coalesce(*[F.when(name == known, code) for known, code in C.LABELS.items()])
    selected = rows
    if flag_column is not None:
        selected = selected.filter(text.casefold(_cleaned(flag_column)) == flag_value.strip().casefold())
    return selected.select(
        "row_no", *carry, _cleaned(text_column).alias("text"), label.cast("int").alias("label")
    ).filter(F.col("label").isNotNull() & (F.length("text") > 0))


def group_texts(selected: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per normalised text: its first row in input order, its labels and its size.

    The aggregation combines map-side, so a text repeated in a third of all rows is one row per task
    before the shuffle.
    """
    return (
        selected.withColumn("norm_key", text_key(text.normalize_text("text")))
        .groupBy("norm_key")
        .agg(
            F.min_by(F.struct("text", *carry), "row_no").alias("first"),
            F.min("row_no").alias("row_no"),
            F.min("label").alias("label"),
            F.max("label").alias("largest_label"),
            F.count("*").alias("rows"),
        )
        .select("norm_key", "row_no", "first.*", "label", "largest_label", "rows")
    )


def dedup_first(selected: DataFrame) -> DataFrame:
    """The first row of every normalised text, conflicts included; keeps that row's own label."""
    grouped = group_texts(selected.withColumn("own_label", F.col("label")), carry=("own_label",))
    return grouped.select("row_no", "text", F.col("own_label").alias("label"), "norm_key")


def drop_conflicts(grouped: DataFrame) -> DataFrame:
    """Texts whose rows agree on the label."""
    return grouped.filter(F.col("label") == F.col("largest_label")).drop("largest_label")


def prepare_examples(selected: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Model examples, one per unambiguous normalised text."""
    return drop_conflicts(group_texts(selected, carry)).select("row_no", *carry, "text", "label", "norm_key")


def prep_audit(selected: DataFrame) -> DataFrame:
    """D3: rows selected, rows removed (all rows of conflicting texts included), conflicting texts, rows kept."""
    agree = F.col("label") == F.col("largest_label")
    kept = F.count_if(agree)
    total = F.coalesce(F.sum("rows"), F.lit(0).cast("bigint"))
    return group_texts(selected).agg(
        total.alias("raw_selected"),
        (total - kept).alias("duplicate_rows_removed"),
        F.count_if(~agree).alias("conflicting_groups_removed"),
        kept.alias("kept"),
    )


def require_classes(examples: DataFrame) -> None:
    """Each class needs at least three examples, one for every split."""
    counts = examples.agg(*[F.count_if(F.col("label") == code).alias(name) for name, code in C.LABELS.items()]).first()
    for name in C.LABELS:
        if counts[name] < C.MIN_CLASS_ROWS:
            raise InsufficientData(
                f"{counts[name]} distinct texts of {name} cannot fill three splits, which takes {C.MIN_CLASS_ROWS}"
            )


def stratified_split(examples: DataFrame, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Add ``split``: per label 10 % validation and 10 % test, each at least one, the rest train.

    Rows are ordered by a digest of seed and normalised text, so the result does not depend on
    partitioning. There are only two labels; ranks are taken per digest bucket, not per label. The
    examples are written once, because class sizes, bucket counts and the rows themselves all need them.
    """
    keyed = materialized(
        examples.withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}|"), text.normalize_text("text")))), "examples"
    )
    require_classes(keyed)
    bucket = ranking.hex_bucket("order_key", keyed.count())
    sizes = keyed.groupBy("label").agg(F.count("*").alias("class_rows"))
    ranked = ranking.bucketed_rank(keyed, ["label"], bucket, ["order_key"])
    held = F.greatest(F.lit(1), numbers.round_whole(F.col("class_rows") * C.HELD_OUT_FRACTION))
    train = F.col("class_rows") - 2 * held
    split = (
        F.when(F.col("rank") <= train, C.SPLITS[0]).when(F.col("rank") <= train + held, C.SPLITS[1]).otherwise(C.SPLITS[2])
    )
    return ranked.join(F.broadcast(sizes), "label").withColumn("split", split).drop("class_rows", "rank", "order_key")


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight per label, n / (2 * class size); a missing class leaves a null weight."""
    normal, suspicious = F.col("normal"), F.col("suspicious")
    total = normal + suspicious
    counts = train.agg(
        F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.col("label") == 1).alias("suspicious")
    )
    rows = F.array(
        F.struct(F.lit(0).alias("label"), F.try_divide(total, 2 * normal).alias("weight")),
        F.struct(F.lit(1).alias("label"), F.try_divide(total, 2 * suspicious).alias("weight")),
    )
    return counts.select(F.inline(rows))


def require_weights(weights: DataFrame) -> dict[int, float]:
    """The two weights as numbers; both classes must be present."""
    values = {row.label: row.weight for row in weights.collect()}
    if any(value is None for value in values.values()):
        raise InsufficientData("one of the two labels has no rows to weigh")
    return values


def split_counts(splits: DataFrame) -> DataFrame:
    """One row per split with its label counts, empty splits included; one pass, one row per task."""
    counted = splits.agg(
        *[
            F.count_if((F.col("split") == split) & (F.col("label") == code)).alias(f"{split}_{name}")
            for split in C.SPLITS
            for name, code in C.LABELS.items()
        ]
    )
    rows = [
        F.struct(F.lit(split).alias("split"), *[F.col(f"{split}_{name}").alias(name) for name in C.LABELS])
        for split in C.SPLITS
    ]
    return counted.select(F.inline(F.array(*rows)))
