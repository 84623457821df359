"""Training master assembled from reviewed sources, and train-only augmentation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import text
from trustscore.functions.ranking import side_by_side
from trustscore.operators import labelled
from trustscore.operators.network_signal import text_key
from trustscore.session import materialized


@dataclass(frozen=True)
class Source:
    """One reviewed table. ``frame`` carries ``row_no``, the zero-based position of the row."""

    name: str
    frame: DataFrame
    sheet: str
    text_column: str
    label_column: str
    id_column: str
    requires_approval: bool
    file_name: str = ""


def required_columns(source: Source) -> set[str]:
    needed = {source.text_column, source.label_column}
    return needed | {"use_for_training"} if source.requires_approval else needed


def check_source(source: Source) -> None:
    """Required columns present, no header twice."""
    headers = [name for name in source.frame.columns if name.strip()]
    missing = sorted(required_columns(source) - set(headers))
    if missing:
        raise ValueError(f"source {source.name} lacks {', '.join(missing)}")
    if len(headers) != len(set(headers)):
        raise ValueError(f"source {source.name} names a column twice")


def _approved(source: Source) -> Column:
    """Exact label of the allowed set, and the approval flag where the source needs one."""
    allowed = list(C.LABELS) if source.requires_approval else ["NORMAL"]
    condition = F.coalesce(F.col(source.label_column).isin(allowed), F.lit(False))
    if source.requires_approval:
        flag = F.upper(text.strip(F.coalesce(F.col("use_for_training").cast("string"), F.lit(""))))
        condition = condition & (flag == "YES")
    return condition


def _selected(source: Source) -> DataFrame:
    check_source(source)
    sheet_row = F.col("row_no") + C.SOURCE_ROWS_FROM
    given = F.col(source.id_column).cast("string") if source.id_column in source.frame.columns else F.lit(None)
    fallback = F.concat(F.lit(f"{source.sheet}:"), sheet_row.cast("string"))
    note = F.concat(F.lit(f"{source.file_name or source.name}; sheet={source.sheet}; row="), sheet_row.cast("string"))
    return source.frame.filter(_approved(source) & ~text.is_blank(source.text_column)).select(
        F.lit(source.name).alias("source_set"),
        F.when(text.is_blank(given), fallback).otherwise(given).alias("source_id"),
        F.col(source.text_column).cast("string").alias("content"),
        F.col(source.label_column).alias("final_label"),
        F.lit("YES").alias("use_for_training"),
        note.alias("source_note"),
    )


def assemble(sources: list[Source]) -> DataFrame:
    """All approved rows of all sources, text untouched, nothing de-duplicated."""
    return reduce(DataFrame.unionByName, [_selected(source) for source in sources])


def assemble_audit(sources: list[Source]) -> DataFrame:
    """Per source and in total, rows read, rows selected per label, approved rows with blank content."""

    def counted(source: Source) -> DataFrame:
        check_source(source)
        approved, blank = _approved(source), text.is_blank(source.text_column)
        return source.frame.agg(
            F.count("*").alias("rows_read"),
            *[F.count_if(approved & ~blank & (F.col(source.label_column) == name)).alias(name) for name in C.LABELS],
            F.count_if(approved & blank).alias("empty_content_excluded"),
        ).withColumn("source_set", F.lit(source.name))

    measures = ["rows_read", *C.LABELS, "empty_content_excluded"]
    per_source = reduce(DataFrame.unionByName, [counted(source) for source in sources])
    return (
        per_source.rollup("source_set")
        .agg(*[F.sum(name).alias(name) for name in measures])
        .withColumn("source_set", F.coalesce("source_set", F.lit("TOTAL")))
        .withColumn("output_rows", F.col("NORMAL") + F.col("SUSPICIOUS"))
    )


# --- augmentation -------------------------------------------------------------------------------


class InvalidAugmentation(ValueError):
    """Synthetic rows break a guard."""


def select_synthetic(synthetic: DataFrame) -> DataFrame:
    """Usable synthetic rows: content present, flag YES, known label."""
    return labelled.select_labelled(synthetic, "content", "final_label", "use_for_training")


def augmentation_problems(synthetic: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """One row per broken guard; ``examples`` are the prepared synthetic rows where the caller has them.

    NORMAL labels are looked for in the raw rows, before the flag or de-duplication could hide one.
    """
    name = F.upper(text.strip(F.coalesce(F.col("final_label"), F.lit(""))))
    raw = synthetic.agg(F.count_if(name == "NORMAL").alias("normal_rows"))
    prepared = labelled.prepare_examples(select_synthetic(synthetic)) if examples is None else examples
    usable = prepared.agg(
        F.count("*").alias("usable"), F.count_if(F.col("label") != 1).alias("not_suspicious")
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("normal_rows") > 0, F.lit("contains_normal")),
            F.when(F.col("usable") == 0, F.lit("nothing_usable")),
            F.when(F.col("not_suspicious") > 0, F.lit("not_suspicious")),
        )
    )
    return side_by_side([raw, usable]).select(F.explode(problems).alias("problem"))


def check_augmentation(synthetic: DataFrame, examples: DataFrame | None = None) -> None:
    found = [row.problem for row in augmentation_problems(synthetic, examples).collect()]
    if found:
        raise InvalidAugmentation("synthetic augmentation must hold only usable SUSPICIOUS rows: " + ", ".join(found))


def _additions(splits: DataFrame, examples: DataFrame) -> DataFrame:
    """Synthetic examples whose normalised text is in no real split."""
    known = "norm_key" in splits.columns
    real = splits.select("norm_key" if known else text_key(text.normalize_text("text")).alias("norm_key"))
    return examples.join(real, "norm_key", "left_anti")


def augment_train(splits: DataFrame, synthetic: DataFrame, check: bool = True) -> DataFrame:
    """Real splits plus collision-free synthetic rows, which only ever enter train."""
    examples = labelled.prepare_examples(select_synthetic(synthetic))
    if check:
        # Guard and result read the same examples, so they are written once.
        examples = materialized(examples, "synthetic-examples")
        check_augmentation(synthetic, examples)
    added = _additions(splits, examples)
    return splits.select("text", "label", "split", F.lit(False).alias("synthetic")).unionByName(
        added.select("text", "label", F.lit(C.SPLITS[0]).alias("split"), F.lit(True).alias("synthetic"))
    )


def augment_audit(splits: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Synthetic rows selected, left after de-duplication, colliding with real texts, added; train size before and after."""
    selected = select_synthetic(synthetic)
    # Two counts read the keys, so they are written once; the texts are not needed.
    examples = materialized(labelled.prepare_examples(selected).select("norm_key"), "synthetic-keys")
    raw = selected.agg(F.count("*").alias("augmentation_raw_selected"))
    used = examples.agg(F.count("*").alias("augmentation_used_after_deduplication"))
    added = _additions(splits, examples).agg(F.count("*").alias("augmentation_added_to_train"))
    before = splits.agg(F.count_if(F.col("split") == C.SPLITS[0]).alias("train_before"))
    return (
        side_by_side([raw, used, added, before])
        .select(
            "augmentation_raw_selected",
            "augmentation_used_after_deduplication",
            (F.col("augmentation_used_after_deduplication") - F.col("augmentation_added_to_train")).alias(
                "augmentation_real_collision_removed"
            ),
            "augmentation_added_to_train",
            "train_before",
            (F.col("train_before") + F.col("augmentation_added_to_train")).alias("train_after"),
        )
    )
