"""Representative ids of retained texts and diagnoses attached to split rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustscore.functions import text
from trustscore.operators import labelled
from trustscore.operators.network_signal import text_key
from trustscore.operators.validation import enforce
from trustscore.session import materialized


class UnsafeJoin(ValueError):
    """Rows cannot be matched one to one."""


def _raise_on(rows: DataFrame, message: str) -> None:
    enforce(rows, message, UnsafeJoin)


def master_id_problems(source: DataFrame) -> DataFrame:
    """Usable rows without an id, and ids used by several usable rows."""
    usable = labelled.select_labelled(source.withColumn("master_id", text.master_id("master_id")), carry=("master_id",))
    return (
        usable.groupBy("master_id")
        .agg(F.count("*").alias("rows"))
        .select(
            "master_id",
            F.when(F.col("master_id") == "", "empty_master_id").when(F.col("rows") > 1, "duplicate_master_id").alias("problem"),
        )
        .filter(F.col("problem").isNotNull())
    )


def prepare_master_rows(source: DataFrame, prepared: DataFrame | None = None, check: bool = True) -> DataFrame:
    """(master_id, text, label, norm_key) of every retained text, first row in input order.

    With ``prepared`` (texts and labels made elsewhere) the recovered set must be equal to it.
    """
    if check:
        _raise_on(master_id_problems(source), "master ids of usable rows must be present and unique")
    usable = labelled.select_labelled(source.withColumn("master_id", text.master_id("master_id")), carry=("master_id",))
    retained = labelled.prepare_examples(usable, carry=("master_id",))
    if prepared is not None and check:
        # Guard and result read the same rows, so they are written once.
        retained = materialized(retained, "retained")
        if not _differing_keys(retained, prepared).isEmpty():
            _raise_on(representative_differences(retained, prepared), "recovered representatives differ from the prepared set")
    return retained


def _differing_keys(retained: DataFrame, prepared: DataFrame) -> DataFrame:
    """Keys of the texts that ``representative_differences`` lists; texts are compared by digest and never joined."""
    known = "norm_key" in prepared.columns
    right_key = F.col("norm_key") if known else text_key(text.normalize_text("text")).alias("norm_key")
    left = retained.select("norm_key", F.struct(text_key(F.col("text")).alias("text"), "label").alias("retained"))
    right = prepared.select(right_key, F.struct(text_key(F.col("text")).alias("text"), "label").alias("prepared"))
    return left.join(right, "norm_key", "full_outer").filter(~F.col("retained").eqNullSafe(F.col("prepared"))).select("norm_key")


def representative_differences(retained: DataFrame, prepared: DataFrame) -> DataFrame:
    """Texts on one side only, or with another representative or label; empty when the sets are equal."""
    left = retained.select("norm_key", F.col("text").alias("retained_text"), F.col("label").alias("retained_label"))
    right = prepared.select(
        text_key(text.normalize_text("text")).alias("norm_key"),
        F.col("text").alias("prepared_text"),
        F.col("label").alias("prepared_label"),
    )
    return left.join(right, "norm_key", "full_outer").filter(
        ~F.col("retained_text").eqNullSafe(F.col("prepared_text"))
        | ~F.col("retained_label").eqNullSafe(F.col("prepared_label"))
    )


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """Suspicious rows with the key of their normalised text; prepared examples already have it."""
    key = F.col("norm_key") if "norm_key" in rows.columns else text_key(text.normalize_text("text")).alias("norm_key")
    return rows.filter(F.col("label") == 1).select(*columns, F.col("text").alias("review"), key)


def _suspicious_with_ids(splits: DataFrame, master: DataFrame) -> DataFrame:
    rows = _keyed(splits, "split")
    return rows.join(master.select("norm_key", "master_id"), "norm_key", "left")


def _with_diagnosis(splits: DataFrame, master: DataFrame, diagnoses: DataFrame) -> DataFrame:
    side = diagnoses.select(
        "master_id",
        F.col("diagnostic_type"),
        text_key(text.normalize_text(F.coalesce("review", F.lit("")))).alias("diagnosed_key"),
    )
    return _suspicious_with_ids(splits, master).join(side, "master_id", "left")


def attach_problems(splits: DataFrame, master: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """D13 guards: no representative, no diagnosis, another text under the same id, an id in several splits."""
    return _problems(_with_diagnosis(splits, master, diagnoses))


def _problems(joined: DataFrame) -> DataFrame:
    problem = (
        F.when(F.col("master_id").isNull(), "no_representative")
        .when(F.col("diagnostic_type").isNull(), "no_diagnosis")
        .when(F.col("diagnosed_key") != F.col("norm_key"), "text_mismatch")
    )
    single = joined.select("master_id", problem.alias("problem")).filter(F.col("problem").isNotNull())
    repeated = (
        joined.filter(F.col("master_id").isNotNull())
        .groupBy("master_id")
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") > 1)
        .select("master_id", F.lit("several_splits").alias("problem"))
    )
    return single.unionByName(repeated)


def attach_by_id(splits: DataFrame, master: DataFrame, diagnoses: DataFrame, check: bool = True) -> DataFrame:
    """(master_id, split, review, diagnostic_type) of the suspicious split rows."""
    joined = _with_diagnosis(splits, master, diagnoses)
    if check:
        # Guard and result read the same join, so it is written once.
        joined = materialized(joined, "attached")
        _raise_on(_problems(joined), "diagnoses cannot be attached")
    return (
        joined
        .filter(F.col("diagnosed_key") == F.col("norm_key"))
        .select("master_id", "split", "review", "diagnostic_type")
    )


def attach_by_text(rows: DataFrame, by_text: DataFrame, check: bool = True) -> DataFrame:
    """Suspicious rows with the first diagnosis of their normalised text (see ``load_diagnoses_by_text``)."""
    joined = _keyed(rows).join(by_text.select("norm_key", "master_id", "diagnostic_type"), "norm_key", "left")
    if check:
        joined = materialized(joined, "attached")
        _raise_on(joined.filter(F.col("diagnostic_type").isNull()).select("review"), "no diagnosis for the text")
    return joined.filter(F.col("diagnostic_type").isNotNull()).select("master_id", "review", "diagnostic_type")
