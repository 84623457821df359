"""Readers: collected reviews, review master, labelling rows, diagnosis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions import text
from trustscore.operators.network_signal import text_key
from trustscore.operators.validation import enforce
from trustscore.schemas import CRAWLED_REVIEW, REVIEW_REQUIRED

LABELLING_REQUIRED = ("content", "final_label", "use_for_training")
DIAGNOSIS_REQUIRED = ("master_id", "review", "collection_reason", C.NOTE_COLUMN, "diagnostic_type")
BY_TEXT_REQUIRED = ("master_id", "review", "diagnostic_type")


class InvalidTable(ValueError):
    """A table misses columns or breaks its key rules."""


def require_columns(frame: DataFrame, required: tuple[str, ...] | set[str], what: str) -> DataFrame:
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise InvalidTable(f"{what} lacks the columns {', '.join(missing)}")
    return frame


def read_table(spark: SparkSession, path: str, format: str | None = None, multi_line: bool = False) -> DataFrame:
    """Parquet, JSON lines or CSV with a header (a byte order mark is skipped); strings stay strings.

    CSV records are lines, so that a large file is split over tasks; ``multi_line`` allows line breaks inside
    quoted fields and reads each file in one task.
    """
    kind = format or ("csv" if path.endswith(".csv") else "json" if path.endswith((".json", ".jsonl")) else "parquet")
    reader = spark.read
    if kind == "csv":
        reader = reader.options(header=True, multiLine=multi_line, escape='"', encoding="UTF-8")
    return reader.format(kind).load(path)


# --- S1 -----------------------------------------------------------------------------------------


def missing_required() -> Column:
    condition = F.lit(False)
    for name in REVIEW_REQUIRED:
        condition = condition | F.col(name).isNull()
    return condition


def split_required(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable reviews with empty image lists filled in, rejected rows)."""
    good = reviews.filter(~missing_required()).withColumn(
        "images", F.coalesce("images", F.array().cast("array<string>"))
    )
    return good, reviews.filter(missing_required())


def read_reviews(spark: SparkSession, path: str, format: str = "json") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) collected reviews; unknown keys are ignored."""
    return split_required(spark.read.schema(CRAWLED_REVIEW).format(format).load(path))


def limit_per_product(reviews: DataFrame, count: int = C.COLLECTION_LIMIT_DEFAULT) -> DataFrame:
    """The first rows of every product in input order; each task keeps at most ``count`` before the shuffle."""
    from pyspark.sql import Window

    if isinstance(count, bool) or not 1 <= count <= C.COLLECTION_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {C.COLLECTION_LIMIT_MAX}")
    position = F.row_number().over(Window.partitionBy("platform", "product_id").orderBy("row_no"))
    return reviews.withColumn("_position", position).filter(F.col("_position") <= count).drop("_position")


# --- S2, S3 -------------------------------------------------------------------------------------


def stripped_headers(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[name.strip() for name in frame.columns])


def read_review_master(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Review master rows."""
    return stripped_headers(read_table(spark, path, format))


def as_labelling(frame: DataFrame) -> DataFrame:
    """S3: stripped headers, required columns present, no header twice."""
    cleaned = stripped_headers(frame)
    require_columns(cleaned, LABELLING_REQUIRED, "labelling table")
    named = [name for name in cleaned.columns if name]
    if len(named) != len(set(named)):
        raise InvalidTable("labelling table names a column twice")
    return cleaned


def read_labelling(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    return as_labelling(read_table(spark, path, format))


# --- S4, S5, S6 ---------------------------------------------------------------------------------


def diagnosis_problems(diagnoses: DataFrame) -> DataFrame:
    """S4 guards: blank ids, repeated ids, unknown types."""
    keyed = diagnoses.select(
        text.master_id("master_id").alias("master_id"),
        text.strip(F.coalesce("diagnostic_type", F.lit(""))).alias("diagnostic_type"),
    )
    per_id = keyed.groupBy("master_id").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("diagnostic_type").isin(*C.DIAGNOSTIC_TYPES)).alias("unknown"),
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("master_id") == "", F.lit("blank_id")),
            F.when((F.col("master_id") != "") & (F.col("rows") > 1), F.lit("duplicate_id")),
            F.when(F.col("unknown") > 0, F.lit("unknown_type")),
        )
    )
    return per_id.select("master_id", F.explode(problems).alias("problem"))


def load_diagnoses(diagnoses: DataFrame, expected: int | None = None, check: bool = True) -> DataFrame:
    """Diagnoses keyed by id, values stripped; ``expected`` is the required number of rows."""
    require_columns(diagnoses, DIAGNOSIS_REQUIRED, "diagnosis table")
    if check:
        enforce(diagnosis_problems(diagnoses), "diagnosis table", InvalidTable)
        if expected is not None and (rows := diagnoses.count()) != expected:
            raise InvalidTable(f"expected {expected} diagnoses, found {rows}")
    cleaned = {
        name: text.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
        for name in diagnoses.columns
        if name != "row_no"
    }
    return diagnoses.withColumns(cleaned | {"master_id": text.master_id("master_id")})


def load_diagnoses_by_text(diagnoses: DataFrame, check: bool = True) -> DataFrame:
    """The first diagnosis in row order per normalised text, and how many rows share the text."""
    require_columns(diagnoses, BY_TEXT_REQUIRED, "diagnosis table")
    kind = text.strip(F.coalesce("diagnostic_type", F.lit("")))
    if check:
        enforce(diagnoses.filter(~kind.isin(*C.DIAGNOSTIC_TYPES)).select("diagnostic_type"), "unknown types", InvalidTable)
    key = text_key(text.normalize_text(F.coalesce("review", F.lit(""))))
    return (
        diagnoses.groupBy(key.alias("norm_key"))
        .agg(
            F.min_by(F.struct("master_id", kind.alias("diagnostic_type"), "review"), "row_no").alias("first"),
            F.count("*").alias("rows"),
        )
        .select("norm_key", "first.*", "rows")
    )


def load_suspicious(master: DataFrame) -> DataFrame:
    """Rows labelled SUSPICIOUS, the diagnosis columns with collapsed white space."""
    require_columns(master, {*C.DIAGNOSIS_COLUMNS, "final_label"}, "review master")
    carried = [name for name in ("row_no",) if name in master.columns]
    return master.filter(F.upper(text.collapse_spaces("final_label")) == "SUSPICIOUS").select(
        *carried, *[text.collapse_spaces(F.col(name).cast("string")).alias(name) for name in C.DIAGNOSIS_COLUMNS]
    )
