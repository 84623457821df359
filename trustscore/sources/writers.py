"""Sinks: refuse to overwrite, publish atomically, write metrics, nest results per product."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustscore.functions import ranking

RESULT_FIELDS = ("review_id", "rti", "level", "text_score", "behavior_score", "network_score", "reasons")


def write_new(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a result table; an existing target is an error."""
    writer = rows.write.mode("errorifexists").format(format)
    if format == "csv":
        writer = writer.options(header=True, escape='"')
    writer.save(path)


def publish(rows: DataFrame, path: str, inputs: tuple[str, ...] = (), format: str = "parquet") -> None:
    """Publish an assembled data set.

    The output committer makes files visible only when the job succeeds and then adds ``_SUCCESS``, which
    ``read_published`` asks for. The target must be new and differ from every input as the file system sees it.
    """
    spark = rows.sparkSession
    if resolved(spark, path) in {resolved(spark, other) for other in inputs}:
        raise ValueError(f"{path} is one of the inputs; a data set needs a folder of its own")
    write_new(rows, path, format)


def resolved(spark: SparkSession, path: str) -> str:
    """A path as its file system names it, without relative parts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = system.makeQualified(place).toUri()
    return f"{parts.getScheme()}://{parts.getAuthority() or ''}{posixpath.normpath(parts.getPath())}"


def read_published(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """S8, reading side: a data set whose publication was finished."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        raise FileNotFoundError(f"{path} holds no finished data set")
    return spark.read.format(format).load(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metrics table as JSON."""
    metrics.write.mode("errorifexists").json(path)


def to_product_response(flat: DataFrame, page_size: int) -> DataFrame:
    """Flat rows nested per product in input order, with the product's review count.

    A product comes as numbered pages of ``page_size`` reviews, because one array of a third of all reviews
    would fit neither a task nor a reader; the caller states how large a page its readers take. Ranks are
    exact and taken per bucket of ``row_no``, which must be unique.
    """
    keys = ["platform", "product_id"]
    counts = flat.groupBy(*keys).agg(F.count("*").alias("review_count"))
    ranked = ranking.bucketed_rank(flat, keys, ranking.number_bucket("row_no"), ["row_no"])
    page = F.floor((F.col("rank") - 1) / F.lit(page_size)).cast("int")
    entry = F.struct("row_no", F.struct(*RESULT_FIELDS).alias("result"))
    nested = ranked.groupBy(*keys, page.alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda item: item["result"]).alias("results")
    )
    return nested.join(counts, keys).select(*keys, "review_count", "page", "results")


def write_product_responses(flat: DataFrame, path: str, page_size: int) -> None:
    """S10 as JSON lines, one page per line."""
    write_new(to_product_response(flat, page_size), path, "json")
