"""Fixed schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_REQUIRED = ("platform", "product_id", "review_id", "content")

CRAWLED_REVIEW = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("review_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("author", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("option", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("helpful_count", T.IntegerType()),
        T.StructField("collected_at", T.TimestampType()),
    ]
)

PROGRESS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("collected", T.LongType()),
        T.StructField("target", T.LongType()),
    ]
)
DONE = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("collected", T.LongType())])
ERROR = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("retryable", T.BooleanType()),
    ]
)
HEARTBEAT = T.StructType([])

JOB_EVENT = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)
