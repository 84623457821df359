"""Collection events: decoding, contract violations, forwarding, de-duplication.

Events are rows (job, seq, event, data). Everything here is stateless except ``dedup_reviews`` and works
on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trustscore.constants import EVENT_NAMES
from trustscore.schemas import CRAWLED_REVIEW, DONE, ERROR, PROGRESS, REVIEW_REQUIRED

PAYLOADS = {"review": CRAWLED_REVIEW, "progress": PROGRESS, "done": DONE, "error": ERROR}
REQUIRED = {
    "review": REVIEW_REQUIRED,
    "progress": ("job_id", "collected"),
    "done": ("job_id", "collected"),
    "error": ("job_id", "detail", "retryable"),
}
CORRUPT = "_corrupt"


def _parsed(name: str) -> Column:
    schema = T.StructType([*PAYLOADS[name].fields, T.StructField(CORRUPT, T.StringType())])
    return F.from_json("data", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def decode_events(events: DataFrame) -> DataFrame:
    """One nullable struct per known event, ``unknown`` for other names, ``violation`` for bad payloads.

    A known name with a payload that is not JSON or breaks its contract never passes silently.
    """
    decoded = events
    for name in PAYLOADS:
        decoded = decoded.withColumn(f"_{name}", F.when(F.col("event") == name, _parsed(name)))
    known = F.col("event").isin(*EVENT_NAMES)
    bad_json, bad_field, columns = F.lit(False), F.lit(False), []
    for name, schema in PAYLOADS.items():
        parsed, is_it = F.col(f"_{name}"), F.col("event") == name
        broken = is_it & (parsed.isNull() | parsed[CORRUPT].isNotNull())
        incomplete = F.lit(False)
        for field in REQUIRED[name]:
            incomplete = incomplete | parsed[field].isNull()
        if "collected" in REQUIRED[name]:
            incomplete = incomplete | (parsed["collected"] < 0)
        bad_json = bad_json | broken
        bad_field = bad_field | (is_it & ~broken & F.coalesce(incomplete, F.lit(True)))
        valid = is_it & ~broken & ~F.coalesce(incomplete, F.lit(True))
        columns.append(F.when(valid, F.struct(*[parsed[f.name].alias(f.name) for f in schema])).alias(name))
    beat = F.col("event") == "heartbeat"
    bad_json = bad_json | (beat & F.from_json("data", "map<string,string>").isNull())
    violation = F.when(known & F.coalesce(bad_json, F.lit(True)), "not_json_or_wrong_type").when(
        known & F.coalesce(bad_field, F.lit(True)), "contract_violation"
    )
    unknown = F.when(~known, F.struct(F.col("event").alias("name"), F.col("data").alias("data")))
    return decoded.select(*events.columns, *columns, unknown.alias("unknown"), violation.alias("violation"))


def event_violations(decoded: DataFrame) -> DataFrame:
    """Rejected events; the contract reports them with status 502."""
    return decoded.filter(F.col("violation").isNotNull()).select(
        "job", "seq", "event", "data", "violation", F.lit(502).alias("status")
    )


def forwardable(decoded: DataFrame) -> DataFrame:
    """Events that reach consumers: heartbeats do, unknown names do not."""
    return decoded.filter(F.col("unknown").isNull() & F.col("violation").isNull())


def dedup_reviews(decoded: DataFrame, event_time: str | None = None) -> DataFrame:
    """Drop reviews delivered again within a job; other events pass.

    A stream needs ``event_time``, with a watermark set by the caller: without it the state would grow for ever.
    """
    other = F.col("event") != "review"
    identity = F.when(other | F.col("review").isNull(), F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(
        F.concat(F.lit("r"), F.col("review.review_id"))
    )
    keyed = decoded.withColumn("_identity", identity)
    if event_time is not None:
        return keyed.dropDuplicatesWithinWatermark(["job", "_identity"]).drop("_identity")
    if decoded.isStreaming:
        raise ValueError("a stream needs event_time and a watermark to drop redelivered reviews")
    first = keyed.groupBy("job", "_identity").agg(F.min("seq").alias("seq"))
    return keyed.join(first, ["job", "_identity", "seq"], "left_semi").drop("_identity")
