"""Collection jobs: running progress, outcome, silence timeout, and scoring of completed jobs.

The batch forms are exact twins of the stateful stream for replays and tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trustscore import constants as C
from trustscore.functions import ranking
from trustscore.session import materialized
from trustscore.streaming.events import decode_events, forwardable

OUTCOME_COLUMNS = ("job", "job_id", "outcome", "status", "collected", "detail")


# --- batch twins --------------------------------------------------------------------------------


def _terminal_events(decoded: DataFrame) -> DataFrame:
    """First terminal event per job: done, error, or a contract violation."""
    is_terminal = F.col("done").isNotNull() | F.col("error").isNotNull() | F.col("violation").isNotNull()
    kind = (
        F.when(F.col("violation").isNotNull(), "violation").when(F.col("done").isNotNull(), "done").otherwise("error")
    )
    facts = F.struct(
        F.col("seq").alias("end_seq"),
        kind.alias("kind"),
        F.coalesce("done.job_id", "error.job_id").alias("end_job_id"),
        F.col("error.retryable").alias("retryable"),
        F.coalesce("error.detail", "violation").alias("detail"),
    )
    return (
        decoded.filter(is_terminal)
        .groupBy("job")
        .agg(F.min_by(facts, "seq").alias("end"))
        .select("job", "end.*")
    )


def live_events(decoded: DataFrame) -> DataFrame:
    """Events of a job up to its end; what arrives later is ignored."""
    ends = _terminal_events(decoded).select("job", "end_seq")
    return decoded.join(ends, "job", "left").filter(F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq")))


def job_progress(decoded: DataFrame) -> DataFrame:
    """One row per review and progress event with the reviews received so far and the last target.

    The running values are taken per bucket of ``seq`` and carried over buckets, so a job with very many
    events is not sorted in one task.
    """
    events = live_events(decoded).filter(F.col("review").isNotNull() | F.col("progress").isNotNull())
    rows = events.select(
        "job",
        "seq",
        F.col("review").isNotNull().alias("is_review"),
        F.when(F.col("progress").isNotNull(), F.struct("progress.job_id", "progress.target")).alias("reported"),
        ranking.number_bucket("seq").alias("_bucket"),
    )
    before = Window.partitionBy("job").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("job", "_bucket")
        .agg(
            F.count_if("is_review").alias("reviews"),
            F.max_by("reported", F.when(F.col("reported").isNotNull(), F.col("seq"))).alias("latest"),
        )
        .select(
            "job",
            "_bucket",
            F.coalesce(F.sum("reviews").over(before), F.lit(0)).alias("earlier_reviews"),
            F.last("latest", ignorenulls=True).over(before).alias("earlier_report"),
        )
    )
    so_far = Window.partitionBy("job", "_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, ["job", "_bucket"])
        .select(
            "job",
            "seq",
            (F.col("earlier_reviews") + F.sum(F.col("is_review").cast("bigint")).over(so_far)).alias("collected"),
            F.coalesce(F.last("reported", ignorenulls=True).over(so_far), F.col("earlier_report")).alias("report"),
        )
        .select("job", "seq", F.col("report.job_id").alias("job_id"), "collected", F.col("report.target").alias("target"))
    )


def outcome_of(kind: Column, retryable: Column, collected: Column) -> tuple[Column, Column]:
    """(outcome, status) of a finished or silent job."""
    complete = (kind == "done") & (collected > 0)
    outcome = F.when(complete, "complete").otherwise("error")
    status = (
        F.when(complete, 200)
        .when(kind == "done", 404)
        .when(kind.isin("violation", "closed"), 502)
        .when((kind == "error") & retryable, 504)
        .when(kind == "error", 502)
        .otherwise(504)
    )
    return F.coalesce(outcome, F.lit("error")), F.coalesce(status, F.lit(504))


def job_outcomes(decoded: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """One row per job. Only ``done`` with at least one review is complete; no end means unavailable (504).

    ``closed`` lists jobs (``job``) whose source closed the stream by itself: without an end event these are 502.
    """
    counted = (
        live_events(decoded)
        .groupBy("job")
        .agg(
            F.count_if(F.col("review").isNotNull()).alias("collected"),
            F.max_by("progress.job_id", F.when(F.col("progress").isNotNull(), F.col("seq"))).alias("progress_job_id"),
        )
    )
    # A job whose first event is terminal has no earlier events, hence the outer join.
    joined = counted.join(_terminal_events(decoded), "job", "full_outer").withColumn(
        "collected", F.coalesce("collected", F.lit(0))
    )
    if closed is not None:
        joined = joined.join(closed.select("job", F.lit(True).alias("_closed")).distinct(), "job", "left")
        joined = joined.withColumn("kind", F.coalesce("kind", F.when(F.col("_closed"), F.lit("closed"))))
    outcome, status = outcome_of(F.col("kind"), F.col("retryable"), F.col("collected"))
    return joined.select(
        "job",
        F.coalesce("end_job_id", "progress_job_id").alias("job_id"),
        outcome.alias("outcome"),
        status.alias("status"),
        "collected",
        F.col("detail"),
    )


def first_silences(events: DataFrame, silence_seconds: int = C.SILENCE_SECONDS) -> DataFrame:
    """W6 on stored events with ``received_at``: per job the first event after which it stayed silent too long.

    Every event restarts the clock. The previous event is looked up per bucket of ``seq`` and carried
    over buckets, as in ``job_progress``.
    """
    rows = events.select("job", "seq", "received_at", ranking.number_bucket("seq").alias("_bucket"))
    before = Window.partitionBy("job").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.struct("seq", "received_at")
    carried = (
        rows.groupBy("job", "_bucket")
        .agg(F.max_by(previous, "seq").alias("latest"))
        .select("job", "_bucket", F.last("latest").over(before).alias("earlier"))
    )
    inside = Window.partitionBy("job", "_bucket").orderBy("seq")
    gaps = rows.join(carried, ["job", "_bucket"]).select(
        "job", "received_at", F.coalesce(F.lag(previous).over(inside), F.col("earlier")).alias("previous")
    )
    silent = F.col("previous.received_at") + F.make_dt_interval(secs=F.lit(silence_seconds)) < F.col("received_at")
    return gaps.filter(silent).groupBy("job").agg(F.min("previous.seq").alias("last_seq"), F.lit(504).alias("status"))


def activity_spells(events: DataFrame, silence_seconds: int = C.SILENCE_SECONDS, ends: Column | None = None) -> DataFrame:
    """W6 by session windows: the spells in which a job sends events, each followed by silence.

    A spell ends where nothing comes for more than ``silence_seconds``; ``status`` is 504 unless an event of the
    spell fulfils ``ends``. ``events`` has ``job``, ``seq`` and ``received_at``; a stream also needs a watermark on
    ``received_at`` and emits a spell once the watermark has passed its silence. Sessions are merged on the JVM, and
    stored events are first combined per job and stretch of one silence, which never holds two spells, so that a job
    of very many events reaches its task as few rows. A null ``received_at`` belongs to no spell.
    """
    last = F.struct("received_at", "seq")
    facts = events.select("job", "seq", "received_at", (F.lit(False) if ends is None else F.coalesce(ends, F.lit(False))).alias("ends"))
    if events.isStreaming:
        spell = F.session_window("received_at", f"{silence_seconds} seconds")
        merged = facts.groupBy("job", spell.alias("spell")).agg(
            F.min("received_at").alias("started"), F.max(last).alias("last"), F.count("*").alias("events"), F.max("ends").alias("ended")
        )
    else:
        stretches = facts.groupBy("job", F.window("received_at", f"{silence_seconds} seconds").alias("stretch")).agg(
            F.min("received_at").alias("started"), F.max(last).alias("last"), F.count("*").alias("events"), F.max("ends").alias("ended")
        )
        micros = F.unix_micros(F.col("last.received_at").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
        gap = F.make_interval(secs=(micros / 1_000_000).cast("decimal(18,6)") + silence_seconds)
        merged = stretches.groupBy("job", F.session_window("started", gap).alias("spell")).agg(
            F.min("started").alias("started"), F.max("last").alias("last"), F.sum("events").alias("events"), F.max("ended").alias("ended")
        )
    return merged.select(
        "job",
        "started",
        F.col("last.received_at").alias("stopped"),
        F.col("last.seq").alias("last_seq"),
        "events",
        F.when(~F.col("ended"), 504).alias("status"),
    )


# --- stream -------------------------------------------------------------------------------------

STREAM_OUTPUT = (
    "job string, seq bigint, kind string, job_id string, collected bigint, target bigint, status int, detail string"
)
STREAM_STATE = "collected bigint, job_id string, target bigint, finished boolean"


def _flat_events(decoded: DataFrame) -> DataFrame:
    """The few scalar fields the state function needs; payloads stay on the JVM."""
    return decoded.select(
        "job",
        "seq",
        F.when(F.col("violation").isNotNull(), "violation").otherwise(F.col("event")).alias("kind"),
        F.coalesce("progress.job_id", "done.job_id", "error.job_id").alias("job_id"),
        F.col("progress.target").alias("target"),
        F.col("error.retryable").alias("retryable"),
        F.coalesce("error.detail", "violation").alias("detail"),
    )


def _final_row(job, seq, kind, job_id, collected, retryable, detail) -> tuple:
    if kind == "done":
        outcome, status = ("complete", 200) if collected else ("error", 404)
    elif kind == "error":
        outcome, status = "error", 504 if retryable else 502
    elif kind == "violation":
        outcome, status = "error", 502
    else:
        outcome, status = "error", 504
    return (job, seq, outcome, job_id, collected, None, status, detail)


def _known(value):
    return None if value is None or value != value else value


def _advance(silence_ms: int):
    columns = [part.strip().split()[0] for part in STREAM_OUTPUT.split(",")]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = key[0]
        collected, job_id, target, finished = state.get if state.exists else (0, None, None, False)
        if state.hasTimedOut:
            state.remove()
            if not finished:
                row = _final_row(job, None, None, job_id, collected, None, "silence")
                yield pd.DataFrame([row], columns=columns)
            return
        rows = []
        events = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for event in events.itertuples(index=False):
            if finished:
                break
            if event.kind == "review":
                collected += 1
            elif event.kind == "progress":
                job_id, target = event.job_id, _known(event.target)
            elif event.kind == "heartbeat":
                rows.append((job, event.seq, "heartbeat", job_id, collected, target, None, None))
                continue
            elif event.kind in ("done", "error", "violation"):
                job_id = event.job_id if event.job_id is not None else job_id
                rows.append(_final_row(job, event.seq, event.kind, job_id, collected, event.retryable, event.detail))
                finished = True
                continue
            else:
                continue
            rows.append((job, event.seq, "progress", job_id, collected, target, None, None))
        state.update((collected, job_id, target, finished))
        # Every event, heartbeats and unknown names included, restarts the silence clock. A finished job
        # keeps its state for one more period, so that late events cannot open it again.
        state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(rows, columns=columns)

    return advance


def follow_jobs(decoded: DataFrame, silence_seconds: int = C.SILENCE_SECONDS) -> DataFrame:
    """W3, W4, W6 and W8 on a stream: progress, heartbeat and exactly one final row per job.

    ``kind`` is ``progress``, ``heartbeat``, ``complete`` or ``error``. A job silent for
    ``silence_seconds`` ends with status 504. State per job is four scalars; reviews are not held.
    """
    from pyspark.sql.types import _parse_datatype_string

    output, state = _parse_datatype_string(STREAM_OUTPUT), _parse_datatype_string(STREAM_STATE)
    return (
        _flat_events(decoded)
        .groupBy("job")
        .applyInPandasWithState(
            _advance(silence_seconds * 1000), output, state, "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )


def job_reviews(decoded: DataFrame) -> DataFrame:
    """The reviews of every job as analysis rows, to be appended to the review store."""
    return forwardable(decoded).filter(F.col("review").isNotNull()).select(
        "job", F.col("seq").alias("row_no"), "review.platform", "review.product_id", "review.review_id",
        "review.content", F.col("review.written_at").alias("review_date"),
    )


def analyze_completed(store: DataFrame, outcomes: DataFrame, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score the whole collections of completed jobs, each exactly once.

    A job is one batch of one product. Its product key is scoped by the job, so that two collections of
    the same product are never compared with each other. A review delivered again counts once, as it first came.
    """
    complete = outcomes.filter(F.col("outcome") == "complete").select("job").distinct()
    keys = ["job", "platform", "product_id", "review_id"]
    first = store.groupBy(*keys).agg(F.min("row_no").alias("row_no"))
    rows = store.join(complete, "job", "left_semi").join(first, [*keys, "row_no"], "left_semi")
    scoped = rows.withColumn("_product", F.col("product_id")).withColumn(
        "product_id", F.concat_ws("\x1f", "job", "product_id")
    )
    flat = analyze(scoped.drop("job", "_product"))
    parts = F.split("product_id", "\x1f")
    return flat.withColumn("job", parts[0]).withColumn("product_id", parts[1])


def _scored_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Jobs that other micro-batches have scored: the scored rows are their own log of commits."""
    try:
        scored = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return scored.filter(F.col("batch_id") != batch_id).select("job").distinct()


def completed_sink(
    read_store: Callable[[], DataFrame], analyze: Callable[[DataFrame], DataFrame], path: str
) -> Callable[[DataFrame, int], None]:
    """W5 as a ``foreachBatch`` function: one folder per micro-batch, replaced when the batch is retried.

    A job that another batch has scored is left out, so a stream that is replayed under new batch numbers scores
    no job twice. A folder appears only when its write is committed.
    """

    def write(final_rows: DataFrame, batch_id: int) -> None:
        outcomes = final_rows.filter(F.col("kind") == "complete").select("job", F.lit("complete").alias("outcome"))
        before = _scored_before(final_rows.sparkSession, path, batch_id)
        if before is not None:
            outcomes = outcomes.join(before, "job", "left_anti")
        if outcomes.isEmpty():
            return
        analyze_completed(read_store(), outcomes, analyze).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def decoded_once(events: DataFrame) -> DataFrame:
    """Stored events decoded once and written, for the several passes of the batch twins."""
    return materialized(decode_events(events), "decoded")


def replay(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(progress, outcomes) of a stored event table."""
    decoded = decoded_once(events)
    return job_progress(decoded), job_outcomes(decoded)
