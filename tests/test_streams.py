import json
import random

import pytest
from pyspark.sql import functions as F

from trustscore.plans.analysis import analyze_flat
from trustscore.schemas import JOB_EVENT
from trustscore.sources import readers, writers
from trustscore.streaming import events, jobs


def review(number, **more):
    return json.dumps({"platform": "web", "product_id": "p", "review_id": f"r{number}", "content": f"long enough review number {number}", "extra": 1, **more})


def table(spark, **by_job):
    rows = [(job, i, name, data) for job, items in by_job.items() for i, (name, data) in enumerate(items)]
    return spark.createDataFrame(rows, JOB_EVENT)


PROGRESS = ("progress", '{"job_id":"j","collected":9,"target":2}')
DONE = ("done", '{"job_id":"j","collected":2}')
JOBS = {
    "ok": [("heartbeat", "{}"), ("review", review(1)), PROGRESS, ("review", review(2)), DONE, ("review", review(3))],
    "empty": [DONE],
    "retry": [("review", review(1)), ("error", '{"job_id":"j","detail":"busy","retryable":true}')],
    "fail": [("error", '{"job_id":"j","detail":"no","retryable":false}'), DONE],
    "open": [("rate_limited", "x"), ("review", review(1))],
    "broken": [("review", review(1)), ("review", "not json"), DONE],
}


def test_decode_and_violations(spark):
    cases = [("review", review(1)), ("review", '{"platform":"web"}'), ("progress", '{"job_id":"j","collected":-1}'), ("progress", '{"job_id":"j","collected":0}'),
             ("done", "[]"), ("error", '{"job_id":"j","detail":"d"}'), ("heartbeat", "{}"), ("heartbeat", "x"), ("new_kind", "raw"), ("progress", '{"job_id":"j","collected":"many"}')]
    decoded = {r.seq: r for r in events.decode_events(table(spark, j=cases)).collect()}
    assert [decoded[i].violation is not None for i in range(len(cases))] == [False, True, True, False, True, True, False, True, False, True]
    assert decoded[0].review.review_id == "r1" and decoded[3].progress.target is None and decoded[8].unknown.data == "raw"
    frame = events.decode_events(table(spark, j=cases))
    assert {r.status for r in events.event_violations(frame).collect()} == {502}
    assert {r.event for r in events.forwardable(frame).collect()} == {"review", "progress", "heartbeat"}


EXPECTED = {"ok": ("complete", 200, 2), "empty": ("error", 404, 0), "retry": ("error", 504, 1), "fail": ("error", 502, 0), "open": ("error", 504, 1), "broken": ("error", 502, 1)}


def test_batch_twins(spark):
    progress, outcomes = jobs.replay(table(spark, **JOBS))
    assert {r.job: (r.outcome, r.status, r.collected) for r in outcomes.collect()} == EXPECTED
    steps = [(r.seq, r.job_id, r.collected, r.target) for r in progress.filter("job = 'ok'").orderBy("seq").collect()]
    assert steps == [(1, None, 1, None), (2, "j", 1, 2), (3, "j", 2, 2)]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    table(spark, **JOBS).write.parquet(source)
    stream = spark.readStream.schema(JOB_EVENT).parquet(source)
    run = (jobs.follow_jobs(events.decode_events(stream)).writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start(str(tmp_path / "out")))
    run.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    finals = {r.job: (r.kind, r.status, r.collected) for r in rows.filter("status is not null").collect()}
    assert finals == {job: value for job, value in EXPECTED.items() if job != "open"}
    progress, _ = jobs.replay(table(spark, **JOBS))
    columns = ["job", "seq", "job_id", "collected", "target"]
    key = lambda frame: sorted(map(tuple, frame.select(*columns).collect()), key=repr)
    assert key(rows.filter("kind = 'progress'")) == key(progress)
    assert rows.filter("kind = 'heartbeat'").count() == 1


def test_silence_ends_an_open_job(spark, tmp_path):
    source = str(tmp_path / "in")
    table(spark, open=JOBS["open"]).write.parquet(source)
    stream = spark.readStream.schema(JOB_EVENT).parquet(source)
    run = (jobs.follow_jobs(events.decode_events(stream), silence_seconds=1).writeStream.format("memory").queryName("silent_jobs")
           .outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    try:
        for _ in range(60):
            run.awaitTermination(1)
            if spark.sql("select * from silent_jobs where status = 504").count():
                break
        row = spark.sql("select * from silent_jobs where status = 504").first()
    finally:
        run.stop()
    assert row is not None and row.job == "open" and row.collected == 1 and row.detail == "silence"


def test_completed_jobs_are_scored_once(spark, tmp_path):
    decoded = events.decode_events(table(spark, **JOBS))
    store = jobs.job_reviews(decoded).filter("row_no < 4")
    sink = jobs.completed_sink(lambda: store, analyze_flat, str(tmp_path / "scored"))
    finals = jobs.job_outcomes(decoded).select("job", F.col("outcome").alias("kind"))
    sink(finals, 0)
    sink(finals, 0)  # a retried batch replaces its folder
    sink(finals, 7)  # a replay under another number scores nothing again
    scored = spark.read.parquet(str(tmp_path / "scored")).collect()
    assert {(r.job, r.review_id, r.product_id) for r in scored} == {("ok", "r1", "p"), ("ok", "r2", "p")} and len(scored) == 2
    assert all(r.network_score >= 0 for r in scored)


def test_redelivered_reviews(spark):
    decoded = events.decode_events(table(spark, j=[("review", review(1)), ("review", review(1)), ("heartbeat", "{}"), ("heartbeat", "{}"), ("review", review(2))]))
    assert sorted(r.seq for r in events.dedup_reviews(decoded).collect()) == [0, 2, 3, 4]


def test_silences_in_stored_events(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 1, 500), ("a", 2, 1101), ("a", 3, 5000), ("b", 0, 0), ("b", 1, 600)], "job string, seq long, at long")
    found = jobs.first_silences(rows.select("job", "seq", F.timestamp_seconds("at").alias("received_at"))).collect()
    assert [(r.job, r.last_seq, r.status) for r in found] == [("a", 1, 504)]


def spells_by_hand(rows, silence):
    found = []
    for job in {row[0] for row in rows}:
        spell = []
        for at, seq, name in sorted((at, seq, name) for j, seq, at, name in rows if j == job and at is not None) + [(None, None, None)]:
            if spell and (at is None or spell[-1][0] + silence < at):
                ended = any(e[2] == "done" for e in spell)
                found.append((job, spell[0][0], spell[-1][0], spell[-1][1], len(spell), None if ended else 504))
                spell = []
            spell.append((at, seq, name))
    return sorted(found, key=repr)


def spells_of(frame):
    seconds = [F.unix_seconds(name).alias(name) for name in ("started", "stopped")]
    return sorted(map(tuple, frame.select("job", *seconds, "last_seq", "events", "status").collect()), key=repr)


def test_activity_spells_in_batch_and_stream(spark, tmp_path):
    draw = random.Random(3)
    rows = [("a", 0, 0, "x"), ("a", 1, 600, "x"), ("a", 2, 1201, "done"), ("a", 3, 1201, "x"), (None, 0, 5, "x"), ("n", 0, None, "x")]
    for job in range(8):
        at = 0
        for seq in range(draw.randrange(1, 40)):
            at += draw.choice([0, 1, 30, 599, 600, 601, 602, 5000])
            rows.append((f"j{job}", seq, at, draw.choice(["x", "x", "x", "done"])))
    rows.append(("late", 0, 10_000_000, "x"))
    frame = spark.createDataFrame(rows, "job string, seq long, at long, event string").select(
        "job", "seq", "event", F.timestamp_seconds("at").alias("received_at")
    )
    ends = F.col("event") == "done"
    expected = spells_by_hand(rows, 600)
    assert spells_of(jobs.activity_spells(frame, 600, ends)) == expected
    assert jobs.activity_spells(frame.limit(0), 600).count() == 0
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")).withWatermark("received_at", "0 seconds")
    run = (jobs.activity_spells(stream, 600, ends).writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")))
    run.awaitTermination()
    assert spells_of(spark.read.parquet(str(tmp_path / "out"))) == [row for row in expected if row[0] != "late"]


def test_review_reader_and_responses(spark, tmp_path):
    path = tmp_path / "reviews.json"
    path.write_text("\n".join([review(1, rating=4.5, written_at="2026-08-01T10:00:00"), review(2, images=["i"]), '{"platform":"web","product_id":"p","review_id":"x"}']))
    good, rejected = readers.read_reviews(spark, str(path))
    assert {tuple(r.images) for r in good.collect()} == {(), ("i",)} and rejected.count() == 1 and "extra" not in good.columns
    flat = analyze_flat(good.withColumn("row_no", F.col("review_id").substr(2, 5).cast("long"))).cache()
    response = writers.to_product_response(flat, page_size=10).collect()
    assert len(response) == 1 and response[0].review_count == 2 and [r.review_id for r in response[0].results] == ["r1", "r2"]
    pages = writers.to_product_response(flat, page_size=1).orderBy("page").collect()
    assert [(p.page, p.results[0].review_id, p.review_count) for p in pages] == [(0, "r1", 2), (1, "r2", 2)]
    writers.write_product_responses(flat, str(tmp_path / "out"), 10)
    with pytest.raises(Exception):
        writers.write_product_responses(flat, str(tmp_path / "out"), 10)
    writers.publish(good, str(tmp_path / "set"), (str(path),))
    assert writers.read_published(spark, str(tmp_path / "set")).count() == 2
    (tmp_path / "half").mkdir()
    with pytest.raises(FileNotFoundError):
        writers.read_published(spark, str(tmp_path / "half"))
    with pytest.raises(ValueError):
        writers.publish(good, str(tmp_path / "x" / ".." / "set2"), (str(tmp_path / "set2"),))
    limited = readers.limit_per_product(flat, 1).collect()
    assert [r.review_id for r in limited] == ["r1"]
    for count in (0, 501, True):
        with pytest.raises(ValueError):
            readers.limit_per_product(flat, count)
    csv = tmp_path / "table.csv"
    csv.write_text("﻿master_id, review \n1,a\n", encoding="utf-8")
    assert readers.read_review_master(spark, str(csv)).columns == ["master_id", "review"]
