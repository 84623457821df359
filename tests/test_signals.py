from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trustscore.operators import behavior_signal, meta, network_signal, text_signal, validation
from trustscore.plans.analysis import analyze_flat, analyze_reviews, rejected_reviews

LONG = "정말 오래 사용해 본 뒤에 남기는 자세한 후기입니다"


def reviews(spark, *contents, product="p"):
    rows = [(product, f"r{i}", content, i) for i, content in enumerate(contents)]
    return spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")


def codes(items):
    return [item.code for item in items]


# --- text


def test_text_rules_golden(spark):
    row = text_signal.text_rules(reviews(spark, "최고 최고!!!")).first()
    assert (row.text_rule_score, row.character_count, row.exclamation_count) == (50.0, 8, 3)
    assert row.repeated_keywords == {"최고": 2}
    assert codes(row.text_reasons) == ["REPETITIVE_KEYWORD", "SHORT_REVIEW", "EXCESSIVE_EXCLAMATION"]
    assert row.text_reasons[0].message == "반복 표현 탐지: '최고' 2회"


def test_sentiment(spark):
    ruled = text_signal.text_rules(reviews(spark, LONG, LONG, LONG))
    table = spark.createDataFrame(
        [("r0", "available", 0.9, 2.0), ("r1", "unavailable", None, None)],
        "review_id string, status string, score double, magnitude double")
    rows = text_signal.with_sentiment(ruled, table).orderBy("row_no").collect()
    assert [r.text_rule_score for r in rows] == [95.0, 100.0, 100.0]
    assert codes(rows[0].text_reasons)[-1] == "OVERLY_POSITIVE_SENTIMENT" and not rows[1].text_reasons


def test_probability_to_score(spark):
    frame = spark.createDataFrame([(0.0,), (0.13,), (0.5,), (1.0,), (None,)], "suspicious_probability double")
    rows = text_signal.text_score(frame).collect()
    assert [r.text_score for r in rows] == [100, 87, 50, 0, None]
    assert [r.predicted_label for r in rows] == ["NORMAL", "NORMAL", "SUSPICIOUS", "SUSPICIOUS", None]
    bad = spark.createDataFrame([(-0.01,), (1.01,), (float("nan"),), (float("inf"),), (0.5,)], "suspicious_probability double")
    assert text_signal.probability_violations(bad).count() == 4
    with pytest.raises(ValueError):
        text_signal.text_score(frame, 1.5)


def test_score_texts_loads_a_predictor_and_skips_blank(spark):
    def load():
        return lambda texts: [0.25] * len(texts)

    rows = text_signal.score_texts(reviews(spark, "hello", "  ", None), load, batch_size=1).orderBy("row_no").collect()
    assert [r.suspicious_probability for r in rows] == [0.25, None, None] or [
        r.suspicious_probability == r.suspicious_probability and r.suspicious_probability for r in rows] == [0.25, False, False]


# --- behavior


def behavior(spark, **values):
    base = dict(user_id=None, review_date=None, verified_purchase=None, account_created_at=None, user_review_dates=None)
    base.update(values)
    frame = spark.createDataFrame(
        [tuple(base.values())],
        "user_id string, review_date timestamp, verified_purchase boolean, account_created_at timestamp, user_review_dates array<timestamp>")
    return behavior_signal.behavior_signal(frame).first()


DAY = datetime(2026, 8, 15, 12)


def test_behavior_unavailable(spark):
    row = behavior(spark)
    assert row.behavior_score is None and row.behavior_unavailable_reasons == ["insufficient_behavior_evidence"]
    assert behavior(spark, review_date=DAY).behavior_score is None


def test_behavior_scores(spark):
    assert behavior(spark, verified_purchase=True).behavior_score == 100
    row = behavior(spark, verified_purchase=False)
    assert row.behavior_score == 70 and codes(row.behavior_reasons) == ["PURCHASE_NOT_VERIFIED"]
    row = behavior(spark, review_date=DAY, account_created_at=datetime(2026, 8, 1))
    assert (row.account_age_days, row.behavior_score) == (14, 100)
    row = behavior(spark, review_date=DAY, account_created_at=datetime(2026, 8, 15, 23))
    assert row.behavior_score == 80 and codes(row.behavior_reasons) == ["NEW_ACCOUNT"]
    row = behavior(spark, review_date=DAY, account_created_at=datetime(2026, 8, 16))
    assert row.behavior_score is None and row.behavior_reasons == []
    assert row.behavior_unavailable_reasons == ["account_created_after_review", "insufficient_behavior_evidence"]


def test_same_day_count(spark):
    dates = [DAY, datetime(2026, 8, 15, 1), datetime(2026, 8, 14)]
    row = behavior(spark, review_date=DAY, user_id="u", user_review_dates=dates)
    assert (row.reviews_written_today, row.behavior_score) == (2, 100)
    assert behavior(spark, review_date=DAY, user_review_dates=dates).reviews_written_today is None
    assert behavior(spark, review_date=DAY, user_id="u", user_review_dates=dates[:1]).reviews_written_today is None
    row = behavior(spark, review_date=DAY, user_id="u", verified_purchase=False, user_review_dates=[DAY] * 3)
    assert row.behavior_score == pytest.approx((70 * 0.5 + 85 * 0.3) / 0.8)


def test_history_matches_array(spark):
    history = [("u", datetime(2026, 8, d)) for d in (1, 1, 1, 2)] + [("v", datetime(2026, 8, 1)), (None, datetime(2026, 8, 1))]
    table = spark.createDataFrame(history, "user_id string, review_date timestamp")
    rows = spark.createDataFrame(
        [(u, d, [h for k, h in history if k == u] if u else None) for u, d in
         [("u", datetime(2026, 8, 1)), ("u", datetime(2026, 8, 3)), ("v", datetime(2026, 8, 1)), (None, datetime(2026, 8, 1)), (" ", datetime(2026, 8, 1))]],
        "user_id string, review_date timestamp, user_review_dates array<timestamp>")
    from_array = behavior_signal.reviews_written_today(rows)
    from_table = behavior_signal.reviews_written_today_from_history(rows, table)
    key = lambda r: (str(r.user_id), r.review_date)
    assert [r.reviews_written_today for r in sorted(from_array.collect(), key=key)] == [
        r.reviews_written_today for r in sorted(from_table.collect(), key=key)]


# --- meta


def scores(spark, *rows):
    return spark.createDataFrame(list(rows), "text_score double, behavior_score double, network_score double")


def test_meta_goldens(spark):
    rows = meta.meta_score(scores(spark, (80., 60., 90.), (80., None, 70.), (72., None, None), (None, None, None))).collect()
    assert [r.rti for r in rows][0] == pytest.approx(76.0)
    assert rows[1].applied_weights == pytest.approx({"text": 0.5 / 0.7, "network": 0.2 / 0.7})
    assert rows[2].rti == 72.0 and rows[2].used_signals == ["text"] and rows[2].unavailable_signals == ["behavior", "network"]
    assert rows[3].rti is None and rows[3].level is None and rows[3].unavailable_reason == "no_available_signals"
    assert rows[3].applied_weights == {} and rows[3].base_weight_sum == 0


def test_levels_and_public_index(spark):
    levels = spark.createDataFrame([(39.99,), (40.0,), (69.99,), (70.0,), (None,)], "x double").select(meta.classify_rti(F.col("x")).alias("l"))
    assert [r.l for r in levels.collect()] == ["danger", "warn", "warn", "safe", None]
    rows = meta.rti_from_public(scores(spark, (85., -1., 76.), (85., 60., -1.), (-1., 60., 80.), (-1., -1., -1.))).collect()
    assert [r.rti for r in rows] == [82.4, 75.6, 68.0, -1.0]
    with pytest.raises(ValueError):
        meta.Weights(text=0)
    with pytest.raises(TypeError):
        meta.Weights(text=True)


def test_level_follows_rounded_index_only_in_the_flat_row(spark):
    scored = meta.meta_score(scores(spark, (69.96, None, None))).withColumn("review_id", F.lit("a"))
    assert scored.first().level == "warn"
    flat = meta.to_flat(scored).first()
    assert (flat.rti, flat.level) == (70.0, "safe")


def test_whole_pipeline_goldens(spark):
    same = "배송이 정말 빠르고 제품 품질도 아주 좋습니다 추천"
    frame = reviews(spark, same, same, "전혀 다른 내용으로 길게 적어 보는 세 번째 글이에요").withColumns({
        "suspicious_probability": F.lit(0.2), "user_id": F.lit("u"), "verified_purchase": F.lit(False),
        "review_date": F.lit(DAY), "account_created_at": F.lit(datetime(2026, 1, 1)), "user_review_dates": F.array(*[F.lit(DAY)] * 3)})
    rows = {r.review_id: r for r in analyze_reviews(frame).collect()}
    assert rows["r0"].behavior_score == pytest.approx(70 * .5 + 100 * .2 + 85 * .3)
    assert rows["r0"].network_score == 39.1 and rows["r2"].network_score == 100.0
    pair = {r.review_id: r for r in analyze_reviews(reviews(spark, same, same).withColumn("suspicious_probability", F.lit(0.0))).collect()}
    assert pair["r0"].network_score == 9.1 and pair["r0"].rti == pytest.approx(74.02857142857142)
    flat = analyze_flat(reviews(spark, LONG).withColumn("suspicious_probability", F.lit(0.13))).first()
    assert (flat.rti, flat.level, flat.text_score, flat.behavior_score, flat.network_score, flat.reasons) == (87.0, "safe", 87.0, -1.0, -1.0, [])
    contract = analyze_flat(frame)
    assert validation.validate_scores(contract).isEmpty() and validation.validate_contract(contract).isEmpty()


def test_integration_golden(spark):
    rows = meta.meta_score(scores(spark, (80., 76.5, 39.1))).withColumn("review_id", F.lit("a"))
    assert meta.to_flat(rows).first().rti == 70.8


def test_blank_content_has_no_text_signal(spark):
    row = analyze_reviews(reviews(spark, "  ").withColumn("suspicious_probability", F.lit(0.1))).first()
    assert row.text_score is None and row.text_reasons == [] and row.rti is None


# --- network


def network(spark, *contents, **options):
    return network_signal.network_signal(reviews(spark, *contents), **options).orderBy("row_no").collect()


PAIR = ("배송 빠르고 제품도 좋아요. 재구매할게요.", "배송도 빠르고 제품도 좋아요! 재구매 할게요.")


def test_equal_after_canonicalisation(spark):
    rows = network(spark, "배송 빠르고 제품도 좋아요", "배송빠르고 제품도, 좋아요!")
    assert [r.network_score for r in rows] == [9.1, 9.1]
    assert rows[0].similarity_max == 1.0 and rows[0].similar_review_count == 1
    assert codes(rows[0].network_reasons) == ["SIMILAR_REVIEW_PATTERN"]


def test_pair_below_threshold_and_with_short_third(spark):
    first = network(spark, *PAIR)[0]
    assert 0.84 < first.similarity_max < 0.85 and first.network_reasons == [] and first.similar_review_count == 0
    rows = network(spark, *PAIR, "좋아요")
    assert rows[2].network_score is None and rows[2].network_unavailable_reason == "similarity_unavailable"
    assert rows[0].compared_review_count == 1 and rows[0].similar_review_count == 1


def test_cluster_and_short_only(spark):
    rows = network(spark, *[LONG] * 6)
    assert {r.network_score for r in rows} == {1.2} and rows[0].similar_review_count == 5
    assert codes(rows[0].network_reasons) == ["SIMILAR_REVIEW_CLUSTER"]
    assert all(r.network_score is None for r in network(spark, *["좋아요"] * 5))
    scores_ = [network(spark, *[LONG] * n)[0].network_score for n in (2, 3, 6, 10)]
    assert scores_ == sorted(scores_, reverse=True) and all(0 <= s <= 100 for s in scores_)


def test_exact_match_and_user_similarity(spark):
    import pandas as pd

    frame = reviews(spark, "This is a LONG review", "this  is a long review", "another long review text", "short", "  ", "third unlike text here")

    def exact(left, right):
        norm = lambda s: s.str.strip().str.split().str.join(" ").str.casefold()
        return (norm(left) == norm(right)).astype(float)

    wanted = ["similar_review_count", "similarity_max", "similarity_mean", "top3_mean_similarity", "compared_review_count", "network_score", "network_unavailable_reason"]
    by_group = network_signal.exact_match_signal(frame).orderBy("row_no").select(*wanted).collect()
    for tile_characters in (400_000, 20):
        by_pairs = network_signal.user_similarity_signal(frame, exact, tile_characters).orderBy("row_no").select(*wanted).collect()
        assert by_group == by_pairs
    assert by_group[0].similarity_max == 1.0 and by_group[3].network_unavailable_reason == "insufficient_text_information"
    assert by_group[4].network_unavailable_reason == "no_comparison_reviews"
    skipped = network_signal.user_similarity_signal(frame, lambda l, r: pd.Series([None] * len(l), dtype=float)).first()
    assert skipped.network_score is None
    with pytest.raises(Exception, match="between 0 and 1"):
        network_signal.user_similarity_signal(frame, lambda l, r: pd.Series([2.0] * len(l))).collect()


@pytest.mark.parametrize("value, strong", [(0.8499, 0), (0.85, 1), (0.8501, 1)])
def test_strong_threshold(spark, value, strong):
    import pandas as pd

    frame = reviews(spark, "first long review text", "second long review text")
    row = network_signal.user_similarity_signal(frame, lambda l, r: pd.Series([value] * len(l))).first()
    assert row.similar_review_count == strong


# --- validation


def test_validation(spark):
    rows = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", " "), (" ", "b"), ("q", "c")], "product_id string, review_id string")
    found = {(r.review_id, r.violation) for r in validation.validate_inputs(rows, "p").collect()}
    assert {("a", "duplicate_review_id"), (" ", "blank_review_id"), ("b", "blank_product_id"), ("c", "foreign_product_id"), ("b", "foreign_product_id")} == found
    with pytest.raises(validation.ContractViolation):
        validation.require_valid(rows)


def test_invalid_reviews_are_reported_and_never_scored(spark):
    rows = [
        ("p", "a", "a fine long review text", 1, 0.2), ("p", "b", "another long review text", 2, 1.7), ("p", "c", "third text", 3, float("nan")),
        ("p", "d", "twice", 4, 0.1), ("p", "d", "twice", 5, 0.1), ("p", " ", "blank", 6, 0.1), (None, "e", "no product", 7, 0.1),
    ]
    frame = spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long, suspicious_probability double")
    found = {(r.product_id, r.review_id, r.violation) for r in rejected_reviews(frame).collect()}
    assert found == {
        ("p", "b", "invalid_probability"), ("p", "c", "invalid_probability"), ("p", "d", "duplicate_review_id"),
        ("p", " ", "blank_review_id"), (None, "e", "blank_product_id"),
    }
    flat = analyze_flat(frame).collect()
    assert [(r.review_id, r.text_score, r.level) for r in flat] == [("a", 80.0, "safe")]
    with pytest.raises(validation.ContractViolation, match="5 violations"):
        analyze_flat(frame, strict=True)
    scores = spark.createDataFrame([(float("nan"), None, None), (-70.0, None, None), (101.0, 50.0, None), (80.0, None, None)],
                                   "text_score double, behavior_score double, network_score double")
    got = [(r.rti, r.level, r.unavailable_reason) for r in meta.meta_score(scores).collect()]
    assert got == [(None, None, "invalid_score")] * 3 + [(80.0, "safe", None)]


def test_product_key(spark):
    one = spark.createDataFrame([("x", "1", "a", "text", DAY)], "platform string, product_id string, review_id string, content string, written_at timestamp")
    two = one.union(spark.createDataFrame([("y", "1", "b", "text", DAY)], one.schema))
    keyed = validation.resolve_product_key(one)
    row = validation.to_analysis_inputs(keyed).first()
    assert (row.product_id, row.review_id, row.review_date, row.user_id, row.verified_purchase) == ("x:1", "x:a", DAY, None, None)
    with pytest.raises(validation.ContractViolation, match="x:1"):
        validation.resolve_product_key(two)
    origins = validation.batch_origins(two.withColumn("batch", F.lit(1)), "batch").orderBy("origin").collect()
    assert [r.origin for r in origins] == ["x:1", "y:1"]
    assert {r.product_key for r in validation.resolve_product_key(two, "grouped").collect()} == {"grouped"}
    with pytest.raises(ValueError):
        validation.resolve_product_key(two, " ")
    with pytest.raises(ValueError):
        validation.resolve_product_key(one.limit(0))


def test_rows_to_inputs(spark):
    rows = spark.createDataFrame([(7, None, DAY)], "review_id int, content string, written_at timestamp")
    row = validation.to_inputs_from_rows(rows, "web", "p").first()
    assert (row.review_id, row.content, row.review_date) == ("7", "", DAY)
    kept = validation.to_inputs_from_rows(rows.withColumn("review_date", F.lit(None).cast("timestamp")), "web", "p").first()
    assert kept.review_date is None
    with pytest.raises(validation.ContractViolation):
        validation.to_inputs_from_rows(rows.withColumn("platform", F.lit("other")), "web", "p")


def test_contract_violations(spark):
    flat = spark.createDataFrame(
        [("ok", 70.0, "safe", 70.0, -1.0, -1.0), ("a", -1.0, None, 50.0, -1.0, -1.0), ("b", 50.0, "safe", 50.0, -1.0, -1.0), ("c", float("nan"), "safe", 101.0, -1.0, -1.0)],
        "review_id string, rti double, level string, text_score double, behavior_score double, network_score double")
    assert {(r.review_id, r.violation) for r in validation.validate_contract(flat).collect()} >= {("a", "rti_availability"), ("b", "level")}
    assert {(r.review_id, r.column) for r in validation.validate_scores(flat).collect()} == {("c", "rti"), ("c", "text_score")}
