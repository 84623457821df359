from trustscore.operators import validation


def test_nulls_and_nans_break_the_contract(spark):
    nan = float("nan")
    rows = [
        ("good", 70.0, 80.0, -1.0, -1.0, "safe"),
        ("missing", -1.0, -1.0, -1.0, -1.0, None),
        ("nan_index", nan, 80.0, -1.0, -1.0, "safe"),
        ("null_index", None, -1.0, -1.0, -1.0, None),
        ("null_signal", 70.0, 80.0, -1.0, None, "safe"),
        ("nan_signal", -1.0, -1.0, nan, -1.0, None),
        ("wrong_level", 70.0, 80.0, -1.0, -1.0, None),
    ]
    names = "review_id string, rti double, text_score double, behavior_score double, network_score double, level string"
    got = sorted(tuple(r) for r in validation.validate_contract(spark.createDataFrame(rows, names)).collect())
    assert got == [
        ("nan_index", "level"),
        ("nan_index", "rti_availability"),
        ("nan_signal", "rti_availability"),
        ("null_index", "rti_availability"),
        ("null_signal", "rti_availability"),
        ("wrong_level", "level"),
    ]
