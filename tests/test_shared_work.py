"""Costly steps that several results need run once: features of several fits, joins that a guard and its result read."""

import pytest

from trustscore.operators import assembly, diagnosis_join, labelled, model, network_signal


def examples(spark):
    rows = [(i, f"{'great cheap offer' if i % 2 else 'the quiet blue chair'} number {i * 7919}", i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "row_no long, text string, label int")


def test_several_fits_share_features_and_agree_with_single_fits(spark):
    train = examples(spark)
    weights = labelled.require_weights(labelled.class_weights(train))
    both = model.fit_text_models(train, (0.01, 0.1), weights, features=1 << 10)
    assert both[0.01].stages[1] is both[0.1].stages[1]
    for regularization, fitted in both.items():
        single = model.fit_text_model(train, weights, regularization, features=1 << 10)
        assert fitted.stages[-1].coefficients.toArray() == pytest.approx(single.stages[-1].coefficients.toArray(), abs=1e-9)
        found = model.optimalities(fitted, train, weights, (0.01, 0.1))
        assert found[0.1] == pytest.approx(model.optimality(fitted, train, weights, 0.1))
        assert [model.is_optimal(found[r]) for r in (0.01, 0.1)] == [regularization == r for r in (0.01, 0.1)]


def test_guard_and_result_read_one_written_join(spark, monkeypatch):
    written = []
    plain = diagnosis_join.materialized
    monkeypatch.setattr(diagnosis_join, "materialized", lambda rows, name: written.append(name) or plain(rows, name))
    keyed = examples(spark).withColumn("norm_key", network_signal.text_key(network_signal.F.lower("text")))
    master = keyed.withColumn("master_id", network_signal.F.col("row_no").cast("string"))
    diagnoses = master.select("master_id", network_signal.F.lit("TEXT_WEAK").alias("diagnostic_type"), network_signal.F.col("text").alias("review"))
    attached = diagnosis_join.attach_by_id(keyed.withColumn("split", network_signal.F.lit("train")), master, diagnoses)
    assert written == ["attached"] and attached.count() == 20
    by_text = diagnoses.join(master.select("master_id", "norm_key"), "master_id")
    assert diagnosis_join.attach_by_text(keyed, by_text).count() == 20 and written == ["attached"] * 2
    with pytest.raises(diagnosis_join.UnsafeJoin):
        diagnosis_join.attach_by_text(keyed, by_text.filter("false"))


def test_master_rows_are_grouped_once_for_guard_and_result(spark, monkeypatch):
    written = []
    plain = diagnosis_join.materialized
    monkeypatch.setattr(diagnosis_join, "materialized", lambda rows, name: written.append(name) or plain(rows, name))
    columns = "row_no long, master_id string, review string, final_label string"
    rows = spark.createDataFrame([(i, str(i), f"text {i // 2} {'A' * (i % 2)}", "NORMAL") for i in range(8)], columns)
    prepared = labelled.prepare_examples(labelled.select_labelled(rows))
    retained = diagnosis_join.prepare_master_rows(rows, prepared)
    assert written == ["retained"] and retained.count() == 8
    other = prepared.withColumn("label", network_signal.F.when(network_signal.F.col("row_no") == 3, 1).otherwise(network_signal.F.col("label")))
    other = other.withColumn("text", network_signal.F.when(network_signal.F.col("row_no") == 5, "x").otherwise(network_signal.F.col("text"))).filter("row_no <> 6")
    found = {bytes(r.norm_key) for r in diagnosis_join._differing_keys(retained, other).collect()}
    assert found == {bytes(r.norm_key) for r in prepared.filter("row_no in (3, 5, 6)").collect()}
    with pytest.raises(diagnosis_join.UnsafeJoin, match="4 violations"):
        diagnosis_join.prepare_master_rows(rows, other)


def test_synthetic_rows_are_prepared_once_for_guard_and_result(spark, monkeypatch):
    calls = []
    plain = labelled.prepare_examples
    monkeypatch.setattr(labelled, "prepare_examples", lambda *args, **named: calls.append(args) or plain(*args, **named))
    columns = "row_no long, content string, final_label string, use_for_training string"
    synthetic = spark.createDataFrame([(1, "new text", "SUSPICIOUS", "YES"), (2, "Old  TEXT", "SUSPICIOUS", "yes ")], columns)
    keyed = spark.createDataFrame([("old text", 1, "test"), ("good", 0, "train")], "text string, label int, split string")
    splits = keyed.withColumn("norm_key", network_signal.text_key(network_signal.F.col("text")))
    for real in (splits, splits.drop("norm_key")):
        calls.clear()
        grown = assembly.augment_train(real, synthetic)
        assert len(calls) == 1 and sorted((r.text, r.split, r.synthetic) for r in grown.collect()) == [
            ("good", "train", False), ("new text", "train", True), ("old text", "test", False)
        ]
        audit = assembly.augment_audit(real, synthetic).first()
        assert (audit.augmentation_used_after_deduplication, audit.augmentation_added_to_train, audit.train_after) == (2, 1, 2)
