import pytest
from pyspark.sql import functions as F

from trustscore.operators import assembly, diagnosis_join, evaluation, labelled
from trustscore.sources import readers, writers


def master(spark, *rows):
    return spark.createDataFrame([(i, f"{i}.0", *row) for i, row in enumerate(rows)],
                                 "row_no long, master_id string, review string, final_label string")


def examples(spark, normal, suspicious):
    rows = [(i, f"normal text {i}", 0) for i in range(normal)] + [(1000 + i, f"suspicious text {i}", 1) for i in range(suspicious)]
    return spark.createDataFrame(rows, "row_no long, text string, label int")


def test_select_dedup_conflict_audit(spark):
    rows = master(spark, (" Great  item ", "normal"), ("great item", "NORMAL"), ("Bad", "SUSPICIOUS"), ("bad", "Normal"),
                  ("unique", " suspicious "), ("skip", "UNCERTAIN"), ("  ", "NORMAL"), (None, "NORMAL"), ("GREAT item", "NORMAL"))
    selected = labelled.select_labelled(rows)
    assert [(r.text, r.label) for r in labelled.prepare_examples(selected).orderBy("row_no").collect()] == [("Great  item", 0), ("unique", 1)]
    audit = labelled.prep_audit(selected).first()
    assert (audit.raw_selected, audit.duplicate_rows_removed, audit.conflicting_groups_removed, audit.kept) == (6, 4, 1, 2)
    assert labelled.dedup_first(selected).count() == 3
    flagged = rows.withColumn("use", F.when(F.col("row_no") < 1, " yes ").otherwise("no"))
    assert labelled.select_labelled(flagged, flag_column="use").count() == 1


def test_split_sizes_and_stability(spark):
    splits = labelled.stratified_split(examples(spark, 20, 4))
    counts = {r.split: (r.NORMAL, r.SUSPICIOUS) for r in labelled.split_counts(splits).collect()}
    assert counts == {"train": (16, 2), "validation": (2, 1), "test": (2, 1)}
    again = labelled.stratified_split(examples(spark, 20, 4).repartition(7))
    key = lambda frame: sorted((r.text, r.split) for r in frame.collect())
    assert key(splits) == key(again)
    assert key(labelled.stratified_split(examples(spark, 20, 4), seed=7)) != key(splits)
    with pytest.raises(labelled.InsufficientData):
        labelled.stratified_split(examples(spark, 5, 2))
    sizes = {n: labelled.split_counts(labelled.stratified_split(examples(spark, n, 3))).filter("split = 'test'").first().NORMAL for n in (25, 35)}
    assert sizes == {25: 2, 35: 4}


def test_class_weights(spark):
    weights = {r.label: r.weight for r in labelled.class_weights(examples(spark, 8, 1)).collect()}
    assert weights == {0: 9 / 16, 1: 9 / 2}
    with pytest.raises(labelled.InsufficientData):
        labelled.require_weights(labelled.class_weights(examples(spark, 3, 0)))


def source_rows(spark, rows, *names):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "row_no long, " + ", ".join(f"{n} string" for n in names))


def test_assembly(spark, tmp_path):
    base = source_rows(spark, [("1", " keep ", "NORMAL"), ("2", "x", "SUSPICIOUS"), ("3", "  ", "NORMAL"), ("4", None, "NORMAL"), ("5", "y", "normal")], "master_id", "review", "final_label")
    approved = source_rows(spark, [(" ", "a", "SUSPICIOUS", " yes "), ("7", "b", "NORMAL", "YES"), ("8", "c", "NORMAL", "NO"), ("9", " ", "NORMAL", "YES"), ("10", "a", "SUSPICIOUS", "YES")],
                           "master_id", "review", "new_final_label", "use_for_training")
    sources = [assembly.Source("base", base, "REVIEW_MASTER", "review", "final_label", "master_id", False),
               assembly.Source("again", approved, "recheck", "review", "new_final_label", "master_id", True, "again.xlsx")]
    rows = {(r.source_set, r.source_id): r for r in assembly.assemble(sources).collect()}
    assert set(rows) == {("base", "1"), ("again", "recheck:2"), ("again", "7"), ("again", "10")}
    assert rows["base", "1"].content == " keep " and rows["again", "7"].source_note == "again.xlsx; sheet=recheck; row=3"
    audit = {r.source_set: r for r in assembly.assemble_audit(sources).collect()}
    assert (audit["base"].rows_read, audit["base"].NORMAL, audit["base"].empty_content_excluded) == (5, 1, 2)
    assert (audit["TOTAL"].output_rows, audit["TOTAL"].NORMAL, audit["TOTAL"].SUSPICIOUS) == (4, 2, 2)
    target = str(tmp_path / "out")
    writers.publish(assembly.assemble(sources), target)
    with pytest.raises(Exception):
        writers.publish(assembly.assemble(sources), target)
    with pytest.raises(ValueError):
        writers.publish(assembly.assemble(sources), target, inputs=(target + "/",))
    with pytest.raises(ValueError, match="use_for_training"):
        assembly.assemble([assembly.Source("b", base, "s", "review", "final_label", "master_id", True)])


def synthetic(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "row_no long, content string, final_label string, use_for_training string")


def test_augmentation(spark):
    splits = labelled.stratified_split(examples(spark, 10, 4))
    rows = synthetic(spark, ("new one", "SUSPICIOUS", "YES"), ("New  ONE", "SUSPICIOUS", "yes"), ("new two", " suspicious", "YES"),
                     ("Suspicious text 0", "SUSPICIOUS", "YES"), ("normal TEXT 3", "SUSPICIOUS", "YES"), ("unused", "SUSPICIOUS", "NO"), (None, "SUSPICIOUS", "YES"))
    grown = assembly.augment_train(splits, rows)
    assert {r.text for r in grown.filter("synthetic").collect()} == {"new one", "new two"}
    assert {r.split for r in grown.filter("synthetic").collect()} == {"train"}
    audit = assembly.augment_audit(splits, rows).first()
    assert tuple(audit)[:4] == (5, 4, 2, 2) and audit.train_after == audit.train_before + 2
    for bad, problem in ((synthetic(spark, ("a", "NORMAL", "NO"), ("b", "SUSPICIOUS", "YES")), "contains_normal"),
                         (synthetic(spark, ("a", "SUSPICIOUS", "NO")), "nothing_usable")):
        with pytest.raises(assembly.InvalidAugmentation, match=problem):
            assembly.augment_train(splits, bad)


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "label int, predicted int")
    m = evaluation.classification_metrics(rows).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 1, 1) and m.accuracy == m.f1 == m.suspicious_f1 == 0.5
    with pytest.raises(ValueError, match="empty"):
        evaluation.classification_metrics(rows.limit(0))
    with pytest.raises(ValueError, match="not_binary"):
        evaluation.classification_metrics(spark.createDataFrame([(2, 0)], rows.schema))


def test_sweep_and_selection(spark):
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "label int, probability double")
    sweep = evaluation.threshold_sweep(frame((0, .1), (0, .5), (1, .5), (1, .9)))
    at_half = sweep.filter("threshold = 0.5").first()
    assert (at_half.tn, at_half.fp, at_half.fn, at_half.tp) == (1, 1, 0, 2) and at_half.accuracy == .75 and at_half.suspicious_f1 == pytest.approx(.8)
    assert sweep.count() == 19
    assert evaluation.select_threshold(evaluation.threshold_sweep(frame((0, .1), (1, .9)))).first().threshold == 0.5
    scored = lambda *rows: spark.createDataFrame(list(rows), "threshold double, suspicious_f1 double, suspicious_recall double")
    assert evaluation.select_threshold(scored((.5, .8, 1.), (.1, .9, .1))).first().threshold == .1
    assert evaluation.select_threshold(scored((.5, .9, .2), (.1, .9, .3))).first().threshold == .1
    assert evaluation.select_threshold(scored((.3, .9, .3), (.6, .9, .3))).first().threshold == .6
    assert evaluation.select_threshold(scored((.75, .9, .3), (.25, .9, .3))).first().threshold == .25


def diagnoses(spark, *rows):
    return spark.createDataFrame([(i, m, r, "", "", t) for i, (m, r, t) in enumerate(rows)],
                                 "row_no long, master_id string, review string, collection_reason string, `재검수근거` string, diagnostic_type string")


def test_diagnosis_tables(spark):
    good = diagnoses(spark, ("1.0", " text ", "TEXT_WEAK "), ("2", "Text", "TEXT_STRONG"))
    assert {(r.master_id, r.review, r.diagnostic_type) for r in readers.load_diagnoses(good, 2).collect()} == {("1", "text", "TEXT_WEAK"), ("2", "Text", "TEXT_STRONG")}
    for bad in (diagnoses(spark, ("1", "a", "TEXT_WEAK"), ("1.0", "b", "TEXT_WEAK")), diagnoses(spark, (" ", "a", "TEXT_WEAK")), diagnoses(spark, ("1", "a", "OTHER"))):
        with pytest.raises(readers.InvalidTable):
            readers.load_diagnoses(bad)
    with pytest.raises(readers.InvalidTable, match="expected 3"):
        readers.load_diagnoses(good, 3)
    with pytest.raises(readers.InvalidTable, match="collection_reason"):
        readers.load_diagnoses(good.drop("collection_reason"))
    first = readers.load_diagnoses_by_text(good).collect()
    assert len(first) == 1 and first[0].master_id == "1.0" and first[0].rows == 2


def test_master_rows_and_attach(spark):
    rows = master(spark, ("alpha", "SUSPICIOUS"), ("Alpha ", "SUSPICIOUS"), ("beta", "NORMAL"), ("gamma", "SUSPICIOUS"), ("gamma", "NORMAL"))
    prepared = labelled.prepare_examples(labelled.select_labelled(rows))
    retained = diagnosis_join.prepare_master_rows(rows, prepared)
    assert {(r.master_id, r.text) for r in retained.collect()} == {("0", "alpha"), ("2", "beta")}
    with pytest.raises(diagnosis_join.UnsafeJoin, match="duplicate"):
        diagnosis_join.prepare_master_rows(rows.withColumn("master_id", F.lit("1")))
    with pytest.raises(diagnosis_join.UnsafeJoin):
        diagnosis_join.prepare_master_rows(rows, prepared.filter("label = 1"))
    splits = prepared.withColumn("split", F.lit("test"))
    attached = diagnosis_join.attach_by_id(splits, retained, readers.load_diagnoses(diagnoses(spark, ("0", "ALPHA", "TEXT_WEAK")))).collect()
    assert [(r.master_id, r.split, r.diagnostic_type) for r in attached] == [("0", "test", "TEXT_WEAK")]
    for table, problem in ((diagnoses(spark, ("9", "alpha", "TEXT_WEAK")), "no_diagnosis"), (diagnoses(spark, ("0", "other", "TEXT_WEAK")), "text_mismatch")):
        with pytest.raises(diagnosis_join.UnsafeJoin, match=problem):
            diagnosis_join.attach_by_id(splits, retained, readers.load_diagnoses(table))
    with pytest.raises(diagnosis_join.UnsafeJoin, match="several_splits"):
        diagnosis_join.attach_by_id(splits.union(splits), retained, readers.load_diagnoses(diagnoses(spark, ("0", "alpha", "TEXT_WEAK"))))
    with pytest.raises(diagnosis_join.UnsafeJoin):
        diagnosis_join.attach_by_text(splits, readers.load_diagnoses_by_text(diagnoses(spark, ("0", "other", "TEXT_WEAK"))))


def test_reports_by_type(spark):
    rows = spark.createDataFrame([("1", "test", "a", "TEXT_STRONG", .3), ("2", "test", "b", "TEXT_STRONG", .29), ("3", "train", "c", "TEXT_WEAK", .9)],
                                 "master_id string, split string, review string, diagnostic_type string, probability double")
    report = {(r.split, r.diagnostic_type): (r.total, r.detected, r.missed, r.recall) for r in evaluation.recall_by_type(rows).collect()}
    assert report["test", "TEXT_STRONG"] == (2, 1, 1, .5) and report["test", "TOTAL"] == (2, 1, 1, .5)
    assert report["test", "NETWORK_STRONG"] == (0, 0, 0, None) and len(report) == 8
    spread = {r.diagnostic_type: tuple(r)[1:] for r in evaluation.type_distribution(rows, rows).collect()}
    assert spread["TEXT_STRONG"] == (2, 2, 0, 0, 2) and spread["TOTAL"] == (3, 3, 1, 0, 2) and spread["NETWORK_STRONG"] == (0, 0, 0, 0, 0)
    details = {r.master_id: r for r in evaluation.text_strong_details(rows.withColumn("split", F.when(F.col("master_id") == "2", "train").otherwise(F.col("split")))).collect()}
    assert details["1"].prediction == "SUSPICIOUS" and details["2"].prediction is None and set(details) == {"1", "2"}
