from pyspark.sql import functions as F

from trustscore.llm import chat

EVENTS = "conv_id long, turn long, message long, seq long, kind string, role string, text string"


def formatted(spark, rows):
    frame = chat.format_chats(spark.createDataFrame(rows, EVENTS))
    read = frame.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("l"), "formatted", "segments")
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.l, r.formatted, r.segments) for r in read.collect()}


def test_fold_of_deltas_edits_regenerations_and_deletes(spark):
    rows = [
        (1, 0, 10, 0, "open", "user", None),
        (1, 0, 10, 2, "delta", None, "lo"),
        (1, 0, 10, 1, "delta", None, "hel"),
        (1, 0, 10, 1, "delta", None, "hel"),  # delivered twice
        (1, 1, 11, 3, "open", "assistant", None),
        (1, 1, 11, 4, "delta", None, "bad"),
        (1, 1, 11, 5, "regenerate", None, None),
        (1, 1, 11, 6, "delta", None, "good"),
        (1, 2, 12, 7, "open", "user", "typo"),
        (1, 2, 12, 8, "edit", None, "fixed"),
        (1, 3, 13, 9, "open", "assistant", "gone"),
        (1, 3, 13, 10, "delete", None, None),
        (2, 0, 20, 0, "open", None, "no role"),
    ]
    got = formatted(spark, rows)
    assert got[1][0] == [("user", "hello"), ("assistant", "good"), ("user", "fixed")]
    assert got[1][1] == "good"
    assert got[2][0] == [("", "no role")] and got[2][1] == ""


def test_interleaved_messages_and_late_deltas(spark):
    rows = [
        (1, 0, 10, 0, "open", "user", "a"),
        (1, 1, 11, 1, "open", "assistant", ""),
        (1, 0, 10, 2, "delta", None, "b"),
        (1, 1, 11, 3, "delta", None, "x"),
        (1, 2, 12, 4, "open", "user", "gone"),
        (1, 1, 11, 5, "delta", None, "y"),
        (1, 2, 12, 6, "delete", None, None),
        (1, 0, 10, 7, "edit", None, "c"),
        (1, 2, 12, 8, "delta", None, "was under way"),
        (1, 1, 11, 9, "delta", None, "z"),
        (1, 3, 13, 10, "open", "assistant", "first"),
        (1, 3, 13, 11, "delete", None, None),
        (1, 0, 10, 12, "delta", None, "d"),
        (1, 3, 13, 13, "regenerate", None, None),
        (1, 3, 13, 14, "delta", None, "second"),
        (2, 0, 20, None, "open", "user", None),
        (2, 0, 20, 1, None, None, "no kind"),
    ]
    got = formatted(spark, rows)
    assert got[1][0] == [("user", "cd"), ("assistant", "xyz"), ("assistant", "second")]
    assert got[2][0] == [("user", "no kind")]


def test_event_log_has_every_kind_and_folds_back(spark):
    texts = ["", "a", "ab", "abc", "abcd é日本", "x" * 10_001, None]
    rows = [(n % 2, n, "assistant" if n % 3 else "user", text) for n, text in enumerate(texts)] + [(0, 2**62, "assistant", "far")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.events_of(frame)
    log = events.where("conv_id = 0").orderBy("seq").collect()
    assert {e.kind for e in log} == {"open", "delta", "edit", "regenerate", "delete"}
    close = chat.events_of(spark.createDataFrame([(0, 0, "user", "q w e"), (0, 1, "assistant", "r t y")], frame.schema)).orderBy("seq").collect()
    turns = [e.turn for e in close]
    assert turns != sorted(turns)  # messages interleave
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(events).collect()}
    assert got == {(c, t): (role, text or "") for c, t, role, text in rows}


def test_control_strings_survive_and_never_act(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|><|start|>user<|text|>x", "<\\|", "\\<[\\[", "a\nb", "", "<\\", "[", "\\n"]
    rows = [(5, i, i, 0, "open", "assistant" if i % 2 else "us<|text|>er", text) for i, text in enumerate(nasty)]
    turns, loss, whole, segments = formatted(spark, rows)[5]
    assert [t for _, t in turns] == nasty and turns[0][0] == "us<|text|>er"
    assert loss == "".join(nasty[1::2])
    assert whole == "".join(s.text for s in segments)
    for mark in ("</s>", "[INST]", "[/INST]"):
        assert mark not in whole
    assert whole.count(chat.END) == len(nasty)


def test_tables_with_nulls_ties_repeats_and_clashes(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (1, 0, "user", "a"), (None, 2, None, "x"), (None, 1, "assistant", "y")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int")
    out = chat.format_chats(chat.events_of(frame))
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None] == [("assistant", "y"), ("", "x")]
    assert chat.format_chats(chat.events_of(frame.limit(0))).count() == 0
