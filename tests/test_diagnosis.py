import random
import time
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trustscore import constants as C
from trustscore.functions.repetition import block_repetition
from trustscore.operators import diagnosis


def scan(tokens):
    """Direct reading of the rule: every block size, every start."""
    triple = covering = False
    n = len(tokens)
    for size in range(1, n // 2 + 1):
        for start in range(n - 2 * size + 1):
            block, repeats = tokens[start:start + size], 1
            while tokens[start + repeats * size:start + (repeats + 1) * size] == block:
                repeats += 1
            triple |= repeats >= 3 and len("".join(block)) >= 2
            covering |= repeats >= 2 and size >= 4 and repeats * size / n >= 0.8
    return triple, covering


def test_block_repetition_of_a_million_tokens_over_two_symbols():
    """Thue-Morse has no block three times in a row; every cheap shortcut by equal symbols fails on it."""
    word = ["a", "b"]
    while len(word) < 1 << 20:
        word += ["b" if token == "a" else "a" for token in word]
    started = time.time()
    assert block_repetition(word) == (False, False)
    assert time.time() - started < 60
    assert block_repetition(word[: 1 << 16] * 2) == (False, True)
    assert block_repetition(word[: 1 << 12] * 3)[0]


def test_block_repetition_against_a_scan():
    rng = random.Random(3)
    for _ in range(4000):
        kind = rng.random()
        words = ["a", "b", "cc", "dd"][: rng.randint(1, 4)]
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 14))]
        if kind < 0.5:
            block = [rng.choice("abcdefg") for _ in range(rng.randint(1, 6))]
            tokens = tokens[: rng.randint(0, 4)] + block * rng.randint(1, 4) + tokens[:2]
        assert block_repetition(tokens) == scan(tokens), tokens


def flags(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_no int, review string")
    return [(r.abnormal_repetition, r.clear_repetition) for r in diagnosis.repetition_flags(frame).orderBy("row_no").collect()]


def test_repetition_rules(spark):
    found = flags(spark, "Good. Good! good?", "Nice one. Nice one. Nice one.", "Line\nline\nLINE", "x x x", "a b c d a b c d", "", None, "좋은 제품 좋은 제품 좋은 제품")
    assert found[0] == (True, True)  # tokens repeat
    assert found[1] == (True, True)
    assert found[2] == (True, True)
    assert found[3] == (False, False)
    assert found[4] == (True, False)
    assert found[5] == found[6] == (False, False)
    assert found[7] == (True, True)
    # Sentences apart from each other: case matters only for G1, line ends only for G2.
    spread = "Same words here. one. Same words here. two. same words here. three"
    assert flags(spark, spread, "Same words here\none\nSame words here\ntwo\nSame words here") == [(False, True), (False, True)]


def typed(spark, **values):
    row = {"review": "", "collection_reason": "", C.NOTE_COLUMN: "", **values}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))
    return diagnosis.classify_reason(frame).first().diagnostic_type


def test_reason_types(spark):
    note = lambda value, **more: typed(spark, **{C.NOTE_COLUMN: value}, **more)
    assert note("다른 리뷰와 유사도 높음", review="반복 반복 반복") == "NETWORK_STRONG"
    assert note("", review="반복 반복 반복") == "TEXT_STRONG"
    assert note("상세 페이지 문체") == "TEXT_STRONG"
    assert note("상세 페이지 문체", review="배송이 빨라요") == "TEXT_WEAK"
    assert note("상세 페이지 문체, 개인 경험 없음", review="배송이 빨라요") == "TEXT_STRONG"
    assert note("적극 추천, 후기성 부족") == "TEXT_STRONG"
    assert note("적극 추천") == "TEXT_WEAK"
    assert typed(spark, collection_reason="JACCARD") == "NETWORK_STRONG"
    assert typed(spark) == "TEXT_WEAK"


def patterns(spark, *rows):
    frame = spark.createDataFrame([(i, r, "", e) for i, (r, e) in enumerate(rows)], f"row_no int, review string, collection_reason string, `{C.NOTE_COLUMN}` string")
    return [r.p_text_pattern for r in diagnosis.classify_pattern(frame).orderBy("row_no").collect()]


def test_patterns(spark):
    found = patterns(
        spark,
        ("최고예요 최고예요 최고예요", ""),
        ("- 하나\n- 둘", ""),
        ("성분: 가 효능: 나 특징: 다", ""),
        ("★ 주요 성분 :\n\n히알루론산\n판테놀 5%\n세라마이드", ""),
        ("주요 성분\n히알루론산\n\n판테놀\n세라마이드", ""),
        ("주요 성분\n정말 좋아요\n판테놀\n세라마이드", ""),
        ("효능\n하나 둘\n특징\n가나 다\n라마\n바사", ""),
        ("히알루론산 함유, 피부 보습 케어에 도움을 줍니다", ""),
        ("고함량", "상품 설명 그대로"),
        ("고함량", ""),
        ("직접 사용해 봤는데 고함량 함유 피부 개선", "상품 설명"),
        ("무조건 사세요", ""),
        ("제가 사용 중인데 무조건 사세요", ""),
        ("그냥 그래요", ""),
    )
    assert found == ["REPETITION", "STRUCTURED_INFO", "STRUCTURED_INFO", "STRUCTURED_INFO", "AMBIGUOUS_TEXT_STRONG", "AMBIGUOUS_TEXT_STRONG",
                     "STRUCTURED_INFO", "PRODUCT_COPY", "PRODUCT_COPY", "AMBIGUOUS_TEXT_STRONG", "AMBIGUOUS_TEXT_STRONG", "PROMOTIONAL_CTA",
                     "AMBIGUOUS_TEXT_STRONG", "AMBIGUOUS_TEXT_STRONG"]


def test_expectations_summary_samples(spark):
    rows = spark.createDataFrame([(i, f"{i}.0", "TEXT_STRONG" if i < 7 else "TEXT_WEAK", "x" * 200) for i in range(8)],
                                 "row_no int, master_id string, diagnostic_type string, review string")
    expected = spark.createDataFrame([("1", "TEXT_STRONG"), ("7", "TEXT_STRONG"), ("99", "TEXT_WEAK")], "master_id string, expected string")
    failed = {r.master_id: r.observed for r in diagnosis.check_expectations(rows, expected, "diagnostic_type").collect()}
    assert failed == {"7": "TEXT_WEAK", "99": "MISSING"}
    with pytest.raises(ValueError, match="2 violations"):
        diagnosis.require_expectations(rows, expected, "diagnostic_type")
    summary = {r.diagnostic_type: (r.rows, r.percent) for r in diagnosis.type_summary(rows).collect()}
    assert summary == {"TEXT_STRONG": (7, 87.5), "TEXT_WEAK": (1, 12.5), "NETWORK_STRONG": (0, 0.0), "TOTAL": (8, 100.0)}
    picked = diagnosis.samples(rows).collect()
    assert Counter(r.diagnostic_type for r in picked) == {"TEXT_STRONG": 5, "TEXT_WEAK": 1} and all(len(r.review) == 180 for r in picked)
