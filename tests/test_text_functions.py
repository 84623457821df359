import random
from collections import Counter
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from trustscore.functions import grams, numbers, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


def test_plain_characters_fold_like_python():
    plain = re.compile(f"[{text.PLAIN_CHARACTERS}]")
    for code in range(0x110000):
        char = chr(code)
        if plain.match(char):
            expected = char.lower().replace("ß", "ss")
            assert char.casefold() == expected, hex(code)
            assert unicodedata.normalize("NFKC", char).casefold() == expected, hex(code)


SAMPLES = [
    " 배송  빠르고 제품도 좋아요!!! ", "Straße ﬁne Ⅷ ｆｕｌｌ", "İstanbul ΣΑΣ", "a b c\x1dd", "étude", "½ x² ①",
    "𝒜𝓫𝓬 𠀀", "", "   ", "Ab\n\tC", "ŉ ǰ", "ｶﾞ",
]


@pytest.fixture(scope="module")
def sample_rows(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, x string")


def test_normalize_and_canonical_match_python(sample_rows):
    rows = sample_rows.select("i", text.normalize_text("x").alias("n"), text.canonical_text("x").alias("c"),
                              text.collapse_spaces("x").alias("s"), F.length(text.strip("x")).alias("l")).collect()
    for row in rows:
        value = SAMPLES[row.i]
        assert row.n == re.sub(r"\s+", " ", value).strip().casefold()
        folded = unicodedata.normalize("NFKC", value).casefold()
        assert row.c == "".join(ch for ch in folded if ch.isalnum())
        assert row.s == re.sub(r"\s+", " ", value).strip()
        assert row.l == len(value.strip())


def test_canonical_golden(spark):
    assert one(spark, " 배송  빠르고 제품도 좋아요!!! ", text.canonical_text("x")) == "배송빠르고제품도좋아요"


def test_ngrams_both_ways(sample_rows):
    rows = (sample_rows.withColumn("c", text.canonical_text("x"))
            .select("i", "c", text.ngrams(text.characters("c")).alias("g")).collect())
    for row in rows:
        expected = sorted(row.c[i:i + n] for n in (2, 3, 4) for i in range(len(row.c) - n + 1))
        assert sorted(row.g) == expected
        where, found, counts = grams.count_grams([row.c, row.c + "x"], (2, 3, 4))
        repeated = sorted(g for r, g, c in zip(where, found.to_pylist(), counts) if r == 0 for _ in range(c))
        assert repeated == expected


def test_wide_alphabet_counts_the_same():
    rng = random.Random(1)
    letters = [chr(c) for c in (*range(0xAC00, 0xAC00 + 4000), *range(0x4E00, 0x4E00 + 4000), 0x1F600, 97)]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)] + ["", "ab", "aaa"]
    expected = Counter(
        (row, text[i:i + n]) for row, text in enumerate(texts) for n in (1, 2, 4) for i in range(len(text) - n + 1)
    )
    rows, found, counts = grams.count_grams(texts, (1, 2, 4))
    assert dict(zip(zip(rows.tolist(), found.to_pylist()), counts.tolist())) == dict(expected)


def test_rounding_is_pythons(spark):
    rng = random.Random(2)
    values = [rng.uniform(0, 100) for _ in range(3000)] + [k / 20 for k in range(2001)] + [k / 100 for k in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x", numbers.round_one(F.col("x")).alias("one"), numbers.round_whole(F.col("x")).alias("whole")).collect()
    assert all(r.one == round(r.x, 1) and r.whole == round(r.x) for r in rows)


@pytest.mark.parametrize("value, expected", [("472.0", "472"), (" 12 ", "12"), ("a.0", "a.0"), ("1.5", "1.5"), (None, "")])
def test_master_id(spark, value, expected):
    assert one(spark, value, text.master_id("x")) == expected


def test_abbreviate(spark):
    assert one(spark, "a" * 181, text.abbreviate("x")) == "a" * 179 + "…"
    assert one(spark, "a" * 180, text.abbreviate("x")) == "a" * 180
    assert one(spark, "a  b", text.abbreviate("x", collapse=True)) == "a b"


def test_patterns_follow_python(spark):
    from trustscore import constants as C

    texts = ["직접 사용해 보니 좋아요", "JACCARD 점수", "성분\n나열 중심", "색상이 정말 예쁘네요", "제품은 매우 좋은 제품입니다", "상세 페이지",
             "다른 사람의 리뷰", "크림입니다", "무조건 사세요", ""]
    families = [C.NETWORK_EVIDENCE, C.PRODUCT_COPY_EVIDENCE, C.EXPERIENCE_EVIDENCE, C.PERSONAL_EXPERIENCE,
                C.PRODUCT_COPY_SIGNALS, C.PROMOTIONAL_CTA, C.PROMOTION_EVIDENCE]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
        "x", *[text.matching_count("x", family).alias(f"f{i}") for i, family in enumerate(families)]).collect()
    for row in rows:
        for i, family in enumerate(families):
            assert row[f"f{i}"] == sum(bool(re.search(p, row.x, re.IGNORECASE)) for p in family), (row.x, i)
