"""The tiled network signal against a direct pairwise computation of the contract."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from trustscore.operators import network_signal, similarity_sums


def canonical(value):
    folded = unicodedata.normalize("NFKC", value or "").casefold()
    return "".join(ch for ch in folded if ch.isalnum())


def pair_evidence(contents, measure):
    texts = [canonical(c) for c in contents]
    grams = [Counter(t[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in texts]
    n = sum(1 for g in grams if g)
    df = Counter(term for g in grams for term in g)
    vectors = []
    for g in grams:
        v = {t: c * (1 + math.log((1 + n) / (1 + df[t]))) for t, c in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / norm for t, x in v.items()})
    result = []
    for i, a in enumerate(texts):
        sims = []
        for j, b in enumerate(texts):
            if i == j or len(a) < 10 or len(b) < 10:
                continue
            cosine = min(1.0, max(0.0, sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items())))
            ca, cb = (Counter({t: c for t, c in grams[k].items() if len(t) == 2}) for k in (i, j))
            dice = 2 * sum((ca & cb).values()) / (sum(ca.values()) + sum(cb.values()))
            sims.append(1.0 if a == b else {"hybrid": 0.4 * cosine + 0.6 * dice, "cosine": cosine, "dice": dice}[measure])
        result.append(sims)
    return result


def random_contents(rng, count):
    syllables = ["배송", "제품", "좋", "아요", "빠르", "고", "품질", "ab", "cd", "ﬁ", "ß", " ", "!", "一二"]
    contents = []
    for _ in range(count):
        kind = rng.random()
        if contents and kind < 0.25:
            contents.append(rng.choice(contents))
        elif contents and kind < 0.5:
            base = list(rng.choice(contents) or "x")
            base[rng.randrange(len(base))] = rng.choice(syllables)
            contents.append("".join(base))
        elif kind < 0.6:
            contents.append(rng.choice(["", "  ", None, "짧다", "x"]))
        else:
            contents.append("".join(rng.choice(syllables) for _ in range(rng.randint(3, 30))))
    return contents


@pytest.mark.parametrize("measure, tile_characters", [("hybrid", 400_000), ("hybrid", 60), ("cosine", 150), ("dice", 150)])
def test_tiles_give_the_pairwise_result(spark, measure, tile_characters):
    rng = random.Random(len(measure) + tile_characters)
    products = {"one": random_contents(rng, 40), "two": random_contents(rng, 15), "lonely": ["only one long review text here"]}
    rows = [(p, f"{p}{i}", c, i) for p, contents in products.items() for i, c in enumerate(contents)]
    frame = spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")
    found = {r.review_id: r for r in network_signal.network_signal(frame, measure, tile_characters).collect()}
    assert len(found) == len(rows)
    for product, contents in products.items():
        for i, sims in enumerate(pair_evidence(contents, measure)):
            row = found[f"{product}{i}"]
            assert row.compared_review_count == len(sims)
            if not sims:
                assert row.similarity_max is None and row.network_score is None
                continue
            top = sorted(sims, reverse=True)[:3]
            assert row.similarity_max == pytest.approx(max(sims), abs=1e-9)
            assert row.similarity_mean == pytest.approx(sum(sims) / len(sims), abs=1e-9)
            assert row.top3_mean_similarity == pytest.approx(sum(top) / len(top), abs=1e-9)
            assert row.similar_review_count == sum(s >= 0.85 for s in sims)


def test_targets_agree_with_the_whole_product(spark):
    rng = random.Random(5)
    contents = random_contents(rng, 30)
    frame = spark.createDataFrame(
        [("p", f"r{i}", c, i) for i, c in enumerate(contents)] + [("q", "alone", "a lonely review of some length", 99)],
        "product_id string, review_id string, content string, row_no long")
    targets = frame.select("product_id", "review_id")
    whole = {r.review_id: r for r in network_signal.network_signal(frame).collect()}
    single = {r.review_id: r for r in network_signal.target_signal(frame, targets).collect()}
    assert single.keys() == whole.keys()
    for key, row in whole.items():
        other = single[key]
        assert other.similar_review_count == row.similar_review_count and other.network_score == row.network_score
        assert other.compared_review_count == row.compared_review_count
        if row.similarity_max is not None:
            assert other.top3_mean_similarity == pytest.approx(row.top3_mean_similarity)
            assert other.similarity_mean == pytest.approx(row.similarity_mean)
    assert single["alone"].network_unavailable_reason == "no_comparison_reviews"


def test_sums_without_pairs_give_the_mean_of_all_pairs(spark):
    rng = random.Random(11)
    products = {"one": random_contents(rng, 60), "two": random_contents(rng, 20), "lonely": ["only one long review text here"], "copies": ["the same long text"] * 4}
    rows = [(p, f"{p}{i}", c, i) for p, contents in products.items() for i, c in enumerate(contents)]
    frame = spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")
    found = {r.review_id: r for r in similarity_sums.similarity_sums(frame).collect()}
    assert len(found) == len(rows)
    for product, contents in products.items():
        for i, sims in enumerate(pair_evidence(contents, "hybrid")):
            row = found[f"{product}{i}"]
            assert row.compared_review_count == len(sims)
            if sims:
                assert row.similarity_mean == pytest.approx(sum(sims) / len(sims), abs=1e-9)
            else:
                assert row.similarity_mean is None


def test_sums_of_many_short_reviews_of_one_product(spark):
    """Twenty thousand reviews of one product: two hundred million pairs, none of them formed."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows = [("p", f"r{i}", " ".join(rng.choices(words, k=rng.randint(3, 8))), i) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "product_id string, review_id string, content string, row_no long")
    compared = similarity_sums.similarity_sums(frame).selectExpr("min(compared_review_count)", "max(similarity_mean)").first()
    assert compared[0] in (0, 19_999) and 0 < compared[1] < 1
