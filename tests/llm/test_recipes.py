import hashlib
import re

import pytest

from llm.helpers import DOCUMENTS, corpus, documents
from trustscore.llm import recipes


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append(doc)
    out, kept = [], set()
    for doc, text in rows:
        members = groups[norm(text)]
        known = [d for d in members if d is not None]
        keep = min(known) if known else None
        stays = doc == keep and norm(text) not in kept
        if stays:
            kept.add(norm(text))
        out.append((doc, keep, len(members), stays, hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_match_a_plain_grouping(spark):
    rows = [r[:2] for r in corpus()] + [(7, "tie"), (7, "tie"), (None, "tie"), (None, "alone"), (300, " lead"), (301, "\nlead")]
    got = recipes.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)


def test_dropping_copies_keeps_all_columns(spark):
    rows = corpus()
    kept = recipes.drop_exact_copies(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    wanted = [(doc,) for doc, _, _, stays, _ in brute([r[:2] for r in rows]) if stays]
    assert sorted(kept.select("doc_id").collect()) == sorted(wanted)
    named = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], "doc_id long, text string, _row long")
    assert [tuple(r) for r in recipes.drop_exact_copies(named).collect()] == [(1, "a", 5)]


def test_empty_table(spark):
    assert recipes.exact_groups(documents(spark, [])).count() == 0
    assert recipes.drop_exact_copies(documents(spark, [])).schema.simpleString() == spark.createDataFrame([], DOCUMENTS).schema.simpleString()


def test_chunks_follow_content_and_cover_the_text():
    base = "".join(chr(97 + i * 7919 % 26) for i in range(60_000)).encode()
    texts = [base, b"prefix " + base, b"", b"\0" * 30_000]
    ends = recipes.cut_points(texts)
    for text, own in zip(texts, ends):
        assert own == sorted(set(own)) and (own[-1] if own else 0) == len(text)
        assert all(b - a <= recipes.LONGEST_CHUNK for a, b in zip([0, *own], own))
    assert recipes.cut_points([base]) == [ends[0]]


def test_colliding_names_get_variants(spark, monkeypatch):
    # Names of one bit collide all the time; verified digests must keep different texts apart.
    real = recipes._recipes

    def colliding(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in real(batches):
            names = batch.column("names")
            flat = pc.bit_wise_and(names.values, pa.scalar(1, pa.int64()))
            yield batch.set_column(3, "names", pa.ListArray.from_arrays(names.offsets, flat))

    monkeypatch.setattr(recipes, "_recipes", colliding)
    rows = [r[:2] for r in corpus()]
    got = recipes.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)


@pytest.mark.parametrize("text", [None, "", " ", "\t\n", " a", "a ", "a  b", "\x1c a"])
def test_normalisation(text):
    assert recipes.normalised(text) == norm(text).encode()
