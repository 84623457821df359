import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from llm.helpers import corpus, documents, words
from llm.test_recipes import norm
from llm.test_near_copies import jaccard
from trustscore.llm import mixing


def written(spark, tmp_path, rows, labels):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_a_plain_pipeline(spark, tmp_path):
    rows = corpus(count=50)
    folder = written(spark, tmp_path, rows, [(r[0], 1, 0) for r in rows])
    # With so few labels no cutoff is admissible: the base rules decide.
    good = []
    for row in rows:
        w = words(row[1])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)} if len(w) < 3000 else set()
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            good.append(row)
    single = {}
    for row in sorted(good):
        single.setdefault(norm(row[1]), row)
    single = list(single.values())
    group = {row[0]: row[0] for row in single}
    for row in single:
        for other in single:
            if jaccard(row[1], other[1]) >= 0.8:
                one, two = sorted((group[row[0]], group[other[0]]))
                group = {doc: one if head == two else head for doc, head in group.items()}
    left = [r for r in single if group[r[0]] == r[0]]
    assert len(left) < len(single)
    mixed = [tuple(r) for r in mixing.mixed(documents(spark, left)).select("doc_id", "text").collect()]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    wanted = sorted((doc, library.encode(text, add_special_tokens=False).ids) for doc, text in mixed)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == wanted
    assert all(r.round_trip and 4 * r.n_tokens == len(r.ids) for r in got)


def test_all_but_the_last_stage_keep_the_columns(spark, tmp_path):
    folder = written(spark, tmp_path, corpus(count=20), [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
