import hashlib
import zlib

from pyspark.sql import functions as F

from llm.helpers import corpus, documents
from trustscore.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = []
    for value in (row[0], row[3], row[2], row[4], row[1]):
        parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha("".join(parts))


def tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, at):
    path = []
    for level in levels[:-1]:
        low = at - at % 3
        path.append(("".join(level[low:at]), "".join(level[at + 1 : low + 3])))
        at //= 3
    return path


def expected(rows):
    sources = sorted({row[3] for row in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, held = {}, {}
    for source in sources:
        held[source] = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[source] = tree([leaf(r) for r in held[source]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for number, source in enumerate(sources):
        for at, row in enumerate(held[source]):
            path = siblings(trees[source], at) + siblings(top, number)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
            own = leaf((row[0], row[1].replace("\n", ""), *row[2:])) if tampered else leaf(row)
            for before, after in path:
                own = sha(before + own + after)
            proof = sha("".join(before + after for before, after in path))
            out.append((row[0], leaf(row), trees[source][-1][0], top[-1][0], proof, own))
    return out


def prove(frame):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    proved = manifest.prove(frame, F.replace("text", F.lit("\n"), F.lit("")), tampered)
    columns = ("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256), "folded_root")
    return [tuple(row) for row in proved.select(*columns).collect()]


def test_every_digest_equals_a_plain_tree(spark):
    rows = corpus(count=70) + [(None, "lost", "en", "a", 4), (None, "lost", "en", "a", 4), (7, "same id", None, "a", None), (7, "same id", None, "a", None)]
    wanted = expected(rows)
    assert sorted(prove(documents(spark, rows)), key=repr) == sorted(wanted, key=repr)
    assert any(own != row[3] for row in wanted for own in row[5:]) and any(row[5] == row[3] for row in wanted)


def test_single_rows_and_single_sources(spark):
    for rows in ([(4, "x\ny", "en", "s", 3)], [(i, f"t {i}", "en", "s", 1) for i in range(28)], [(i, None, None, f"s{i}", None) for i in range(10)]):
        assert sorted(prove(documents(spark, rows)), key=repr) == sorted(expected(rows), key=repr)


def test_extra_columns_and_an_empty_table(spark):
    assert prove(documents(spark, [])) == []
    rows = [(i, f"a\n{i}", "en", "s", 3) for i in range(5)]
    clashing = documents(spark, rows).selectExpr("*", "'x' as tree", "1 as at", "2 as n", "3 as part", "4 as digest", "5 as row")
    assert sorted(prove(clashing), key=repr) == sorted(expected(rows), key=repr)


def test_only_changed_rows_fail(spark):
    rows = [(i, f"line\n{i}" if i % 3 else f"line {i}", "en", f"s{i % 4}", 6) for i in range(60)]
    for row in prove(documents(spark, rows)):
        changed = zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[0] % 3 != 0
        assert (row[5] == row[3]) == (not changed)
