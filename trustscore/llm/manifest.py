"""Merkle manifest of a table: sibling-shift self-joins build a tree per source, and a tree over the sources.

A leaf is the digest of a row's fields. Leaves of a source stand in the order of ``doc_id``; every ``ARITY``
consecutive nodes become one parent, until one node, the subroot, remains; the subroots in order of source
become the root in the same way. On every level each node meets the nodes at its computed sibling indices by one
equijoin per slot offset, and the rows in slot zero emit the parents. Going down again, each node takes its
parent's path and puts its own siblings in front, so a leaf ends with its whole inclusion proof.

Every join is on (tree, index), which is unique, so a source of any size spreads over all tasks. Places come from
range partitions, counted once; digests move between tasks, texts never. A level is a written table, so a lost
executor costs a part of one level. The number of levels is the only value that reaches the driver but the root.

Defined cases: null fields are ``-``; a null source is a source of its own and the first; a null doc_id stands
last in its source and is never tampered with; rows of equal doc_id stand in the order of their leaves, equal
rows are leaves of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustscore.session import materialized

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "cast(array() as array<struct<before: binary, after: binary>>)"


def _digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def shown(digest: Column) -> Column:
    """A digest as lowercase hexadecimal text, the form in which it is hashed again."""
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and the value, or ``-`` for null."""
    return _digest(F.concat(*[_field(values[name]) for name in FIELDS]))


def _placed(leaves: DataFrame) -> DataFrame:
    """Every leaf with its place ``at`` in its tree (from zero) and the number ``n`` of leaves there."""
    ranged = materialized(
        leaves.repartitionByRange(F.col("tree"), F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("row")).withColumn(
            "part", F.spark_partition_id()
        ),
        "leaf-ranges",
    )
    tree = Window.partitionBy("tree")
    parts = (
        ranged.groupBy("tree", "part")
        .agg(F.count("*").alias("held"))
        .withColumn("n", F.sum("held").over(tree))
        .withColumn("earlier", F.sum("held").over(tree.orderBy("part")) - F.col("held"))
        .drop("held")
    )
    inside = Window.partitionBy("tree", "part").orderBy(F.col("doc_id").asc_nulls_last(), "digest", "row")
    return (
        ranged.join(parts, ["tree", "part"])
        .withColumn("at", F.col("earlier") + F.row_number().over(inside) - 1)
        .drop("part", "earlier", "row")
    )


def _level(nodes: DataFrame) -> DataFrame:
    """Nodes (``tree, at, n, digest``, more) with the digests of their siblings ``before`` and ``after`` them."""
    slot = F.col("at") % ARITY
    for offset in range(1, ARITY):
        sought = F.col("at") - slot + (slot + offset) % ARITY
        others = nodes.select("tree", F.col("at").alias("sought"), F.col("digest").alias(f"sibling{offset}"))
        found = nodes if offset == 1 else joined
        joined = found.withColumn("sought", sought).join(others, ["tree", "sought"], "left").drop("sought")
    # A sibling in slot s stands at offset s - slot, counted round the run.
    by_slot = []
    for own in range(ARITY):
        ordered = [F.coalesce(f"sibling{(s - own) % ARITY}", F.lit(b"")) for s in range(ARITY) if s != own]
        by_slot.append((F.concat(F.lit(b""), *ordered[:own]), F.concat(F.lit(b""), *ordered[own:])))

    def chosen(side: int) -> Column:
        value = by_slot[0][side]
        for own in range(1, ARITY):
            value = F.when(slot == own, by_slot[own][side]).otherwise(value)
        return value

    return joined.select(*nodes.columns, chosen(0).alias("before"), chosen(1).alias("after"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """One written table per level, leaves first: ``tree, at, n, digest, before, after``; ``n`` is 1 for a root."""
    levels = [materialized(_level(nodes), "level0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // ARITY)
        nodes = levels[-1].where((F.col("n") > 1) & (F.col("at") % ARITY == 0)).select(
            "tree",
            F.expr(f"at div {ARITY}").alias("at"),
            F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"),
            _digest(F.concat(shown(F.col("digest")), shown(F.col("after")))).alias("digest"),
        )
        levels.append(materialized(_level(nodes), f"level{len(levels)}"))
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``tree, digest`` of the one node in which each tree ends."""
    found = [level.where("n = 1").select("tree", "digest") for level in levels]
    roots = found[0]
    for more in found[1:]:
        roots = roots.unionByName(more)
    return roots


def descend(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The nodes of the lowest level with ``path`` to the end of the proof and the digest ``subroot`` of their tree.

    ``above`` holds ``tree, subroot, path``: for each tree its root and the path from there on. Without it the
    proofs end at the roots of the trees.
    """
    paths = None
    for level in reversed(levels):
        ends = level.where("n = 1")
        if above is None:
            here = ends.select("*", F.col("digest").alias("subroot"), F.expr(_NO_PATH).alias("path"))
        else:
            here = ends.join(above, "tree")
        if paths is not None:
            parents = paths.select("tree", F.col("at").alias("parent"), "subroot", "path")
            step = F.array(F.struct("before", "after"))
            below = (
                level.where("n > 1")
                .withColumn("parent", F.expr(f"at div {ARITY}"))
                .join(parents, ["tree", "parent"])
                .withColumn("path", F.concat(step, "path"))
                .drop("parent")
            )
            here = here.unionByName(below)
        paths = here
    return paths


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a digest (hexadecimal) and its path."""
    return F.aggregate(
        path, start, lambda own, step: F.sha2(F.concat(shown(step["before"]), own, shown(step["after"])), 256)
    )


def proof_text(path: Column) -> Column:
    """All siblings of a path as hexadecimal text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: shown(F.concat(step["before"], step["after"]))), "")


def prove(documents: DataFrame, tampered_text: Column, tampered: Column) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root``, its ``path``, and ``folded_root`` of the row as found.

    ``tampered`` marks the rows whose text is later found as ``tampered_text`` (both over ``doc_id`` and ``text``);
    the others are found as they were. Digests are lowercase hexadecimal; a path is an array of the siblings
    ``before`` and ``after`` the node, from the leaf's level to the root's.
    """
    rows = documents.select(*FIELDS)
    values = {name: F.col(name) for name in FIELDS}
    found = F.when(tampered & tampered_text.isNotNull(), leaf_digest(values | {"text": tampered_text}))
    leaves = materialized(
        rows.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"),
            leaf_digest(values).alias("digest"),
            found.alias("found"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    levels = climb(_placed(leaves))
    # "-" (no source) sorts before "=", so trees order as their sources do.
    sources = roots_of(levels).select(
        F.lit("").alias("tree"),
        F.col("tree").alias("doc_id"),
        "digest",
        F.monotonically_increasing_id().alias("row"),
    )
    upper = climb(_placed(sources))
    end = roots_of(upper).first()
    root = shown(F.lit(bytes(end["digest"]) if end else None).cast("binary"))
    above = materialized(
        descend(upper).select(F.col("doc_id").alias("tree"), F.col("digest").alias("subroot"), "path"), "subroots"
    )
    proved = descend(levels, above)
    return proved.select(
        "doc_id",
        shown(F.col("digest")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        "path",
        fold(shown(F.coalesce("found", "digest")), F.col("path")).alias("folded_root"),
    )
