"""Merkle manifest of a dataset by slot pivots.

Nodes of a tree are rows (tree, position, digest).  A parent is one aggregation of its children: a
conditional aggregate per slot spreads them into ``fanout`` columns.  The columns joined and hashed are
the parent's digest; the same columns without a child's own slot are its siblings, those before it and
those after it.

``LEVELS`` levels at once are built inside a block of ``fanout ** LEVELS`` neighbours, which share a
partition, so a round of levels is one shuffle.  The leaves of a block travel in their ancestor's row,
at most a block of them, and gather their siblings.  The next round works on the blocks' tops; the
paths found there are then joined back from the top round down, a row per block.  No window or group
holds a tree: positions come from a range partitioning that splits a large tree.

Documents form a tree for each language; the roots of these are the leaves of a last tree.

Defined results: a field that is null counts as ``-`` and differs from every text; rows are ordered by
doc_id, null first, then by leaf, so equal rows may change places and nothing else changes; the null
language comes first; a tree of one leaf is its leaf; an empty table gives no rows; a long text is
hashed in place.  Only doc_id, source, lang, n_chars and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import sorted_position
from ..session import release, settle

FANOUT = 2
#: Levels built in one round; a block has ``fanout ** LEVELS`` leaves.
LEVELS = 6
#: Documents whose number's CRC-32 this divides are tampered with in the check.
TAMPERED = 7


def joined(*parts: Column) -> Column:
    """The digest H: SHA-256, in hexadecimal, of the parts laid end to end."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def _over(value: Column, by: int) -> Column:
    """Whole division."""
    return F.call_function("div", value, F.lit(by))


def marked(value: Column) -> Column:
    """A field with its length; a null field is a dash."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def leaf_of(n_chars: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return joined(*[marked(f) for f in fields])


def _level(nodes: DataFrame, tree: str, fanout: int) -> DataFrame:
    """The parents of ``nodes``; a tree of one node stays as it is."""
    slot = F.col("_ix") % fanout
    at = lambda i, name: F.max(F.when(slot == i, F.col(name)))
    spread = nodes.groupBy(tree, "_block", _over(F.col("_ix"), fanout).alias("_ix")).agg(
        F.max("_n").alias("_n"),
        *[at(i, "_digest").alias(f"_s{i}") for i in range(fanout)],
        *[at(i, "_members").alias(f"_m{i}") for i in range(fanout)],
    )
    slots = [F.coalesce(F.col(f"_s{i}"), F.lit("")) for i in range(fanout)]
    alone = F.col("_n") == 1

    def passed(i: int) -> Column:
        """The members below slot ``i``, with the siblings of that slot at the end of their paths."""
        left, right = F.concat(F.lit(""), *slots[:i]), F.concat(F.lit(""), *slots[i + 1 :])
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        longer = F.transform(
            F.col(f"_m{i}"), lambda m: m.withField("path", F.concat(m["path"], step))
        )
        return F.coalesce(longer, F.array().cast(spread.schema["_m0"].dataType))

    return spread.select(
        tree,
        "_block",
        "_ix",
        _over(F.col("_n") + fanout - 1, fanout).alias("_n"),
        F.when(alone, F.col("_s0")).otherwise(joined(*slots)).alias("_digest"),
        F.when(alone, F.col("_m0"))
        .otherwise(F.concat(*[passed(i) for i in range(fanout)]))
        .alias("_members"),
    )


NO_PATH = "array<struct<left: string, right: string>>"


def trees(
    leaves: DataFrame, tree: str, fanout: int = FANOUT, levels: int = LEVELS
) -> tuple[DataFrame, DataFrame]:
    """(tree, _row, _path) of every leaf, and (tree, _root) of every tree.

    ``leaves`` has tree, _ix (0-based position in the tree), _n (its number of leaves), _digest and
    _row, what else belongs to the leaf.  _path lists, level by level, the digests before the node
    (left) and after it (right) among its parent's children.
    """
    empty = F.array().cast(NO_PATH)
    most = leaves.agg(F.max("_n")).first()[0] or 0
    nodes, width, rounds = leaves, fanout**levels, []
    while True:
        member = [F.col("_ix").alias("ix"), empty.alias("path")]
        if not rounds:
            member.insert(0, F.col("_row").alias("row"))
        block = nodes.select(
            tree,
            _over(F.col("_ix"), width).alias("_block"),
            "_ix",
            "_n",
            "_digest",
            F.array(F.struct(*member)).alias("_members"),
        ).repartition(tree, "_block")
        count = most
        for _ in range(levels):
            if count <= 1:
                break
            block, count = _level(block, tree, fanout), -(-count // fanout)
        rounds.append(settle(block))
        if count <= 1:
            break
        most, nodes = count, rounds[-1]
    roots = rounds[-1].select(tree, F.col("_digest").alias("_root"))
    above, old = None, None
    for at in reversed(range(len(rounds))):
        names = ["ix", "path"] + ["row"] * (at == 0)
        below = rounds[at]
        if above is not None:
            below = below.join(above, [tree, "_ix"])
        lower = below.select(
            tree,
            F.explode("_members").alias("m"),
            *(["_path"] if above is not None else []),
        )
        path = F.col("m.path") if above is None else F.concat(F.col("m.path"), F.col("_path"))
        found = lower.select(
            tree, *[F.col(f"m.{n}").alias(f"_{n}") for n in names if n != "path"], path.alias("_path")
        )
        if at:
            above = settle(found)
            release(old)
            old = above
        else:
            return found.select(tree, "_row", "_path"), roots
    raise AssertionError("a tree has a round")


def positions(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """``rows`` with _ix, the 0-based position in the tree by ``order``, and _n, the tree's size."""
    numbered = sorted_position(rows, [tree], order, "_at")
    sizes = rows.groupBy(tree).agg(F.count("*").alias("_n"))
    return numbered.join(sizes, tree).withColumn("_ix", F.col("_at") - 1)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda done, step: joined(step["left"], done, step["right"]))


def sibling_digest(path: Column) -> Column:
    """H of all siblings, level by level, those of a level from left to right."""
    listed = F.transform(path, lambda step: F.concat(step["left"], step["right"]))
    return joined(F.array_join(listed, ""))


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, lang, leaf, altered (the leaf with n_chars + 1), subroot, root and _path of every row."""
    chars = F.col("n_chars")
    # a tree's name is never null and keeps the order: null first, then by UTF-8 bytes
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    leaves = settle(
        docs.select(
            key.alias("_tree"),
            F.col("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            leaf_of(chars).alias("leaf"),
            leaf_of(chars + 1).alias("altered"),
        )
    )
    placed = positions(leaves, "_tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    found, roots = trees(
        placed.select(
            "_tree",
            "_ix",
            "_n",
            F.col("leaf").alias("_digest"),
            F.struct("doc_id", "lang", "leaf", "altered").alias("_row"),
        ),
        "_tree",
        fanout,
        levels,
    )
    tops = roots.select(F.lit("").alias("_all"), "_tree", F.col("_root").alias("_digest"))
    tops = positions(settle(tops), "_all", [F.col("_tree")])
    upper, root = trees(
        tops.select(
            "_all", "_ix", "_n", "_digest", F.struct("_tree", F.col("_digest").alias("subroot")).alias("_row")
        ),
        "_all",
        fanout,
        levels,
    )
    upper = settle(
        upper.join(root, "_all").select("_row.*", F.col("_path").alias("_over"), F.col("_root").alias("root"))
    )
    return found.join(upper, "_tree").select(
        "_row.*", "subroot", "root", F.concat("_path", "_over").alias("_path")
    )


def tampered(doc_id: Column) -> Column:
    """Whether the check changes this document; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))


def verified(listed: DataFrame) -> DataFrame:
    """A manifest with its proofs' digests and the roots that tampered and whole leaves lead to."""
    leaf = F.when(tampered(F.col("doc_id")), F.col("altered")).otherwise(F.col("leaf"))
    folds = folded(leaf, F.col("_path"))
    return listed.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        sibling_digest(F.col("_path")).alias("proof_sha256"),
        folds.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
