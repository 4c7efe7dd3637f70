"""Merkle manifest of a data set, with nested-interval labels.

Every document is a leaf, and the leaves of a language are ranked by ``doc_id``. A node carries the interval of leaf
ranks it covers, ``lo`` to ``hi``. ``FANOUT`` consecutive nodes of a level have one parent, so the parent of a node at
level k lies in bucket ``lo div FANOUT^(k+1)``. Trees grow by grouping a level by that bucket until one node is left. A
node is attached to its ancestor by a join on tree and bucket where the ancestor's interval contains its own, one level
after the other from the top down; its siblings are the parent's children outside its own interval. The last nodes of
the languages are the leaves of one more tree of the same kind, whose last node is the root.

At scale. Texts are read once and only digested; what is shuffled is about 130 bytes per document. Ranks come from one
range partitioning of all leaves, spread by an extra running number, so that neither a language with most of the rows
nor a row repeated very often meets in one task: the position of a row is its place in its partition plus the sizes of
the partitions before it, and its rank is that less the first position of its language. A path of siblings is built once
for eight leaves. The driver sees one number, the size of the largest tree, for the number of levels.

Digests are SHA-256, kept as bytes and concatenated as lowercase hexadecimal text.

NULL values count as ``-``. A missing language is a language of its own before all others; a missing ``doc_id`` sorts
before all others and is never tampered with. Rows with the same ``doc_id`` are ordered by their leaf digest, and equal
rows are leaves of their own. An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.common import cut

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW_BITS = 33  # monotonically_increasing_id counts the rows of a partition in its lower 33 bits


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hexed(value: Column) -> Column:
    """Bytes as lowercase hexadecimal text."""
    return F.lower(F.hex(value))


def leaf_digest(text: Column) -> Column:
    """The digest of a document whose text is ``text``."""
    fields = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    framed = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in fields]
    return digest(F.concat(*framed))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, digest, seen``: every document's leaf, and the leaf as it is found after the tampering."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    seen = F.when(struck, leaf_digest(F.translate("text", _UPPER, _LOWER)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    own = docs.select(*FIELDS).select(F.col("doc_id").cast("long"), tree.alias("tree"), leaf_digest(F.col("text")).alias("digest"), seen.alias("seen"))
    return own.withColumn("seen", F.coalesce("seen", "digest"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``lo`` = ``hi``, their rank from 0 in their tree by ``order``, and ``n``, the size of the tree."""
    numbered = cut(rows, "unranked").withColumn("_tie", F.monotonically_increasing_id())
    by = ["tree", *order, "_tie"]
    sorted_ = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col("_at"), _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = cut(sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")), "offsets")
    position = F.col("_before") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = placed.withColumn("_part", part).join(offsets, "_part").withColumn("_position", position)
    trees = cut(placed.groupBy("tree").agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("n")), "trees")
    lo = F.col("_position") - F.col("_first")
    return placed.join(trees, "tree").select(*rows.columns, lo.alias("lo"), lo.alias("hi"), "n")


def grown(bottom: DataFrame) -> list[DataFrame]:
    """The levels above ``bottom`` (``tree, lo, hi, n, digest``), each with the ``children`` of its nodes."""
    levels, most = [], bottom.agg(F.max("n")).first()[0] or 0
    below, width = bottom, 1
    while width < most:
        several, width = below.where(F.col("n") > width), width * FANOUT
        joined = several.groupBy("tree", F.expr(f"lo div {width}").alias("_bucket")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"), F.max("n").alias("n")
        )
        child = F.col("children")
        whole = digest(F.array_join(F.transform(child, lambda c: hexed(c["digest"])), ""))
        ends = (F.get(child, F.lit(0))["lo"].alias("lo"), F.element_at(child, -1)["hi"].alias("hi"))
        below = cut(joined.select("tree", *ends, "n", whole.alias("digest"), "children"), f"level-{len(levels) + 1}")
        levels.append(below)
    return levels


def last_nodes(bottom: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """``tree, digest`` of the trees that end at each level, from the leaves up."""
    return [
        nodes.where((F.col("n") <= FANOUT**k) & (F.col("n") > FANOUT**k // FANOUT)).select("tree", "digest")
        for k, nodes in enumerate([bottom, *levels])
    ]


def attached(bottom: DataFrame, levels: list[DataFrame], tops: list[DataFrame]) -> DataFrame:
    """``bottom`` with ``path``, ``subroot`` and ``root``.

    ``tops`` has ``tree, path, subroot, root`` of the trees that end at each level. A path lists the digests left and
    right of a node among its siblings, from the node's level up.
    """
    nodes = [bottom, *levels]
    last = len(nodes) - 1
    above = nodes[last].join(tops[last], "tree")
    for k in range(last - 1, -1, -1):
        parents = above.select(
            F.col("tree").alias("_tree"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_siblings"),
            "path", "subroot", "root",
        )
        width = FANOUT ** (k + 1)
        bucket = F.expr(f"lo div {width}") == F.expr(f"_lo div {width}")
        inside = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        met = nodes[k].join(parents, (F.col("tree") == F.col("_tree")) & bucket & inside)

        def beside(keep):
            """The digests of the parent's children outside the node's interval, on one side of it."""
            return F.array_join(F.transform(F.filter("_siblings", keep), lambda c: F.hex(c["digest"])), "")

        step = F.struct(
            F.unhex(beside(lambda c: c["hi"] < F.col("lo"))).alias("left"), F.unhex(beside(lambda c: c["lo"] > F.col("hi"))).alias("right")
        )
        path = F.concat(F.array(step), F.col("path"))
        met = met.select(*nodes[k].columns, path.alias("path"), "subroot", "root")
        ended = nodes[k].join(tops[k], "tree").select(*met.columns)
        above = met.unionByName(ended)
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``."""
    bottom = ranked(leaves(docs), "doc_id", "digest")
    levels = grown(bottom)
    ends = last_nodes(bottom, levels)
    # The languages are ranked and grown by the same steps, as the leaves of one tree.
    subroots = reduce(DataFrame.unionAll, ends).select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest")
    forest = ranked(subroots, "lang_tree")
    crown = grown(forest)
    no_path, no_subroot = F.array().cast("array<struct<left:binary,right:binary>>"), F.lit(None).cast("binary")
    peaks = [
        end.select("tree", no_path.alias("path"), no_subroot.alias("subroot"), F.col("digest").alias("root")) for end in last_nodes(forest, crown)
    ]
    placed = attached(forest, crown, peaks)
    roots = cut(placed.select(F.col("lang_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "subroots")
    tops = [end.select("tree").join(roots, "tree") for end in ends]
    proved = attached(bottom, levels, tops)
    fold = F.aggregate(
        "path", hexed(F.col("seen")),
        lambda d, step: F.sha2(F.concat(hexed(step["left"]), d, hexed(step["right"])), 256),
    )
    proof = F.sha2(F.array_join(F.transform("path", lambda step: hexed(F.concat(step["left"], step["right"]))), ""), 256)
    shown = proved.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof.alias("proof_sha256"), fold.alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
