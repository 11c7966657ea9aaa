"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row.

Digests are lower-case hexadecimal SHA-256; a node is the digest of its children's digests as text.  Leaves of a
group ascend by id; every two consecutive nodes become one (an odd last one becomes the digest of itself) until one,
the subroot, is left.  Subroots, in the bytewise order of their groups, become the root in the same way.

Building: leaves are ranked by one range sort.  Runs of ``2 ** STRIDE`` nodes of one level are gathered, which is a
bounded group, and give the nodes of the next ``STRIDE`` levels; so a tree of ``n`` leaves takes
``log2(n) / STRIDE`` exchanges.

Proofs by pointer jumping: every node starts with the segment to its parent (the side and digest of its sibling).  A
round joins the nodes with themselves: a node whose segment ends at an ancestor appends the ancestor's own segment,
which doubles the distance, until every leaf reaches the subroot.  Only nodes on heights that a later round asks
for are kept, so the joined side shrinks to a sixteenth, a 256th and so on.  Groups' subroots reach the root in the
same way, and a last join puts both segments together.

Nulls, edges, ties: null fields are hashed as ``-``; a null group is a group of its own and the first; null ids
come first; rows of one id are ordered by their leaf digest (equal rows are interchangeable); texts of any length are
hashed in the JVM; a single leaf is its own subroot, a single group its own root; an empty table gives no rows;
columns that are not asked for may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.operators.ranking import sorted_rank
from assayer.session import materialize

STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, height int, pos long, sides string, siblings binary"
_LEAF = "id long, claimed binary"


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields, each as its UTF-8 byte count, a colon and its value, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def _levels(nodes: list[bytes], size: int) -> Iterator[tuple[list[bytes], int]]:
    """The run's nodes and the width of the whole level, upwards, at most ``STRIDE`` levels above the first."""
    yield nodes, size
    for _ in range(STRIDE):
        if size == 1:
            return
        text = [x.hex().encode() for x in nodes]
        nodes = [hashlib.sha256(b"".join(text[k:k + 2])).digest() for k in range(0, len(text), 2)]
        size = -(-size // 2)
        yield nodes, size


def _climb(runs: DataFrame, base: int) -> DataFrame:
    """Nodes of the levels above ``base``: those with a parent in the run have a segment, the top ones a digest."""
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                levels = list(_levels([x["digest"] for x in row["nodes"]], row["size"]))
                first = row["run"] << STRIDE
                for k, (nodes, size) in enumerate(levels):
                    top = k + 1 == len(levels)
                    for i, digest in enumerate(nodes):
                        pos, other = (first >> k) + i, i ^ 1
                        side, sibling = "", None
                        if not top:
                            sibling = nodes[other] if other < len(nodes) else b""
                            side = "-" if not sibling else "LR"[i % 2 == 0]
                        item = row["nodes"][i] if base == 0 and k == 0 else {}
                        out.append((row["tree"], base + k, pos, side, sibling, digest if top or item else None,
                                    top, size == 1, item.get("id"), item.get("claimed")))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_(),
                     pa.bool_(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["tree", "height", "pos", "sides", "siblings", "digest", "top", "root", "id", "claimed"]
    return runs.mapInArrow(run, f"{_NODE}, digest binary, top boolean, root boolean, {_LEAF}")


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes with the segment to their parent, one root per tree, and the greatest height.

    ``leaves`` has ``tree``, ``pos`` (from 0 in each tree), ``digest`` (binary), ``id`` and ``claimed``.
    """
    sizes = materialize(leaves.groupBy("tree").agg(F.count("*").alias("size")), "tree-sizes")
    widest = sizes.agg(F.max("size")).first()[0] or 0
    highest = max(0, widest - 1).bit_length()
    level, nodes, roots = leaves, [], []
    for base in range(0, max(1, highest), STRIDE):
        runs = level.groupBy("tree", F.shiftright("pos", STRIDE).alias("run")).agg(F.sort_array(F.collect_list(
            F.struct("pos", "digest", "id", "claimed"))).alias("nodes"))
        wide = sizes.select("tree", F.ceil(F.col("size") / (1 << base)).cast("long").alias("size"))
        climbed = materialize(_climb(runs.join(wide, "tree"), base), "tree-nodes")
        # a leaf that is its own root keeps its row, with an empty segment
        nodes.append(climbed.filter("NOT top OR (height = 0 AND root)"))
        roots.append(climbed.filter("top AND root").select("tree", "digest"))
        level = climbed.filter("top AND NOT root").select("tree", "pos", "digest", F.lit(None).cast("long").alias("id"),
                                                          F.lit(None).cast("binary").alias("claimed"))
    every, top = nodes[0], roots[0]
    for more, ends in zip(nodes[1:], roots[1:], strict=True):
        every, top = every.unionAll(more), top.unionAll(ends)
    return every.drop("top", "root"), top, highest


def jump(nodes: DataFrame, highest: int) -> DataFrame:
    """The leaves with their whole segments: repeated self-joins that double the distance to the ancestor."""
    reach = 1
    while reach < highest:
        low = nodes.filter(F.col("height") % (2 * reach) == 0)
        # the ancestors at this distance, one row each; fresh names, both sides come from one table
        high = nodes.filter(F.col("height") % (2 * reach) == reach).select(
            F.col("tree").alias("_tree"), (F.col("height") - reach).alias("_height"), F.col("pos").alias("_pos"),
            F.col("sides").alias("_sides"), F.col("siblings").alias("_siblings"))
        met = low.withColumn("_up", F.shiftright("pos", reach)).join(
            high, F.expr("tree = _tree AND height = _height AND _up = _pos"), "left")
        longer = met.select("tree", "height", "pos", F.concat("sides", F.coalesce("_sides", F.lit(""))).alias("sides"),
                            F.concat("siblings", F.coalesce("_siblings", F.lit(b""))).alias("siblings"),
                            "digest", "id", "claimed")
        reach *= 2
        nodes = materialize(longer, "tree-jump") if reach < highest else longer
    return nodes.filter("height = 0").drop("height")


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, sides: Column, siblings: Column) -> Column:
    """The root that a leaf digest (text) leads to along a proof: ``sides`` of the siblings and their digests."""
    def step(acc: Column, i: Column) -> Column:
        side = F.substring(sides, i, F.lit(1))
        other = _text(F.substring(siblings, acc["at"] * 32 + 1, F.lit(32)))
        joined = (F.when(side == "L", F.concat(other, acc["digest"]))
                  .when(side == "R", F.concat(acc["digest"], other)).otherwise(acc["digest"]))
        return F.struct(F.sha2(joined, 256).alias("digest"), (acc["at"] + (side != "-").cast("int")).alias("at"))

    steps = F.when(F.length(sides) > 0, F.sequence(F.lit(1), F.length(sides))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(leaf.alias("digest"), F.lit(0).alias("at")), step)["digest"]


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             claimed: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``leaf``, ``subroot``, ``root``, and the proof (``sides`` and ``siblings``,
    from the leaf up).  ``claimed``, the leaf digest that someone presents, is carried along (default: the leaf).
    """
    leaf = leaf_digest(*[F.col(c) for c in fields])
    group = F.col(group_col).cast("string")
    # a null group sorts before all others, the empty text included
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    leaves = docs.select(F.col(id_col).cast("long").alias("id"), tree.alias("tree"), F.unhex(leaf).alias("digest"),
                         F.unhex(leaf if claimed is None else claimed).alias("claimed"),
                         F.monotonically_increasing_id().alias("row"))
    ranked = sorted_rank(materialize(leaves, "leaves"), ["id", "digest", "row"], ["tree"], rank="rank")
    placed = materialize(ranked.select("tree", (F.col("rank") - 1).alias("pos"), "digest", "id", "claimed"), "placed")
    nodes, subroots, highest = build(placed)
    proofs = jump(nodes, highest)
    above = sorted_rank(subroots, ["tree"], [], rank="rank").select(
        F.lit("").alias("tree"), (F.col("rank") - 1).alias("pos"), "digest", F.lit(None).cast("long").alias("id"),
        F.encode("tree", "utf-8").alias("claimed"))
    upper, root, higher = build(materialize(above, "subroots"))
    # stored, so that the planner knows its size and leaves the proofs where they are if it is small
    groups = materialize(jump(upper, higher).select(
        F.decode("claimed", "utf-8").alias("tree"), F.col("digest").alias("subroot"),
        F.col("sides").alias("_sides"), F.coalesce("siblings", F.lit(b"")).alias("_siblings")), "group-proofs")
    joined = proofs.join(groups, "tree")
    return joined.select(
        "id", _text(F.col("digest")).alias("leaf"), _text(F.col("subroot")).alias("subroot"),
        _text(root.select("digest").scalar()).alias("root"), F.concat("sides", "_sides").alias("sides"),
        F.concat(F.coalesce("siblings", F.lit(b"")), "_siblings").alias("siblings"),
        _text(F.col("claimed")).alias("claimed"))


def verify(proofs: DataFrame) -> DataFrame:
    """Add ``folded_root``, which the claimed leaf and the proof lead to, and ``verified``."""
    return proofs.withColumn("folded_root", fold(F.col("claimed"), F.col("sides"), F.col("siblings"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def digests(verified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return verified.select(F.col("id").alias(id_col), "leaf", "subroot", "root",
                           F.sha2(_text(F.col("siblings")), 256).alias("proof_sha256"), "folded_root", "verified")
