"""Operator 13: a Merkle manifest of a table, with a version for each changed leaf.

Leaves are the rows' digests, in key order within a tree (a language, say). Every two
consecutive nodes become the digest of their joined hex texts, a last single one that of
its own, until one node is left: the tree's root. The roots of the trees, in tree order,
become the root of the manifest in the same way.

A tree of any size is built in blocks of 2 ** LEVELS aligned leaves, its block roots in blocks of
block roots, and so on; a task holds one block at a time. Positions come from one range
sort and the counts of its partitions, so no tree is ever in one task.

Versions are persistent: a changed leaf copies the nodes above it in its block and shares
all others (class Block); the new block root then goes on upwards, along the path of its
block, which is kept once for each block and not for each leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ratelake.llm.rows import arrow_schema, map_rows, staged_rows

#: A block has so many levels, and two to that power of leaves.
LEVELS = 8
#: Marks of a step upwards: the sibling is on the left, on the right, or there is none.
LEFT, RIGHT, ALONE = b"L", b"R", b"N"


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (hex) of values: '-' for a null, else the count of bytes, ':' and the text."""
    texts = [c.cast("string") for c in columns]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*(F.coalesce(s, F.lit("-")) for s in sized)), 256)


def joined(*nodes: str) -> str:
    """The node above one or two nodes."""
    return sha256("".join(nodes).encode()).hexdigest()


class Block:
    """A persistent tree over the nodes of a block: versions share all that they can.

    Nodes are numbers; each has a digest and one or two children. ``height`` levels are
    built, also where one node is left before, as in the last block of a longer tree.
    """

    def __init__(self, digests: Sequence[str], height: int):
        self.digest = list(digests)
        self.below: list[tuple[int, ...]] = [()] * len(self.digest)
        self.levels = [list(range(len(self.digest)))]
        for _ in range(height):
            last = self.levels[-1]
            self.levels.append([self._node(*last[i : i + 2]) for i in range(0, len(last), 2)])
        self.root = self.levels[-1][0]

    def _node(self, *children: int) -> int:
        self.digest.append(joined(*(self.digest[c] for c in children)))
        self.below.append(children)
        return len(self.digest) - 1

    def version(self, at: int, digest: str) -> int:
        """The root of a version whose leaf ``at`` has another digest.

        Copies the leaf and its ancestors; every other node is that of the first version.
        """
        self.digest.append(digest)
        self.below.append(())
        node = len(self.digest) - 1
        for level in self.levels[:-1]:
            other = at ^ 1
            if other >= len(level):
                node = self._node(node)
            elif at & 1:
                node = self._node(level[other], node)
            else:
                node = self._node(node, level[other])
            at >>= 1
        return node

    def path(self, at: int) -> bytes:
        """The way from a leaf to the root: a mark for each level, with the sibling."""
        steps = []
        for level in self.levels[:-1]:
            other = at ^ 1
            if other >= len(level):
                steps.append(ALONE)
            else:
                steps.append(LEFT if at & 1 else RIGHT)
                steps.append(bytes.fromhex(self.digest[level[other]]))
            at >>= 1
        return b"".join(steps)


def steps_of(path: bytes) -> list[tuple[bytes, str]]:
    """The marks and siblings (hex) of a path."""
    steps, at = [], 0
    while at < len(path):
        mark = path[at : at + 1]
        size = 0 if mark == ALONE else 32
        steps.append((mark, path[at + 1 : at + 1 + size].hex()))
        at += 1 + size
    return steps


def folded(digest: str, steps: Sequence[tuple[bytes, str]]) -> str:
    """What a node becomes at the end of a path."""
    for mark, other in steps:
        if mark == LEFT:
            digest = joined(other, digest)
        else:
            digest = joined(digest, other)
    return digest


def _height(count: int, most: int) -> int:
    """Levels of a block in a tree that has ``count`` nodes on the block's lowest level."""
    return min(most, (count - 1).bit_length())


@dataclass(frozen=True)
class Manifest:
    """``blocks``: a row for each block of leaves (tree, block, keys, leaves, versions);
    ``ways``: for each block the path from its root to that of the manifest; ``levels``:
    those of a block. The blocks are stored.
    """

    blocks: DataFrame
    ways: DataFrame
    levels: int


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    key: str = "doc_id",
    tree: str = "lang",
    changed: Callable[[DataFrame], tuple[Column, Sequence[Column]]] | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Builds the manifest of all rows of docs; a leaf is the digest of ``columns``.

    ``changed`` gives a condition and the values that a row of that condition has in the
    changed state; each such row becomes a version of the manifest.

    Null and other values are told apart by the leaf. Null keys come first, rows with equal
    keys are ordered by leaf; equal rows are leaves each, however many, and are spread over
    tasks. A null tree is a tree of its own and comes first. Texts of any length are
    digested whole. Other columns, of any name, are not read; an empty table has no blocks.
    """
    values = [F.col(f"`{c}`") for c in columns]
    where, others = changed(docs) if changed else (F.lit(False), values)
    named = F.col(f"`{tree}`").cast("string")
    leaves = docs.select(
        # "-" sorts before "=": the tree without a name is the first.
        F.coalesce(F.concat(F.lit("="), named), F.lit("-")).alias("tree"),
        F.col(f"`{key}`").alias("key"),
        F.unhex(row_digest(values)).alias("leaf"),
        F.when(where, F.unhex(row_digest(others))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Stored first: the range sort goes over its input twice, and the texts are long.
    leaves = staged_rows(leaves, "manifest-leaves")
    placed = _placed(leaves, ["tree", "key", "leaf", "row"])
    blocks = staged_rows(_leaf_blocks(placed, levels), "manifest-blocks")

    nodes = blocks.select(
        "tree", F.col("block").alias("position"), F.col("root").alias("node"), _above("n", levels).alias("n")
    )
    ways, subroots = _climb(nodes, levels)
    trees = _placed(subroots.select("tree", "node"), ["tree"], F.lit("")).select(
        F.col("tree").alias("name"), F.lit("").alias("tree"), "position", "node", "n"
    )
    trees = staged_rows(trees, "manifest-trees")
    upper, roots = _climb(trees, levels)
    tops = upper.join(trees.select("name", "position", "node"), "position").select(
        F.col("name").alias("tree"), F.col("way").alias("end"), F.col("node").alias("subroot")
    )
    top = roots.first()
    return Manifest(
        blocks,
        ways.join(tops, "tree").select(
            "tree",
            F.col("position").alias("block"),
            F.concat("way", "end").alias("way"),
            "subroot",
            F.lit(None if top is None else bytes(top.node)).cast("binary").alias("top"),
        ),
        levels,
    )


def _above(count: str, levels: int) -> Column:
    """Nodes of a tree that are left a block's levels higher."""
    return F.shiftright(F.col(count) + (1 << levels) - 1, levels)


def _placed(rows: DataFrame, order: Sequence[str], tree: Column | None = None) -> DataFrame:
    """Adds position, from 0 in each tree, and n, the rows of the tree.

    One range sort; a row's number within its sorted partition is a number of Spark's, and
    only counts for each partition and tree are summed, so a tree may span any number of
    tasks.
    """
    rows = rows.withColumn("of", F.col("tree") if tree is None else tree)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = staged_rows(ordered.withColumn("at", F.monotonically_increasing_id()), "manifest-order")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ordered.groupBy("of", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    parts = Window.partitionBy("of").orderBy("part")
    before = F.sum("here").over(parts.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "of",
        "part",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("of")).alias("n"),
    )
    placed = ordered.join(offsets, ["of", "part"])
    return placed.withColumn("position", F.col("at") + F.col("shift")).drop("of", "part", "at", "shift")


def _leaf_blocks(placed: DataFrame, levels: int) -> DataFrame:
    """One row for each block: its keys in order, its leaves, its root and its versions.

    ``versions`` holds the place of each changed leaf, ``copied`` for each the digests that
    its version does not share with the first one: the leaf's and those of its ancestors.
    """
    kind = placed.schema["key"].dataType
    schema = StructType(
        [
            *StructType.fromDDL("tree string, block long, n long, root binary, leaves binary"),
            StructField("keys", ArrayType(kind)),
            *StructType.fromDDL("versions array<int>, copied binary"),
        ]
    )
    arrow = arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("position").combine_chunks()
        leaves = table.column("leaf").to_pylist()
        n = table.column("n")[0].as_py()
        block = Block([x.hex() for x in leaves], _height(n, levels))
        places, copied = [], []
        for at, digest in enumerate(table.column("changed").to_pylist()):
            if digest is not None:
                first = len(block.digest)
                block.version(at, digest.hex())
                places.append(at)
                copied.append(bytes.fromhex("".join(block.digest[first:])))
        keys = table.column("key").chunk(0)
        values = {
            "tree": [table.column("tree")[0].as_py()],
            "block": [table.column("block")[0].as_py()],
            "n": [n],
            "root": [bytes.fromhex(block.digest[block.root])],
            "leaves": [b"".join(leaves)],
            "versions": [places],
            "copied": [b"".join(copied)],
        }
        # A list field of Spark's has its own name for the element; the cast gives it that.
        lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.Table.from_arrays(
            [
                lists.cast(f.type) if f.name == "keys" else pa.array(values[f.name], f.type)
                for f in arrow
            ],
            schema=arrow,
        )

    rows = placed.withColumn("block", F.shiftright("position", levels))
    return rows.groupBy("tree", "block").applyInArrow(one, schema)


def _climb(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The way of each node (tree, position, node, n) to its root, and the roots.

    Round by round, a block's levels at a time; a tree with one node left stays as it is.
    """
    schema = "tree string, position long, n long, path binary, root binary"
    arrow = arrow_schema(schema)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        n = table.column("n")[0].as_py()
        block = Block([x.hex() for x in table.column("node").to_pylist()], _height(n, levels))
        count = table.num_rows
        return pa.Table.from_arrays(
            [
                pa.concat_arrays(table.column("tree").chunks).cast(pa.string()),
                pa.concat_arrays(table.column("position").chunks),
                pa.array([n] * count, pa.int64()),
                pa.array([block.path(i) for i in range(count)], pa.binary()),
                pa.array([bytes.fromhex(block.digest[block.root])] * count, pa.binary()),
            ],
            schema=arrow,
        )

    ways = nodes.select("tree", "position", F.lit(b"").alias("way"), F.col("position").alias("now"))
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        group = nodes.groupBy("tree", F.shiftright("position", levels).alias("block"))
        step = staged_rows(group.applyInArrow(one, schema), "manifest-step")
        path = step.select("tree", F.col("position").alias("now"), "path")
        ways = ways.join(path, ["tree", "now"]).select(
            "tree",
            "position",
            F.concat("way", "path").alias("way"),
            F.shiftright("now", levels).alias("now"),
        )
        nodes = step.where(F.col("position") % (1 << levels) == 0).select(
            "tree",
            F.shiftright("position", levels).alias("position"),
            F.col("root").alias("node"),
            _above("n", levels).alias("n"),
        )
    return ways.drop("now"), nodes


def proofs(found: Manifest, key: str = "doc_id", whole: bool = False) -> DataFrame:
    """A row for each leaf: key, leaf, subroot, root, proof_sha256 (of the siblings' hex
    texts from the leaf to the root), folded_root (of the changed leaf, else of the leaf
    itself, by the original siblings) and verified (it equals the root).

    ``whole`` adds the siblings themselves, as ``proof``. No block is read twice.
    """
    kind = found.blocks.schema["keys"].dataType.elementType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]
    rest = StructType.fromDDL(
        ", ".join(f"{x} string" for x in names[: 6 if whole else 5]) + ", verified boolean"
    )
    schema = StructType([StructField("key", kind), *rest])

    levels = found.levels

    def start():
        def one(part: pa.RecordBatch) -> dict:
            out: dict[str, list] = {name: [] for name in rest.fieldNames()}
            for row in part.drop_columns(["keys"]).to_pylist():
                _expand(row, levels, out)
            return out | {"key": part.column("keys").flatten()}

        return one

    rows = found.blocks.join(found.ways, ["tree", "block"]).drop("tree", "block", "root")
    # Few blocks at a time: each becomes a row for each leaf.
    rows = map_rows(rows, schema, start, rows=16)
    return rows.select(F.col("key").alias(key), *rest.fieldNames())


def _expand(row: dict, levels: int, out: dict[str, list]) -> None:
    """The leaves of one block with their proofs, added to the columns of out."""
    leaves = [row["leaves"][i : i + 32].hex() for i in range(0, len(row["leaves"]), 32)]
    height = _height(row["n"], levels)
    block = Block(leaves, height)
    top, subroot = row["top"].hex(), row["subroot"].hex()
    onwards = steps_of(row["way"])
    end = "".join(other for _, other in onwards)
    # A version's last copied node is its root of the block.
    wide, copied = 32 * (height + 1), row["copied"]
    version = {
        at: copied[wide * (i + 1) - 32 : wide * (i + 1)].hex()
        for i, at in enumerate(row["versions"])
    }
    upper: dict[str, str] = {}
    for at, leaf in enumerate(leaves):
        steps = steps_of(block.path(at))
        node = version.get(at) or folded(leaf, steps)
        if node not in upper:
            upper[node] = folded(node, onwards)
        out["leaf"].append(leaf)
        out["subroot"].append(subroot)
        out["root"].append(top)
        proof = "".join(other for _, other in steps) + end
        out["proof_sha256"].append(joined(proof))
        if "proof" in out:
            out["proof"].append(proof)
        out["folded_root"].append(upper[node])
        out["verified"].append(upper[node] == top)
