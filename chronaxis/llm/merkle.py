"""Merkle manifest of a dataset as a postorder append log.

Every tree (one per value of the tree column) is binary over its leaves in
order: two consecutive nodes become their parent, a lone last node becomes a
parent of its own.  The roots of the trees, in order, are the leaves of one
more such tree, whose root stands for the whole table.

The leaves are dealt to builders in aligned blocks of ``2**bits``.  A builder
writes its nodes when they are complete, children before parents, so that its
segment is one stretch of the tree's postorder log.  Block roots are dealt to
builders again, until one node is left.  A node's place in the log follows
from subtree sizes alone (:func:`place`), and a proof reads each sibling from
the segment at that place; no node is searched for or sorted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

BITS = 10
SIZE = 32  # bytes of a digest


def parent(*digests: bytes) -> bytes:
    """Digest of one or two children, which enter as lowercase hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def subtree(level: int, leaves: int) -> int:
    """Nodes of a subtree of the given height over so many leaves."""
    return sum(-(-leaves >> k) for k in range(level + 1))


def place(level: int, index: int, leaves: int) -> int:
    """Postorder position of a node.

    Before its first leaf, L leaves have completed 2L - popcount(L) nodes; the
    node itself is the last of its subtree.
    """
    first = index << level
    return 2 * first - first.bit_count() + subtree(level, min(1 << level, leaves - first)) - 1


def siblings(index: int, leaves: int, levels: int) -> Iterator[tuple[int, int | None]]:
    """(level, index of the sibling or None) on the way up from a leaf."""
    for level in range(levels):
        other = (index >> level) ^ 1
        yield level, other if other << level < leaves else None


def segment(leaves: list[bytes], levels: int) -> list[bytes]:
    """Nodes in completion order; the last is the root of the block."""
    log: list[bytes] = []
    open_nodes: list[tuple[int, bytes]] = []  # complete nodes that wait for a sibling, highest level first

    def close(level: int, node: bytes) -> None:
        log.append(node)
        while level < levels and open_nodes and open_nodes[-1][0] == level:
            node = parent(open_nodes.pop()[1], node)
            level += 1
            log.append(node)
        open_nodes.append((level, node))

    for leaf in leaves:
        close(0, leaf)
    while open_nodes[-1][0] < levels:
        level, node = open_nodes.pop()
        close(level + 1, parent(node))
    return log


def fold(node: bytes, index: int, leaves: int, proof: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Root of one tree from a leaf and its siblings, and the siblings left over."""
    rest = list(proof)
    for level, other in siblings(index, leaves, height(leaves)):
        if other is None:
            node = parent(node)
        elif other > index >> level:
            node = parent(node, rest.pop(0))
        else:
            node = parent(rest.pop(0), node)
    return node, rest


def leaf(columns: list[str]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    parts = []
    for c in columns:
        value = F.col(c).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """idx and n: each row's position in its tree and the tree's size.

    Rows are dealt by ranges of (tree, order), so a large tree is many ranges;
    only one row per tree and range meets in a window.
    """
    ranged = rows.repartitionByRange(F.col("tree"), *[F.col(c) for c in order]).sortWithinPartitions("tree", *order)
    ranged = persisted(ranged.withColumn("_m", F.monotonically_increasing_id()), "merkle-ranges").withColumn("_p", F.shiftright("_m", 33))
    parts = ranged.groupBy("tree", "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("tree").alias("_tree"), F.col("_p").alias("_q"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_off"),
                         F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    both = ranged.join(parts, (F.col("_p") == F.col("_q")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return both.withColumn("idx", F.col("_m") + F.col("_off")).drop("_tree", "_p", "_q", "_m", "_off")


SEGMENT = "tree string, n long, block long, ids array<bigint>, changed array<binary>, nodes binary, root binary"
SEGMENT_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                           ("changed", pa.list_(pa.binary())), ("nodes", pa.binary()), ("root", pa.binary())])


def _builder(bits: int, below: int):
    """Builds the block of nodes that stand ``below`` levels above the leaves."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n, first = table.column("n")[0].as_py(), table.column("idx")[0].as_py()
        log = segment(table.column("digest").to_pylist(), min(bits, height(n) - below))
        row = {"tree": table.column("tree")[0].as_py(), "n": n, "block": first >> bits, "nodes": b"".join(log), "root": log[-1],
               "ids": table.column("doc_id").to_pylist(), "changed": table.column("changed").to_pylist()}
        return pa.Table.from_pylist([row], schema=SEGMENT_ARROW)
    return run


def _read(nodes: bytes, level: int, index: int, leaves: int) -> bytes:
    at = place(level, index, leaves) * SIZE
    return nodes[at:at + SIZE]


def _inner_path(nodes: bytes, index: int, leaves: int, levels: int) -> list[bytes]:
    """Siblings inside one segment, read at their places."""
    return [_read(nodes, level, other, leaves) for level, other in siblings(index, leaves, levels) if other is not None]


@dataclass
class Forest:
    """Segments by round and the paths from block roots to the roots."""

    rounds: list[DataFrame]
    bits: int

    def finished(self, r: int) -> Column:
        """Trees whose last builder works in round ``r``."""
        return F.col("n") <= F.lit(1 << self.bits * (r + 1))

    def roots(self) -> DataFrame:
        """tree, n, root: one row per tree."""
        out = None
        for r, segments in enumerate(self.rounds):
            last = F.lit(True) if r == 0 else F.col("n") > F.lit(1 << self.bits * r)
            part = segments.filter(self.finished(r) & last).select("tree", "n", "root")
            out = part if out is None else out.unionByName(part)
        return out

    def log(self) -> DataFrame:
        """tree, position, level, index, digest: the postorder log, one row per node.

        Every node is written once: the root of a block belongs to the builder
        that completed it.
        """
        out = None
        for r, segments in enumerate(self.rounds):
            part = segments.select("tree", "n", "block", "nodes").mapInArrow(_entries(self.bits, r), LOG)
            out = part if out is None else out.unionByName(part)
        return out


LOG = "tree string, position long, level int, index long, digest string"


def _entries(bits: int, r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, base = row["n"], row["block"] << bits
                below = -(-n >> bits * r)  # nodes this round starts from
                mine, levels = min(1 << bits, below - base), min(bits, height(n) - bits * r)
                out = []
                for level in range(0 if r == 0 else 1, levels + 1):
                    for i in range(-(-mine >> level)):
                        index = (base >> level) + i
                        out.append({"tree": row["tree"], "position": place(level + bits * r, index, n), "level": level + bits * r, "index": index,
                                    "digest": _read(row["nodes"], level, i, mine).hex()})
                schema = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def build(placed: DataFrame, bits: int = BITS, tag: str = "trees") -> Forest:
    """Append logs of all trees: tree, n, idx, digest, doc_id, changed to segments."""
    most = placed.agg(F.max("n")).first()[0] or 0
    rounds, nodes, r = [], placed, 0
    while True:
        rows = nodes.select("tree", "n", "idx", "digest", "doc_id", "changed", F.shiftright("idx", bits).alias("block"))
        made = rows.groupBy("tree", "n", "block").applyInArrow(_builder(bits, bits * r), SEGMENT)
        rounds.append(persisted(made, f"merkle-{tag}-{r}"))
        r += 1
        if most <= 1 << bits * r:
            return Forest(rounds, bits)
        nodes = rounds[-1].filter(F.col("n") > F.lit(1 << bits * r)).select(
            "tree", "n", F.col("block").alias("idx"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))


PATH = "ptree string, pblock long, path binary, above binary"
PATH_ARROW = pa.schema([("ptree", pa.string()), ("pblock", pa.int64()), ("path", pa.binary()), ("above", pa.binary())])


def _paths(bits: int, r: int):
    """Paths of the blocks below: the siblings in this segment, then the path of its own root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, n = row["block"] << bits, row["n"]
                mine, levels = min(1 << bits, (-(-n >> bits * r)) - base), min(bits, height(n) - bits * r)
                out = [{"ptree": row["tree"], "pblock": base + i, "above": row["above"],
                        "path": b"".join(_inner_path(row["nodes"], i, mine, levels)) + row["path"]} for i in range(mine)]
                yield pa.RecordBatch.from_pylist(out, schema=PATH_ARROW)
    return run


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """Segments of the first round with the path from each block's root to the root.

    ``above`` has one row per tree: atree and above, bytes handed through to
    its leaves.
    """
    known = None
    for r in reversed(range(len(forest.rounds))):
        segments = forest.rounds[r]
        last = segments.filter(forest.finished(r))
        both = last.join(above, F.col("tree").eqNullSafe(F.col("atree"))).withColumn("path", F.lit(b"")).drop("atree")
        if known is not None:
            more = segments.filter(~forest.finished(r)).join(known, (F.col("block") == F.col("pblock")) & F.col("tree").eqNullSafe(F.col("ptree")))
            both = both.unionByName(more.drop("ptree", "pblock"))
        if r == 0:
            return both
        # Trees that finish below this round do not come back here: their only block has no row in these segments.
        known = persisted(both.select("tree", "n", "block", "nodes", "path", "above").mapInArrow(_paths(forest.bits, r), PATH), "merkle-paths")
    raise AssertionError


PROOF = ("doc_id long, tree string, idx long, n long, leaf string, subroot string, root string, proof array<string>, folded_root string, verified boolean")
PROOF_ARROW = pa.schema([("doc_id", pa.int64()), ("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()),
                         ("root", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _packed(index: int, n: int, root: bytes, subroot: bytes, path: bytes) -> bytes:
    return index.to_bytes(8, "big") + n.to_bytes(8, "big") + root + subroot + path


ABOVE = "atree string, above binary"


def _tops(bits: int):
    """What every tree needs of the tree above: its place, the root, and its siblings there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, n = row["block"] << bits, row["n"]
                mine, levels = min(1 << bits, n - base), min(bits, height(n))
                out = []
                for i in range(mine):
                    path = b"".join(_inner_path(row["nodes"], i, mine, levels)) + row["path"]
                    out.append({"aidx": base + i, "above": _packed(base + i, n, row["above"], _read(row["nodes"], 0, i, mine), path)})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("aidx", pa.int64()), ("above", pa.binary())]))
    return run


def _chunks(data: bytes) -> list[bytes]:
    return [data[i:i + SIZE] for i in range(0, len(data), SIZE)]


def _proofs(bits: int):
    """Proof of every leaf of a segment, and the root folded from the leaf as found now."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, n, above = row["block"] << bits, row["n"], row["above"]
                mine, levels = min(1 << bits, n - base), min(bits, height(n))
                at, trees = int.from_bytes(above[:8], "big"), int.from_bytes(above[8:16], "big")
                root, subroot, top = above[16:48], above[48:80], _chunks(above[80:])
                upper, out = _chunks(row["path"]), []
                for i in range(mine):
                    node = _read(row["nodes"], 0, i, mine)
                    proof = _inner_path(row["nodes"], i, mine, levels) + upper + top
                    below, rest = fold(row["changed"][i] or node, base + i, n, proof)
                    folded, _ = fold(below, at, trees, rest)
                    out.append({"doc_id": row["ids"][i], "tree": row["tree"], "idx": base + i, "n": n, "leaf": node.hex(), "subroot": subroot.hex(), "root": root.hex(),
                                "proof": [p.hex() for p in proof], "folded_root": folded.hex(), "verified": folded == root})
                yield pa.RecordBatch.from_pylist(out, schema=PROOF_ARROW)
    return run


@dataclass
class Manifest:
    """Logs of the trees and of the tree above them, and the proof of every row."""

    trees: Forest
    top: Forest
    proofs: DataFrame


def manifest(rows: DataFrame, columns: list[str], tree: str, key: str, changed: Column | None = None, bits: int = BITS) -> Manifest:
    """Merkle trees over ``columns``, one per value of ``tree``, leaves by ``key``.

    ``changed`` is a leaf digest to fold instead of the row's own (null: its
    own), for checking rows against an earlier manifest.  Null keys come first,
    a null tree value is a tree of its own before the others, rows with one key
    stand in the order of their digests, and an empty table has no proofs.
    Columns that are not named take no part.  Values enter whole, whatever
    their length.
    """
    leaves = rows.select(F.col(tree).alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf(columns).alias("digest"),
                         (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    # The last order column parts rows that repeat whole, so that many copies of one row are many ranges too.
    leaves = persisted(leaves, "merkle-leaves").withColumn("_scan", F.monotonically_increasing_id())
    trees = build(_placed(leaves, ["doc_id", "digest", "_scan"]).drop("_scan"), bits)
    roots = trees.roots()
    names = persisted(_placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"]), "merkle-roots")
    tops = build(names.select("tree", "n", "idx", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")), bits, "top")
    whole = tops.roots().select(F.col("tree").alias("atree"), F.col("root").alias("above"))
    placed = paths(tops, whole).select("tree", "n", "block", "nodes", "path", "above").mapInArrow(_tops(bits), "aidx long, above binary")
    above = persisted(names.select("name", "idx").join(placed, F.col("idx") == F.col("aidx")).select(F.col("name").alias("atree"), "above"), "merkle-above")
    return Manifest(trees, tops, paths(trees, above).mapInArrow(_proofs(bits), PROOF))


DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def document_proofs(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a changed n_chars does to it.

    Where 7 divides the CRC-32 of the decimal doc_id, the leaf to fold has
    n_chars one higher; a null n_chars or doc_id leaves it as it is.
    """
    given = docs.select(*DOCUMENT)
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    later = leaf(["doc_id", "source", "lang", "_more", "text"])
    touched = given.withColumn("_more", F.col("n_chars").cast("decimal(20,0)") + 1)
    found = manifest(touched, DOCUMENT, "lang", "doc_id", F.when(hit, later), bits).proofs
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified",
                        F.col("idx").alias("leaf_index"), F.col("n").alias("n_leaves"))
