"""Merkle manifest of a dataset: a tree of binary runs for each value of one column, and one over the roots of those trees.

Large blocks are reduced where their rows lie, a small top is built on the driver and sent back:

1. Every row gets its leaf hash, inside the JVM. What follows works on keys and hashes only.
2. Rows are range-partitioned and sorted by tree and key, checkpointed, and numbered within their tree by the counts of
   (partition, tree): no tree is gathered anywhere, however many rows it holds.
3. Blocks of 2^BLOCK_BITS consecutive nodes are reduced to their head. A tree of several blocks climbs exactly BLOCK_BITS
   levels, its last block too, since a lone last node is hashed by itself as long as its level has others.
4. While more than TOP heads are left, 3 is repeated on them (trees that are down to one node become the nodes of the last
   tree). TOP heads or fewer go to the driver, which builds what is above them; their suffix paths, at most TOP rows of a
   few dozen hashes, are broadcast.
5. Blocks are read a second time: a node's path is its path in the block and its block's suffix. Every row then folds the
   leaf that it claims along its own path, as a column expression.

Edge cases: null is a value of its own for the tree, and comes first; null keys come first in their tree; rows that have
the same key follow by leaf hash, and equal rows are leaves of their own, next to each other; a lone leaf is its
tree's root, and the only tree's root is the manifest's; an empty table gives no rows; further columns are ignored, whatever
their names; a text of any length is one value, hashed by the JVM in one call.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, numbered, stored

BLOCK_BITS, TOP = 12, 4096
#: What the rows of the manifest's documents consist of, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: empty where the run has one node, else where the sibling stands and its hash.
BEFORE, AFTER = "<", ">"


def hashed(values: list[Column]) -> Column:
    """The leaf of a row of values (column expressions that are cast to strings)."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_to(n: int) -> int:
    """How many levels lie between n nodes and their root."""
    return max(0, n - 1).bit_length()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_h("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return found


def path(levels: list[list[str]], at: int) -> list[str]:
    steps = []
    for level in levels[:-1]:
        beside = at ^ 1
        steps.append("" if beside >= len(level) else (BEFORE if at & 1 else AFTER) + level[beside])
        at >>= 1
    return steps


def fold(leaf: Column, steps: Column) -> Column:
    """The root to which a leaf leads along its path."""
    sibling = lambda s: F.substring(s, 2, 64)
    up = lambda h, s: F.sha2(F.when(s == "", h).when(F.startswith(s, F.lit(BEFORE)), F.concat(sibling(s), h)).otherwise(F.concat(h, sibling(s))), 256)
    return F.aggregate(steps, leaf, up)


def siblings(steps: Column) -> Column:
    """The hashes on a path, level by level."""
    return F.transform(F.filter(steps, lambda s: s != ""), lambda s: F.substring(s, 2, 64))


def _heads(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Of a block (tree, at, n, digest; in any order) its head as a node of the next round."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block["n"][0].as_py()
        head = climb(block["digest"].to_pylist(), min(bits, levels_to(n)))[-1][0]
        return pa.table({"tree": block["tree"][:1], "at": pa.array([block["at"][0].as_py() >> bits]), "n": pa.array([-(-n >> bits)]), "digest": pa.array([head])})

    return run


def _pathed(bits: int) -> Callable[[pa.Table], pa.Table]:
    """A block's rows with their whole path: in the block, then the block's own."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        levels = climb(block["digest"].to_pylist(), min(bits, levels_to(block["n"][0].as_py())))
        above = block["up"][0].as_py()
        whole = [path(levels, i) + above for i in range(block.num_rows)]
        return block.drop_columns(["block", "up", "n"]).append_column("steps", pa.array(whole, pa.list_(pa.string())))

    return run


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree and others) with at, the place within the tree by `order`, and n, the tree's size. Rows that `order` leaves equal
    must be interchangeable; they are dealt to partitions by where they are stored."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["tree", *[F.asc_nulls_first(c) for c in order], "spread"]
    rows = checkpointed(numbered(rows, "spread").repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("spread"))
    # The checkpoint's partitions stay as they are, so that these two are the same in every job.
    rows = rows.withColumns({"part": F.spark_partition_id(), "mark": F.monotonically_increasing_id()})
    runs = rows.groupBy("tree", "part").agg(F.count("*").alias("__n"), F.min("mark").alias("__first"))
    of_tree = Window.partitionBy("tree")
    runs = runs.withColumn("__before", F.sum("__n").over(of_tree.orderBy("part")) - F.col("__n")).withColumn("n", F.sum("__n").over(of_tree))
    runs = runs.select(F.col("tree").alias("__tree"), F.col("part").alias("__part"), "__first", "__before", "n")
    found = rows.join(runs, (F.col("tree") == F.col("__tree")) & (F.col("part") == F.col("__part")))
    return found.withColumn("at", F.col("mark") - F.col("__first") + F.col("__before")).drop("part", "mark", "__tree", "__part", "__first", "__before")


def _top(nodes: DataFrame, merged: bool) -> DataFrame:
    """The same as _finished, for TOP nodes at most, on the driver."""
    trees: dict[str, list[str]] = {}
    for row in sorted(nodes.select("tree", "at", "digest").collect(), key=lambda r: (r.tree.encode(), r.at)):
        trees.setdefault(row.tree, []).append(row.digest)
    grown = {t: climb(d, levels_to(len(d))) for t, d in trees.items()}
    last = climb([g[-1][0] for g in grown.values()], levels_to(len(grown)))
    rows = []
    for k, (t, g) in enumerate(grown.items()):
        for at in range(len(g[0])):
            rows.append((t, at, path(g, at) + path(last, k), None if merged else g[-1][0], last[-1][0]))
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, "tree string, at bigint, steps array<string>, subroot string, root string"))


def _finished(nodes: DataFrame, top: int, bits: int, merged: bool = False) -> DataFrame:
    """Stored nodes (tree, at, n, digest) with steps (the path to the root), subroot (their tree's root) and root. `merged`: the nodes
    are already those of the last tree."""
    spark = nodes.sparkSession
    total, largest = nodes.agg(F.count("*"), F.max("n")).first()
    if total <= top:
        return _top(nodes, merged)
    if largest == 1:
        # More trees than fit on the driver, each down to its root.
        last = stored(placed(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("__of"), "digest"), "__of"))
        up = _finished(last.select("tree", "at", "n", "digest"), top, bits, merged=True).select(F.col("at").alias("__at"), "steps", "root")
        return last.join(up, F.col("at") == F.col("__at")).select(F.col("__of").alias("tree"), F.lit(0).cast("bigint").alias("at"), "steps", F.col("digest").alias("subroot"), "root")
    return through_blocks(nodes, top, bits, merged).drop("digest")


def through_blocks(nodes: DataFrame, top: int, bits: int, merged: bool = False) -> DataFrame:
    """nodes (tree, at, n, digest, others) without n, with steps, subroot and root: one round of blocks and what is above them."""
    rows = nodes.withColumn("block", F.shiftright("at", bits))
    kept = [c for c in nodes.columns if c != "n"]
    heads = rows.select("tree", "block", "at", "n", "digest").groupBy("tree", "block").applyInArrow(_heads(bits), "tree string, at bigint, n bigint, digest string")
    up = _finished(stored(heads), top, bits, merged).select(F.col("tree").alias("__tree"), F.col("at").alias("__block"), F.col("steps").alias("up"), "subroot", "root")
    joined = rows.join(up, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__block"))).drop("__tree", "__block")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in [*kept, "subroot", "root"])
    return joined.select(*kept, "subroot", "root", "n", "block", "up").groupBy("tree", "block").applyInArrow(_pathed(bits), shape + ", steps array<string>")


def manifest(rows: DataFrame, key: str, tree: str, leaf: Column, claimed: Column | None = None, top: int = TOP, bits: int = BLOCK_BITS) -> DataFrame:
    """The key of every row with leaf, subroot, root, steps (the path to the root), folded_root (what the row's claimed leaf leads to
    along its path; where `claimed` is null it claims its own) and verified (whether that is the root)."""
    # The tree's name begins with 0 for null and 1 for a value, so that trees are told apart and null comes first.
    name = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))
    leaves = rows.select(name.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claim"))
    nodes = stored(placed(leaves, "key", "digest"))
    found = through_blocks(nodes, top, bits).withColumn("folded_root", fold(F.coalesce("claim", "digest"), F.col("steps")))
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "steps", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def of_documents(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, top: int = TOP, bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest of documents by lang. Where `tampered` of doc_id holds, the claimed leaf has one more character than the row's n_chars."""
    values = {c: F.col(c) for c in FIELDS}
    leaf = hashed(list(values.values()))
    claimed = None
    if tampered is not None:
        more = {**values, "n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
        claimed = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), hashed(list(more.values())))
    return manifest(docs, "doc_id", "lang", leaf, claimed, top, bits)
