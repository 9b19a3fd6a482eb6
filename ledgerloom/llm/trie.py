"""Prefix trie of conversations: the Cartesian tree of the LCP array of the sorted conversations.

1. A turn is a 128-bit digest of its role and text and a count of code points; a conversation is one row with the digests of its
   turns in order, so that comparing the bytes of two rows compares their turns. Texts are read once, and not kept.
2. Conversations are range-partitioned and sorted by those bytes and conv_id and checkpointed; the partitions are the blocks.
   Conversations that share a prefix are neighbours, and the LCP array says how many turns neighbours share. Equal
   conversations are cut between blocks like others.
3. One pass over the blocks gives the least LCP, the counts and sums of each: one row of numbers a block, which the driver keeps.
4. A second pass finds for every interval of the LCP array where the next smaller value ends it, with a stack. An entry of
   the stack stands for all depths between two LCP values, the nodes that have the same members: equal values meet in one
   entry, and the depths in between are written out when it ends. Counts, least ids, leaves and saved code points are
   handed down the stack, so each conversation is looked at once.
5. What a block cannot end by itself is the path to its last conversation: nodes known by block and depth. The block minima
   say in which block each ends, the sums say what the blocks in between add, and a join with the prefix minima of the last
   block gives the rest. Nodes whose parent was such a one get its id by a join, one row for each block and parent.

A conversation is one row of 36 bytes a turn, and all else is bounded by a block, whose size follows the number of turns.
The members that end at one node are hashed in order of id, in parts where they lie in several blocks.

Edge cases: turns are ordered by turn (null first), and those of equal turn by role and text; a null role or text is empty; rows
without a conv_id belong to no conversation; equal rows are turns of their own; conversations without turns end at the root;
an empty table gives no nodes, not even a root; further columns are ignored, whatever their names; texts of any length are
hashed by the JVM in one call.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, frugal, stored

#: Bytes of a turn's digest, turns that a block should hold, and ids in a part of a list of members.
DIGEST, BLOCK_TURNS, PART = 16, 1_000_000, 65_536
#: Conversations are grown anew from the first turns of the conversation at the start of their hundred, fewer than this.
FAMILY, HEADS = 100, 6
NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, chars) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = rows.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST)
    turns = known.select("conv_id", F.row_number().over(order).alias("at"), digest.alias("digest"), F.length("text").alias("chars"))
    listed = F.array_sort(F.collect_list(F.struct("at", "digest", "chars")))
    return turns.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def regrown(convs: DataFrame) -> DataFrame:
    """Every conversation c with the first crc32(c) % HEADS turns of the conversation at the start of its family, if there is one,
    in place of as many of its own."""
    heads = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, HEADS - 1).alias("__head"))
    own = convs.withColumns({"__of": F.col("conv_id") - F.col("conv_id") % FAMILY, "__h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")})
    joined = own.join(heads, F.col("__of") == F.col("__base"), "left")
    head = F.coalesce(F.slice("__head", F.lit(1), F.col("__h")), F.filter("turns", lambda t: F.lit(False)))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("__h") + 1, F.size("turns"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """How many turns two conversations share at their start."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGEST
    at = 0
    while a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[int]]]:
    for batch in batches:
        for conv, key, chars in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            yield conv.as_py(), key.as_py(), chars.as_py()


SUMMARY = "block int, n bigint, first binary, first_chars array<int>, last binary, low bigint, low_kids bigint, sums bigint, leaves bigint, least bigint"


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a block that holds anything, all that needs no neighbour: LCP values inside the block only."""
    n, first, chars0, last, low, kids, sums, leaves, least = 0, b"", [], b"", None, 0, 0, 0, None
    for conv, key, chars in _rows(batches):
        least = conv if least is None else min(least, conv)
        if n == 0:
            first, chars0 = key, chars
        else:
            v = common(last, key)
            new = len(key) > v * DIGEST
            if low is None or v < low:
                low, kids = v, 0
            kids += new and v == low
            sums += sum(chars[:v])
            leaves += v * DIGEST < len(last)
        n, last = n + 1, key
    if n:
        row = [[TaskContext.get().partitionId()], [n], [first], [chars0], [last], [low], [kids], [sums], [leaves], [least]]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SUMMARY.split(", ")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCP and its code points between the last conversation of a block and the first of the next."""
    for batch in batches:
        at, upto = [], []
        for before, first, chars in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            v = common(before.as_py(), first.as_py())
            at.append(v)
            upto.append(sum(chars.as_py()[:v]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), pa.array(upto, pa.int64())], names=["block", "met", "upto"])


@dataclass
class Blocks:
    """Numbers of the blocks that hold anything, in order: as many as partitions."""

    ids: np.ndarray
    n: np.ndarray
    met: np.ndarray  # LCP of the first conversation with the one before; -1 for the very first
    low: np.ndarray  # least LCP, met included
    kids: np.ndarray  # conversations that leave the path at `low`
    sums: np.ndarray  # of the code points shared with the conversation before
    leaves: np.ndarray
    least: np.ndarray

    def ends(self, k: int, depth: int) -> int:
        """The first block after the k-th in which a node of this depth ends, or the number of blocks."""
        found = np.flatnonzero(self.low[k + 1 :] < depth)
        return k + 1 + int(found[0]) if len(found) else len(self.low)

    def owner(self, k: int, depth: int) -> int:
        """The last block before the k-th in which the node of this depth that reaches into the k-th begins."""
        return int(np.flatnonzero(self.low[:k] < depth)[-1])


def _blocks(order: DataFrame) -> Blocks:
    spark = order.sparkSession
    found = stored(order.mapInArrow(frugal(_summary), SUMMARY))
    rows = sorted(found.drop("first", "first_chars", "last").collect(), key=lambda r: r.block)
    if not rows:
        return Blocks(*[np.zeros(0, np.int64)] * 8)
    extra = {rows[0].block: (-1, 0)}
    if len(rows) > 1:
        pairs = spark.createDataFrame([(a.block, b.block) for a, b in zip(rows[:-1], rows[1:], strict=True)], "before int, block int")
        sides = found.select("block", "first", "first_chars").join(pairs, "block").join(found.select(F.col("block").alias("before"), "last"), "before")
        for r in sides.select("block", "last", "first", "first_chars").mapInArrow(frugal(_met), "block int, met bigint, upto bigint").collect():
            extra[r.block] = (r.met, r.upto)
    sizes = {r.block: r for r in found.select("block", (F.length("first") / DIGEST).cast("bigint").alias("first"), (F.length("last") / DIGEST).cast("bigint").alias("last")).collect()}
    out: dict[str, list[int]] = {c: [] for c in ("met", "low", "kids", "sums", "leaves")}
    for k, r in enumerate(rows):
        met, upto = extra[r.block]
        inner = r.low if r.low is not None else met
        low = min(met, inner)
        out["met"].append(met)
        out["low"].append(low)
        out["kids"].append((r.low_kids if r.low == low else 0) + (met == low and sizes[r.block].first > met))
        out["sums"].append(r.sums + upto)
        following = extra[rows[k + 1].block][0] if k + 1 < len(rows) else -1
        out["leaves"].append(r.leaves + (following < sizes[r.block].last))
    column = lambda name: np.array([getattr(r, name) for r in rows], np.int64)
    return Blocks(column("block"), column("n"), *[np.array(out[c], np.int64) for c in ("met", "low", "kids", "sums", "leaves")], column("least"))


#: Kinds of rows of the second pass: finished nodes, nodes whose parent is not known yet, nodes that the block cannot end,
#: what a block adds to nodes that end in it (those of a depth over `low` up to `depth`), parts of lists of members.
DONE, ORPHAN, OPEN, PREFIX, MEMBERS = range(5)
FOUND = "kind int, block int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, up_block int, low bigint, cum bigint, ends_in int, ends string"
NAMES = [c.split()[0] for c in FOUND.split(", ")]
NONE = -(1 << 62)


class _Table:
    """Rows of FOUND in typed arrays; NONE for null."""

    def __init__(self) -> None:
        self.columns = {c: array("q") for c in NAMES[:-1]}
        self.ends: list[str | None] = []

    def add(self, ends: str | None = None, **values: int) -> int:
        for name, column in self.columns.items():
            column.append(values.get(name, NONE))
        self.ends.append(ends)
        return len(self.ends) - 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = {c.split()[0]: pa.int32() if c.split()[1] == "int" else pa.int64() for c in FOUND.split(", ")[:-1]}
        for at in range(0, len(self.ends), PART):
            data = []
            for name, column in self.columns.items():
                values = np.frombuffer(column, np.int64)[at : at + PART]
                data.append(pa.array(values, pa.int64(), mask=values == NONE).cast(kinds[name]))
            yield pa.RecordBatch.from_arrays([*data, pa.array(self.ends[at : at + PART], pa.string())], names=NAMES)


@dataclass(slots=True)
class _Entry:
    """Nodes of the depths over `low` up to `high` that begin at conversation `at` of the block, all with the same members so far."""

    at: int
    low: int
    high: int
    cum: list[int]  # code points of the first d turns
    least: int
    kids: int = 0  # of the deepest node
    leaves: int = 0
    saved: int = 0  # below the deepest node
    ends: str | None = None
    children: list[int] | None = None  # rows of the deepest node's children


class _Pass:
    """The second pass over one block."""

    def __init__(self, blocks: Blocks, k: int):
        self.blocks, self.k, self.id = blocks, k, int(blocks.ids[k])
        self.out, self.stack = _Table(), []

    def close(self, e: _Entry, down_to: int, at: int, up: _Entry | None) -> None:
        """Write out the nodes of `e` deeper than `down_to`; they end before conversation `at`. `up` has their parent, or it is in an earlier block."""
        members = at - e.at
        leaves = e.leaves + (e.kids == 0)
        row = None
        saved = e.saved
        for d in range(e.high, down_to, -1):
            saved += (members - 1) * (e.cum[d] - e.cum[d - 1] if d else 0)
            below = row
            row = self.out.add(e.ends if d == e.high else None, kind=DONE, depth=d, conv_id=e.least, n_convs=members, n_children=e.kids if d == e.high else 1, n_leaves=leaves, saved_tokens=saved)
            if below is not None:
                self.out.columns["parent_conv_id"][below] = e.least
        for child in e.children or ():
            self.out.columns["parent_conv_id"][child] = e.least
        if up is None:
            if down_to >= 0:
                self.orphan(row, down_to)
        else:
            up.least, up.leaves, up.saved = min(up.least, e.least), up.leaves + leaves, up.saved + saved
            up.children = up.children or []
            up.children.append(row)

    def orphan(self, row: int, depth: int, own: bool = False) -> None:
        """The parent of the row is the node of this depth that an earlier block, or `own`, cannot end."""
        c = self.out.columns
        if c["kind"][row] == DONE:
            c["kind"][row] = ORPHAN
        c["block"][row], c["low"][row] = self.id, depth
        c["up_block"][row] = self.id if own else int(self.blocks.ids[self.blocks.owner(self.k, depth)])

    def members(self, block: int, depth: int, run: list[int]) -> None:
        for p in range(0, len(run), PART):
            self.out.add(",".join(map(str, run[p : p + PART])), kind=MEMBERS, block=block, depth=depth, low=self.id, cum=p)

    def run(self, rows: Iterator[tuple[int, bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        blocks, k, stack = self.blocks, self.k, self.stack
        n, before, sums, leaves, least, lowest, met_kids = 0, b"", 0, 0, None, None, 0
        run: list[int] = []  # ids of the equal conversations that come last
        sums_at, leaves_at = array("q"), array("q")
        for conv, key, chars in rows:
            v = int(blocks.met[k]) if n == 0 else common(before, key)
            depth = len(key) // DIGEST
            cum = list(accumulate(chars, initial=0))
            leaves += n > 0 and v * DIGEST < len(before)
            same = depth == v and v >= 0 and (n == 0 or len(before) == len(key))
            if n and not same:
                self.ended(run, before)
                run = []
            # Nodes deeper than v end here.
            while stack and stack[-1].low >= v:
                e = stack.pop()
                self.close(e, e.low, n, stack[-1] if stack else None)
            if stack and stack[-1].high > v:
                e = stack[-1]
                kept = _Entry(e.at, e.low, v, e.cum, e.least, kids=1)
                self.close(e, v, n, kept)
                stack[-1] = kept
            if not stack and (lowest is None or v < lowest):
                if lowest is not None:
                    self.prefix(lowest, v, n, sums, leaves, least, met_kids)
                lowest, met_kids = v, 0
            sums += cum[v] if v > 0 else 0
            sums_at.append(sums)
            leaves_at.append(leaves)
            least = conv if least is None else min(least, conv)
            if stack:
                stack[-1].least = min(stack[-1].least, conv)
                stack[-1].kids += depth > v
            elif v == lowest:
                met_kids += depth > v
            if depth > v:
                stack.append(_Entry(n, v, depth, cum, conv))
            run.append(conv)
            n, before = n + 1, key
        if n == 0:
            return
        goes_on = k + 1 < len(blocks.ids) and blocks.met[k + 1] * DIGEST == len(before)
        self.ended(run, before, goes_on)
        following = int(blocks.met[k + 1]) if k + 1 < len(blocks.ids) else -1
        leaves += following * DIGEST < len(before)
        self.unfinished(n, sums, leaves, sums_at, leaves_at)
        yield from self.out.batches()

    def ended(self, run: list[int], key: bytes, goes_on: bool = False) -> None:
        """The conversations of a run end at one node. It is the deepest of the stack, or of an earlier block."""
        depth = len(key) // DIGEST
        if self.stack and self.stack[-1].high == depth:
            if goes_on:
                self.members(self.id, depth, run)
            else:
                self.stack[-1].ends = hashlib.sha256(",".join(map(str, run)).encode()).hexdigest()
        else:
            self.members(int(self.blocks.ids[self.blocks.owner(self.k, depth)]), depth, run)

    def prefix(self, depth: int, low: int, n: int, sums: int, leaves: int, least: int, kids: int) -> None:
        """Nodes of earlier blocks deeper than `low` end before conversation n of this one."""
        self.out.add(kind=PREFIX, block=self.id, depth=depth, low=low, n_convs=n, cum=sums, n_leaves=leaves, conv_id=least, n_children=kids)

    def unfinished(self, n: int, sums: int, leaves: int, sums_at: array, leaves_at: array) -> None:
        """The nodes left on the stack, with all that the blocks add in which they do not end."""
        blocks, k, least = self.blocks, self.k, None
        for e in reversed(self.stack):
            least = e.least if least is None else min(least, e.least)
            for child in e.children or ():
                self.orphan(child, e.high, own=True)
            for d in range(e.high, e.low, -1):
                end = blocks.ends(k, d)
                between = slice(k + 1, end)
                count = n - e.at + int(blocks.n[between].sum())
                kids = (e.kids if d == e.high else 1) + int(blocks.kids[between][blocks.low[between] == d].sum())
                shared = sums - sums_at[e.at] + int(blocks.sums[between].sum())
                ending = leaves - leaves_at[e.at] + int(blocks.leaves[between].sum())
                id_ = min([least, *([int(blocks.least[between].min())] if end > k + 1 else [])])
                row = self.out.add(
                    e.ends if d == e.high else None, kind=OPEN, block=self.id, depth=d, conv_id=id_, n_convs=count, n_children=kids, n_leaves=ending, saved_tokens=shared,
                    cum=e.cum[d - 1] if d else 0, ends_in=int(blocks.ids[end]) if end < len(blocks.ids) else -1,
                )
                if d:
                    self.orphan(row, d - 1, own=bool(d - 1 > blocks.low[k]))


def _second(blocks: Blocks):
    place = {int(b): k for k, b in enumerate(blocks.ids)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = place.get(TaskContext.get().partitionId())
        if k is not None:
            yield from _Pass(blocks, k).run(_rows(batches))

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the parts of each node's list of members, sorted, the digest of the whole, one node at a time."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], names=["block", "depth", "whole"])

    for batch in batches:
        for block, depth, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (block, depth) != node:
                if node is not None:
                    yield row()
                node, state = (block, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if node is not None:
        yield row()


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def nodes(convs: DataFrame, parts: int) -> DataFrame:
    """The trie of conversations (conv_id, turns), sorted into `parts` blocks: columns NODE and ends_sha256."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = stored(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars")))
    order = checkpointed(rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"))
    blocks = _blocks(order)
    found = stored(order.mapInArrow(frugal(_second(blocks)), FOUND))
    kind = lambda k: found.filter(F.col("kind") == k)

    parts_of = kind(MEMBERS).repartition("block", "depth").sortWithinPartitions("block", "depth", "low", "cum")
    whole = parts_of.select("block", "depth", "ends").mapInArrow(frugal(_digests), "block int, depth bigint, whole string")
    last = kind(PREFIX).select(F.col("block").alias("ends_in"), F.col("depth").alias("r_high"), F.col("low").alias("r_low"), *[F.col(c).alias(f"r_{c}") for c in ("conv_id", "n_convs", "n_children", "n_leaves", "cum")])
    o = kind(OPEN).alias("o")
    ended = o.join(last.alias("r"), (F.col("o.ends_in") == F.col("r.ends_in")) & (F.col("o.depth") <= F.col("r.r_high")) & (F.col("o.depth") > F.col("r.r_low")), "left").select("o.*", *[f"r.{c}" for c in last.columns if c != "ends_in"])
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    count = plus("n_convs", F.col("r_n_convs"))
    ended = ended.select(
        "block", "depth", "up_block", "low", F.least("conv_id", "r_conv_id").alias("conv_id"), count.alias("n_convs"), plus("n_children", F.when(F.col("depth") == F.col("r_high"), F.col("r_n_children"))).alias("n_children"),
        plus("n_leaves", F.col("r_n_leaves")).alias("n_leaves"), (plus("saved_tokens", F.col("r_cum")) - (count - 1) * F.col("cum")).alias("saved_tokens"), "ends",
    )
    ended = stored(ended.join(whole, ["block", "depth"], "left").withColumn("ends", F.coalesce("whole", "ends")).drop("whole"))

    common_columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    lost = kind(ORPHAN).select("block", "up_block", "low", *common_columns).unionByName(ended.select("block", "up_block", "low", *common_columns))
    # One row for each block and parent, so that a parent with children in every block meets each block once.
    wanted = lost.filter("up_block is not null").select("block", "up_block", "low").distinct()
    named = wanted.join(ended.select(F.col("block").alias("up_block"), F.col("depth").alias("low"), F.col("conv_id").alias("parent_conv_id")), ["up_block", "low"])
    lost = lost.join(named, ["block", "up_block", "low"], "left")
    every = kind(DONE).select("parent_conv_id", *common_columns).unionByName(lost.select("parent_conv_id", *common_columns))
    return every.select(*NODE, F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def trie(rows: DataFrame, families: bool = False, parts: int | None = None) -> DataFrame:
    """The trie of the conversations in rows (conv_id, turn, role, text); with `families`, of the conversations as `regrown`."""
    convs = stored(sequences(rows))
    if parts is None:
        turns = convs.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()[0]
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    return nodes(regrown(convs) if families else convs, parts)
