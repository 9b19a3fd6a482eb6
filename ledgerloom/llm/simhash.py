"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits; bit b is set where over half the 4-word shingles have it set in their XXH64.
Fingerprints that differ in `radius` = 4 bits or fewer are linked. Cut into three segments, two linked
fingerprints have a segment that differs in at most one bit (4 // 3 = 1). So each fingerprint is indexed
by every segment with one bit made a wildcard: 64 variants, which meet in an equality join and are then
verified over all bits. A pair is taken at the first variant it shares only, inside the join.

Equal fingerprints are one class before the join, so large groups of copies cost one row. The texts are read and
hashed once; what follows reads the stored fingerprints. A bucket of an index has about n / 2^20 of n distinct
fingerprints, so 1e9 of them make some 2e13 candidate pairs, each an exclusive-or and a bit count inside the join. Components are
found by large-star and small-star steps over the links between classes; every step is an aggregate and a
join on the node, checkpointed, and nothing is collected but a count and a checksum.

Edge cases: null or wordless text has fingerprint zero, linked like any other; a null doc_id is kept and
counts as no smallest id; repeated rows are repeated in the result; further columns are ignored or kept, whatever their
names; a document of any length is one text, hashed in runs of 65,536 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, fresh, frugal, numbered, quoted, stored

WORDS, SEED, RADIUS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1).cast(pa.large_binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(found.view(np.int64))], ["doc_id", *batch.schema.names[2:], "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns `keep` and fp, the fingerprint as a signed long."""
    rows = docs.select("doc_id", "text", *keep)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep)]
    return rows.mapInArrow(frugal(_fingerprints), ", ".join([*kinds, "fp bigint"]))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(classes: DataFrame, node: str = "fp") -> DataFrame:
    """The pairs (a, b) of the nodes of distinct fingerprints in `classes.fp` that differ in RADIUS bits or fewer, each once."""
    full = (1 << 64) - 1
    variants = F.array(*[F.struct(F.lit(bit).alias("wild"), F.col("fp").bitwiseAND(F.lit(signed(sum(1 << i for i in range(a, b)) & full & ~(1 << bit)))).alias("rest")) for a, b in SEGMENTS for bit in range(a, b)])
    index = classes.select("fp", F.col(node).alias("node"), F.explode(variants).alias("v")).select("fp", "node", "v.wild", "v.rest")
    a, b = index.alias("a"), index.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    inside = [apart.bitwiseAND(F.lit(signed(sum(1 << i for i in range(x, y))))) for x, y in SEGMENTS]
    first = F.when(F.bit_count(inside[0]) <= 1, 0).when(F.bit_count(inside[1]) <= 1, 1).otherwise(2)
    wild = F.col("a.wild")
    own = F.when(wild < SEGMENTS[1][0], 0).when(wild < SEGMENTS[2][0], 1).otherwise(2)
    differs = F.when(own == 0, inside[0]).when(own == 1, inside[1]).otherwise(inside[2])
    low = F.when(own == 0, SEGMENTS[0][0]).when(own == 1, SEGMENTS[1][0]).otherwise(SEGMENTS[2][0])
    once = (first == own) & ((differs != 0) | (wild == low))
    on = (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= RADIUS) & once
    # Spark sizes a side by the classes' file, as if the 64 variants of each were one row, and would broadcast it.
    return a.join(b.hint("merge"), on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs (a, b): node and root, the smallest node reachable."""
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        small = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _prints(rows: DataFrame, row: str) -> DataFrame:
    """doc_id, fp and place of numbered rows, computed once."""
    return stored(fingerprints(rows.select("doc_id", "text", row), row).withColumnRenamed(row, "place"))


def near_duplicates(docs: DataFrame, is_table: bool = False) -> DataFrame:
    """One row a document: doc_id, fp, component_id (smallest doc_id reachable over links, its own included), place (of the
    row in its stored table, see `numbered`) and stays: the one row of each component that stays has the smallest doc_id,
    and among equal ones the first place."""
    docs = docs.select("doc_id", "text")
    (row,) = fresh(docs, "row")
    return _joined(_prints(numbered(docs, row, is_table), row))


def _joined(prints: DataFrame) -> DataFrame:
    """doc_id, fp and place of all documents, with component_id and stays."""
    # The node of a class is its first document, so the root of a component is the document that stays and gives the id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "place"))
    classes = stored(prints.groupBy("fp").agg(first.alias("node")))
    roots = components(links(classes, "node"))
    placed = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    found = prints.join(placed, "fp")
    return found.select("doc_id", "fp", F.col("root.doc_id").alias("component_id"), "place", (F.col("place") == F.col("root.place")).alias("stays"))


def one_of_each(docs: DataFrame, is_table: bool = False) -> DataFrame:
    """The documents that stay, with all their columns."""
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row, is_table)
    stay = _joined(_prints(rows, row)).filter("stays").select(F.col("place").alias(row))
    return rows.join(stay, row, "left_semi").select(*[quoted(c) for c in docs.columns])
