"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: on a sample of at most `SAMPLE` = 8,192 distinct vectors (least hash of the id), the vectors are centred, turned onto
their principal axes and rotated so that signs lose least (iterative quantization); `ROTATIONS` = 4 rotations give
4 bits a dimension. The search radius is fitted on the same sample: the Hamming distance within which 98 % of true
neighbours of sample queries lie. Every row is numbered and coded once and stored with its code.

Index: a code is split into substrings of 16 bits, each with its table of buckets. By the pigeonhole principle a code
within radius r agrees with the query in some substring k up to r_k flips, where the r_k + 1 sum to r + 1. So probing each
table at every value within r_k finds every code within r; these are verified on all bits and reranked by
Euclidean distance of the original vectors in double precision. Probing pays where r is small against the code's
length. Where the probes would touch as many rows as there are (expected from r alone, as for vectors without structure,
whose nearest neighbours are nearly as far as the others), all codes are compared instead, which finds the same set.
A block in which fewer than `k` codes lie within r gives its k nearest codes, so no query is left short.

Rows are dealt into blocks of about `ROWS` by a hash of their place, and queries into blocks of `QUERIES`;
each pair of blocks is one task's work, so memory is bounded and equal vectors, however many, are spread
evenly. Each pair returns its k best, from which the k best of each query are taken. Rows are copied once for each
65,536 queries: at 1e9 rows, of which 1e7 ask, 153 times.

Edge cases: vectors that are null, zero, of another length than most of the sample, or that hold null or
non-finite components take no part; repeated ids are separate rows, and only the query's own row is left
out; ties go to the smaller id, a null id last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import frugal, stored

SAMPLE, ROTATIONS, STEPS, RECALL = 8192, 4, 25, 0.98
ROWS, QUERIES = 32_768, 65_536
BITS = 16


class Codes:
    def __init__(self, sample: np.ndarray, k: int):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        turned = centred @ axes
        rotations = []
        for seed in range(ROTATIONS):
            r = np.linalg.qr(np.random.default_rng(seed).normal(size=(turned.shape[1],) * 2))[0]
            for _ in range(STEPS):
                u, _, v = np.linalg.svd(np.where(turned @ r > 0, 1.0, -1.0).T @ turned)
                r = (u @ v).T
            rotations.append(r)
        self.turn = np.concatenate([axes @ r for r in rotations], axis=1)
        self.radius = self.fitted(sample, k)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of 64-bit words for each vector."""
        bits = np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)

    def fitted(self, sample: np.ndarray, k: int) -> int:
        codes, found = self.of(sample), []
        for q in range(0, len(sample), max(1, len(sample) // 256)):
            far = ((sample - sample[q]) ** 2).sum(axis=1)
            near = np.argsort(far)[: k + 1]
            found.append(apart(codes[near[near != q]], codes[q]))
        found = np.concatenate(found) if found else np.zeros(0)
        return int(np.quantile(found, RECALL, method="higher")) if len(found) else self.turn.shape[1]


def apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hamming distances."""
    out = np.zeros(len(codes), np.int64)
    for k in range(len(code)):
        out += np.bitwise_count(codes[:, k] ^ code[k])
    return out


class Index:
    """The substring tables of a block of codes; radius and flips say how they are probed."""

    #: The values of a substring, nearest to zero first, and how many are within 0, 1, ... BITS flips.
    VALUES = np.argsort(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)), kind="stable")
    WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)), minlength=BITS + 1))

    def __init__(self, codes: np.ndarray, radius: int, bits: int):
        self.codes, self.radius = codes, radius
        n = -(-bits // BITS)
        self.parts = codes.view(np.uint16)[:, :n]
        # r_k + 1 sum to r + 1; a table with r_k = -1 need not be probed.
        each, more = divmod(radius + 1, n)
        self.flips = [min(BITS, each - 1 + (t < more)) for t in range(n)]
        # The rows that probes touch, of rows spread evenly over the values.
        self.prunes = sum(self.WITHIN[f] for f in self.flips if f >= 0) < (1 << BITS)
        self.touched = 0
        if self.prunes:
            self.order = np.argsort(self.parts, axis=0, kind="stable").T
            self.starts = [np.searchsorted(self.parts[o, t], np.arange((1 << BITS) + 1)) for t, o in enumerate(self.order)]

    def within(self, code: np.ndarray) -> np.ndarray:
        """The rows within the radius."""
        if not self.prunes:
            self.touched += len(self.codes)
            return np.flatnonzero(apart(self.codes, code) <= self.radius)
        seen, asked = [], code.view(np.uint16)
        for t, flips in enumerate(self.flips):
            if flips >= 0:
                buckets = self.VALUES[: self.WITHIN[flips]] ^ int(asked[t])
                low, size = self.starts[t][buckets], self.starts[t][buckets + 1] - self.starts[t][buckets]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
                seen.append(self.order[t][at])
        rows = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        self.touched += len(rows)
        return rows[apart(self.codes[rows], code) <= self.radius]


def _vectors(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dims)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint64) for x in column.to_pylist()])


def _coder(codes: Codes, dims: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = codes.of(np.asarray(batch.column("vector").flatten()).reshape(-1, dims)) if batch.num_rows else np.zeros((0, 1), np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in found], pa.binary())], [*batch.schema.names, "code"])

    return add


FOUND = "q_row bigint, query_id bigint, vec_id bigint, v_row bigint, score double"


def _searcher(radius: int, k: int, dims: int) -> Callable:
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            vectors, wanted = _vectors(rows.column("vector"), dims), _vectors(queries.column("asked"), dims)
            own, asked = _codes(rows.column("code")), _codes(queries.column("asked_code"))
            index = Index(own, radius, ROTATIONS * dims)
            row_ids, vec_ids = rows.column("v_row").to_numpy(), rows.column("vec_id").to_pylist()
            order = np.array([float("inf") if v is None else v for v in vec_ids])
            for q, (q_row, query_id) in enumerate(zip(queries.column("q_row").to_pylist(), queries.column("query_id").to_pylist(), strict=True)):
                near = index.within(asked[q])
                near = near[row_ids[near] != q_row]
                if len(near) < k:
                    far = apart(own, asked[q])
                    far[row_ids == q_row] = 1 << 30
                    near = np.argsort(far, kind="stable")[: min(k, int((row_ids != q_row).sum()))]
                score = np.sqrt(((vectors[near] - wanted[q]) ** 2).sum(axis=1))
                for i in np.lexsort((order[near], score))[:k]:
                    out.append((q_row, query_id, vec_ids[near[i]], int(row_ids[near[i]]), float(score[i])))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = ["q_row", "query_id", "vec_id", "v_row", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    return search


def sound(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, rows_a_block: int = ROWS, queries_a_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row of vectors (vec_id, embedding) for which is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.withColumn("v_row", F.monotonically_increasing_id())
    rows = rows.select("v_row", F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(sound("vector"))
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vector")).limit(SAMPLE).toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = np.array([len(v) for v in sample])
    dims = int(np.bincount(sizes).argmax())
    codes = Codes(np.unique(np.stack([np.asarray(v, float) for v in sample if len(v) == dims]), axis=0), k)
    rows = rows.filter(F.size("vector") == dims)
    rows = stored(rows.mapInArrow(frugal(_coder(codes, dims)), "v_row bigint, vec_id bigint, vector array<double>, asks boolean, code binary"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    v_blocks, q_blocks = max(1, -(-n // rows_a_block)), max(1, -(-asking // queries_a_block))
    deal = lambda name, blocks: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.select(deal("v_row", v_blocks).alias("vb"), each(q_blocks).alias("qb"), "v_row", "vec_id", "vector", "code")
    # Both sides come from one table: all columns of the queries are named anew, or pruning would mix them up.
    queries = rows.filter("asks").select(F.col("v_row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.col("code").alias("asked_code"))
    right = queries.select(deal("q_row", q_blocks).alias("qb"), each(v_blocks).alias("vb"), "q_row", "query_id", "asked", "asked_code")
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_searcher(codes.radius, k, dims), FOUND)
    best = Window.partitionBy("q_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "v_row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
