import math

import numpy as np

from ledgerloom.llm import ann, queries
from pyspark.sql import functions as F


def exact(ids, x, k=10):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        order = np.lexsort((ids, far))[:k]
        out[int(ids[q])] = [(int(ids[i]), far[i]) for i in order if np.isfinite(far[i])]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(want)
    hits = total = 0
    for q, best in want.items():
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, len(best) + 1))
        assert [(r[2], r[1]) for r in rows] == sorted((r[2], r[1]) for r in rows)
        hits += len({r[1] for r in rows} & {b[0] for b in best})
        total += len(best)
    return hits / total


def test_recall_on_the_driver_table(spark):
    d = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    want = exact(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float))
    got = queries.op5_nearest_neighbours(spark, d).collect()
    assert recall(got, want) >= 0.95


def test_blocks_of_rows_and_queries_keep_the_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    ids = np.arange(3000) * 20
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, rows_a_block=500, queries_a_block=100).collect()
    assert recall(got, exact(ids, x)) >= 0.9


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    for words, bits in ((1, 64), (2, 96)):
        codes = rng.integers(0, 1 << 63, (2000, words), dtype=np.uint64) * np.uint64(2)
        codes[:, -1] &= np.uint64((1 << (bits - 64 * (words - 1))) - 1)
        codes[1000:] = codes[:1000] ^ (np.uint64(1) << rng.integers(0, 32, (1000, words), dtype=np.uint64))
        for radius in (0, 3, 5, 11, 17, 30, 48, bits):
            index = ann.Index(codes, radius, bits)
            for q in range(0, 2000, 97):
                assert index.within(codes[q]).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(axis=1) <= radius).tolist()


def test_probes_touch_few_rows_of_vectors_with_structure():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 32)).repeat(50, axis=0) + rng.normal(size=(2000, 32)) * 0.02
    codes = ann.Codes(x, 10)
    own = codes.of(x)
    index = ann.Index(own, codes.radius, ann.ROTATIONS * 32)
    asked = range(0, 2000, 37)
    found = sum(len(index.within(own[q])) for q in asked)
    assert index.prunes and index.touched <= 0.2 * 2000 * len(asked) and found >= 10 * len(asked)


def test_equal_vectors_and_unsound_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(100, [1.0, 2.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 2.5]), (0, [1.0, 2.0]), (800, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, v_row int")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted({r.query_id for r in got}) == [0, 100] and len(got) == 30
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 100), key=lambda r: r["rank"])] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(r.score == 0 for r in got)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0]), (None, [5.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()]
    assert got == [(1, 1, math.sqrt(10)), (2, None, 4.0)] or got == [(1, 1, math.sqrt(10)), (2, None, 4.0)][::-1]


def test_columns_may_be_pruned(spark):
    found = queries.op5_nearest_neighbours(spark, "/root/testdata/sf0.001")
    assert found.count() == len(found.select("rank").collect()) > 0


def test_empty_table(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []
