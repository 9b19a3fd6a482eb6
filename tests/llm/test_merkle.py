import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle, queries

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, `a.b` string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root of a list of digests, and every one's siblings with the side they stand on, by the rule of the manifest."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[i : i + 2], groups[i : i + 2]) for i in range(0, len(nodes), 2)]
        for pair, members in runs:
            for side, group in enumerate(members):
                for m in group:
                    paths[m].append((1 - side, pair[1 - side]) if len(pair) == 2 else (0, ""))
        nodes, groups = [H(*pair) for pair, _ in runs], [sum(members, []) for _, members in runs]
    return nodes[0], paths


def want(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[x] = tree([leaf(r) for r in langs[x]])
    root, tops = tree([trees[x][0] for x in order])
    out = []
    for x, top in zip(order, tops, strict=True):
        for r, own in zip(langs[x], trees[x][1], strict=True):
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                now = leaf((*r[:3], r[3] + 1, r[4]))
            for side, other in own + top:
                now = H(other, now) if side == 0 else H(now, other)  # a lone node: other is empty
            out.append((r[0], leaf(r), trees[x][0], root, H(*[d for _, d in own + top]), now, now == root))
    return sorted(out, key=str)


def got(spark, path, rows):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, str(path)).collect()), key=str)


def some(n, langs, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice(langs), rng.choice([None, i, 2**63 - 1]), rng.choice([None, "", "text 💡" * rng.randrange(4), "1:2"])) for i in range(n)]
    return rows + rng.choices(rows, k=n // 5) + [(None, "s", langs[0], 5, "no id")] * 2


@pytest.mark.parametrize(("n", "langs"), [(1, ["en"]), (2, ["en"]), (300, ["en", None, "é", "zz", "a.b", ""]), (97, ["x"])])
def test_every_row_against_a_plain_tree(spark, tmp_path, n, langs):
    rows = some(n, langs, n)
    assert got(spark, tmp_path, rows) == want(rows)


def test_lone_row_and_empty_table(spark, tmp_path):
    rows = [(3, None, None, None, None)]
    assert got(spark, tmp_path, rows) == want(rows)
    assert got(spark, tmp_path, rows)[0][4] == H("")
    assert got(spark, tmp_path, []) == []


def test_rounds_of_blocks_and_many_trees(spark, tmp_path):
    """Blocks of four and a top of three: several rounds, trees merged while more than fit on the driver. One tree holds most rows."""
    rng = random.Random(5)
    rows = [(i, "s", rng.choice(["hot"] * 9 + [f"l{rng.randrange(23)}"]), i, f"t{i}") for i in range(400)]
    found = merkle.of_documents(spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string"), lambda d: F.crc32(d.cast("string")) % 7 == 0, top=3, bits=2)
    proof = F.sha2(F.array_join(merkle.siblings(F.col("steps")), ""), 256)
    assert sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()), key=str) == want(rows)


def test_a_long_text_is_one_value(spark):
    long = "añ💡 " * 2_000_000
    found = merkle.of_documents(spark.createDataFrame([(1, "s", "en", 3, long), (2, "s", "en", 3, "b")], "doc_id bigint, source string, lang string, n_chars bigint, text string")).collect()
    assert {r.doc_id: r.leaf for r in found}[1] == leaf((1, "s", "en", 3, long)) and all(r.verified for r in found)
