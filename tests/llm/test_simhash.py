import random

import xxhash

from ledgerloom.llm import queries, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(prints))


def run(spark, path, rows):
    spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, fp int").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return sorted(tuple(r) for r in queries.op8_simhash_near_dedup(spark, str(path)).collect())


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((6, 60, 400)))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 + group, "\x0b ".join(copy).upper()))
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "One"), (9003, "one")]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_no_break_space_is_part_of_a_word():
    assert simhash.fingerprint("a b c d e".encode()) == brute_fingerprint("a b c d e")


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(1)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(8):
            prints.add(f)
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
    prints = sorted(simhash.signed(f) for f in prints)
    pairs = simhash.links(spark.createDataFrame([(f,) for f in prints], "fp bigint"))
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(r) for r in pairs.collect()]
    got = [(min(p), max(p)) for p in got]
    assert len(got) == len(want) and set(got) == want
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    for a, b in want:
        assert roots.get(a, a) == roots.get(b, b)


def test_long_chain_is_one_component(spark):
    pairs = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in simhash.components(pairs).collect()} == {0}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_clashing_names_shuffled_input_and_a_long_text(spark):
    long = " ".join(f"word{i % 977}" for i in range(300_000))
    rows = [(i, long if i < 4 else f"text of {i} alone {i * i} {i * 31}", f"r{i}", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __llm_row string, place int").repartition(4, "place")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    want = {c for _, _, c in brute([(i, t) for i, t, _, _ in rows])}
    assert sorted((r.doc_id, r["__llm_row"], r.place) for r in left.collect()) == sorted((i, f"r{i}", i) for i in want)


def test_one_document_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "b"), (3, text, "a"), (3, text, "a"), (None, text, "n"), (9, "other words here", "c"), (None, "lone text of nobody", "d"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.fp) for r in left.collect()), key=str) == sorted([(3, "a"), (9, "c"), (None, "d"), (None, None)], key=str)


def test_columns_of_any_name_come_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, 1), (2, "a b c d e", 6, 2), (3, "quite another text than that", 7, 3)], "doc_id bigint, text string, `a.b` int, `c``d` int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and sorted(tuple(r)[0] for r in got.collect()) == [1, 3]


def test_variants_are_not_broadcast(spark, tmp_path):
    """The classes' file is small; 64 variants of each row are not."""
    spark.range(2000).selectExpr("xxhash64(id) as fp", "id as node").write.parquet(f"{tmp_path}/classes")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/classes"), "node")
    assert found.count() == 0
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
