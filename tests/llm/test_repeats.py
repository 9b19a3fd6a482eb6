import hashlib
import random
from collections import Counter

import pyarrow as pa

from ledgerloom.llm import queries, repeats

N = repeats.LENGTH


def brute(texts):
    seen = Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, path, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, key string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in queries.op2_suffix_dedup(spark, str(path)).collect())
    want = [(i, *x) for i, x in enumerate(brute([(t or "").encode() for t in texts]))]
    assert got == want


def words(rng, n):
    return " ".join("".join(rng.choices("abcdéfg", k=rng.randrange(2, 9))) for _ in range(n))


def test_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    shared = [words(rng, n) for n in (60, 70, 80, 90, 120, 300)]
    texts = [None, "", "short", "short", "a" * 399, "b" * 1000, "ab" * 700, ("xyz" * 130) + "q" + ("xyz" * 150)]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts.append(rng.choice([s, s[a:], s[:a], words(rng, rng.randrange(3, 60))]))
        texts.append(" ".join(parts))
    base = words(rng, 400)
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    texts += [texts[10], texts[10], texts[-1]]
    check(spark, tmp_path, texts)


def test_windows_meet_at_every_alignment(spark, tmp_path):
    rng = random.Random(2)
    passage = words(rng, 200)
    texts = [words(rng, 20) + passage[i : i + N + rng.randrange(-3, 60)] + words(rng, 20) for i in range(0, 300, 13)]
    check(spark, tmp_path, texts)


def test_exactly_the_length(spark, tmp_path):
    rng = random.Random(4)
    p = words(rng, 100)[:N]
    check(spark, tmp_path, ["1" + p + "2", "3" + p + "4", "5" + p[:-1] + "6", p, p[1:]])


def test_empty_table(spark, tmp_path):
    check(spark, tmp_path, [])


def test_strings_on_which_polynomial_hashes_agree_are_told_apart(spark, tmp_path):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    check(spark, tmp_path, [one, one.translate(str.maketrans("ab", "ba")), "x" + one[:500] + "y", "z" + one[:500] + "w"])


def test_equal_suffixes_over_many_partitions(spark, tmp_path):
    rng = random.Random(8)
    passage = words(rng, 120)[:450]
    texts = ["".join(rng.choices("abcdefgh", k=rng.randrange(20, 400))) + passage + "".join(rng.choices("stuvwxyz", k=60)) for _ in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check(spark, tmp_path, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_neighbours_across_batches():
    rows = [(b"k%d" % i, i, True, c, 0, 0, b"r") for i, c in enumerate([1, 2, 2, 2, 3, 4, 4, 5])]
    names = ["key", "s", "once", "c1", "c2", "before", "around"]
    kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names) for i in range(0, len(rows), size)]
        out = [r for b in repeats._neighbours(iter(batches)) for r in b.to_pylist()]
        assert sorted(r["s"] for r in out if not r["edge"]) == [1, 2, 3, 5, 6]
        assert [r["s"] for r in out if r["edge"]] == [0, 7]


def test_a_very_long_text_and_the_spans(spark, tmp_path):
    rng = random.Random(9)
    long = words(rng, 40_000)
    shared = long[100_000:100_700]
    spark.createDataFrame([(1, long), (2, "start " + shared + " end"), (None, None)], "doc_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    n = len(shared.encode())
    assert got[1].n_removed >= n and got[2].n_removed >= n and got[2].n_spans == 1
    a, b = map(int, got[2].spans.split(":"))
    assert shared.encode() in ("start " + shared + " end").encode()[a:b] and b - a == got[2].n_removed
    assert got[None].n_bytes == 0 and got[None].spans == "" and got[None].n_chars_kept == 0
    assert got[1].n_chars_kept < len(long) and got[2].n_chars_kept == len(("start " + shared + " end").encode()[:a].decode("utf8", "replace") + ("start " + shared + " end").encode()[b:].decode("utf8", "replace"))


def test_the_text_that_stays_is_returned(spark, tmp_path):
    rng = random.Random(12)
    passage = words(rng, 130)
    few = words(rng, 51)
    # é and è begin with the same byte, which goes with the passage; 51 words in less than 400 bytes stay wherever they occur.
    texts = ["one " + passage + "é end", "two " + passage + "è fin", "three " + few + " x", "four " + few + " y", "copy " + passage[:300] + "z" * 200, "copy " + passage[:300] + "z" * 200, "short", None]
    assert len(few.encode()) < N - 8
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].kept for i in range(8)] == ["one\ufffd end", "two\ufffd fin", texts[2], texts[3], "", "", "short", ""]
    for r in got.values():
        body, at = (texts[r.doc_id] or "").encode(), 0
        left = []
        for a, b in (map(int, x.split(":")) for x in r.spans.split(",") if x):
            left.append(body[at:a])
            at = b
        left = b"".join([*left, body[at:]])
        assert r.kept == left.decode("utf8", "replace") and hashlib.sha256(left).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_chars_kept
