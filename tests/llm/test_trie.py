import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, `a.b` int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def turns_of(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}


def families(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def want(convs):
    """Every prefix as a key, straight from the definition."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        saved[p] = sum(saved[b] for b in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))))
        for p, m in members.items()
    )


def listed(df):
    cols = [*trie.NODE, "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.select(cols).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def some(seed, n=120, words=2, longest=5):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        for t in range(rng.randrange(longest + 1) if kind < 0.8 else 40 if kind > 0.97 else 3):
            text = rng.choice(["a", "bé💡", None, ""][:words]) if kind < 0.8 else "same"
            rows.append((c * rng.choice([1, 1, 7]), rng.choice([t, t, t, 0, None]), rng.choice(["user", "user", None]), text))
    rng.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 30), (4, 60)])
def test_random_conversations_in_many_blocks(spark, seed, parts):
    rows = some(seed, words=1 + seed % 4)
    assert listed(trie.trie(table(spark, rows), parts=parts)) == want(turns_of(rows))


def test_copies_over_many_blocks(spark):
    """Two thirds of all conversations are equal, and an only child goes deep: nodes and lists of members pass through many blocks."""
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(3)] + [(c, t, "user", f"t{t}" if t < 2 + c % 2 else f"{c}") for c in range(100, 130) for t in range(5)]
    assert listed(trie.trie(table(spark, rows), parts=40)) == want(turns_of(rows))


def test_query_with_families_turnless_and_null_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", None, "é" * 9])) for c in [*range(100, 330), *range(700, 720), -5, -205, 1_000_007] for t in range(rng.randrange(1, 8))]
    rows += [(c, 0, "user", "alone") for c in range(801, 820)]  # nothing at 800: most lose their only turn
    rows += [(None, 0, "user", "nobody's"), (300, None, None, None), (300, None, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = families(turns_of(rows))
    assert any(not t for t in convs.values())
    assert listed(queries.op11_conversation_trie(spark, str(tmp_path))) == want(convs)


def test_only_turnless_and_empty_table(spark):
    rows = [(701, 0, "user", "x"), (702, 0, "user", "y")]
    seqs = trie.sequences(table(spark, rows)).withColumn("turns", F.filter("turns", lambda t: F.lit(False)))
    assert listed(trie.nodes(seqs, 3)) == [(701, 0, -1, 2, 0, 1, 0, sha("701,702"))]
    assert listed(trie.trie(table(spark, []))) == []


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, "user", "w") for t in range(3000)] + [(2, t, "user", "w" if t < 2500 else "v") for t in range(3000)] + [(3, 0, "user", "long é" * 1_000_000)]
    got = listed(trie.trie(table(spark, rows), parts=2))
    assert got == want(turns_of(rows)) if len(got) < 10 else len(got) == 3501 + 1
    root = next(r for r in got if r[1] == 0)
    assert root[3:7] == (3, 2, 3, 2500)
