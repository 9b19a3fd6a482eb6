import itertools
import random
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import decontaminate, queries


def test_masks_hit_wherever_a_fifth_of_the_words_is_substituted():
    for n, k in ((12, 0), (13, 1), (14, 2), (15, 3), (19, 3), (20, 4), (25, 5)):
        need = [sum(1 << (i + o) for o in mask) for mask in decontaminate.MASKS for i in range(n - mask[-1])]
        for gone in itertools.combinations(range(n), k):
            bits = sum(1 << x for x in gone)
            assert any(not m & bits for m in need)


@pytest.mark.parametrize("m", range(5, 15))
def test_short_items_are_hit_wherever_words_are_lacking(m):
    """All choices of the words that may lack, each also as words cut off at either end of a text."""
    item = np.arange(100, 100 + m, dtype=np.uint64)
    for gone in itertools.combinations(range(m), m - decontaminate.least(m)):
        there = item.copy()
        there[list(gone)] = 7
        assert decontaminate.best(decontaminate.Text(np.r_[np.full(3, 5), there, np.full(2, 5)].astype(np.uint64)), item) is not None
    lack = m - decontaminate.least(m)
    assert decontaminate.best(decontaminate.Text(item[lack:]), item) and decontaminate.best(decontaminate.Text(item[: m - lack]), item)
    worse = item.copy()
    worse[: lack + 1] = 7
    assert decontaminate.best(decontaminate.Text(worse), item) is None


def brute(docs, items):
    split = lambda t: re.findall(r"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).decode("latin-1"))
    out = []
    for d, text in docs:
        w = split(text)
        for k, item in items:
            v, found = split(item), []
            if len(v) < 5:
                continue
            for at in range(-len(v), len(w)):
                eq = [(w[at + q] == v[q]) for q in range(len(v)) if 0 <= at + q < len(w)]
                need = 12 if len(v) >= 15 else {5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 8, 11: 9, 12: 10, 13: 11, 14: 12}[len(v)]
                ok = any(sum(eq[i:j]) >= need and 5 * sum(eq[i:j]) >= 4 * (j - i) for i in range(len(eq)) for j in range(i + need, len(eq) + 1)) if sum(eq) >= need else False
                if ok:
                    where = [q for q, e in enumerate(eq) if e]
                    found.append((-sum(eq), where[-1] - where[0] + 1, max(0, at) + where[0]))
            if found:
                n, length, first = min(found)
                out.append((d, k, -n, length, first))
    return sorted(out, key=str)


def tables(rng):
    words = [f"w{i}" for i in range(500)] + ["é", "the", "The", "of"] * 20
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(rng.choice((5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 30, 59)))) for k in range(40)] + [(40, None), (41, "")]
    docs = []
    for i in range(120):
        body = text(rng.randrange(0, 80)).split()
        if i % 3:
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(len(passage) // 5 if i % 3 == 1 else 0):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [p.upper() + rng.choice(["", ",", ".\n"]) for p in passage]
        docs.append((i, " ".join(body)))
    return [*docs, (500, None), (501, ""), (0, docs[1][1]), (None, items[3][1])], items


def test_matches_brute_force(spark, tmp_path):
    docs, items = tables(random.Random(6))
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, items[3], (77, items[3][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.op7_benchmark_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = brute(docs, [*items, items[3], (77, items[3][1])])
    assert got == want and {k for _, k, *_ in want} > {77} and any(n < 12 for _, _, n, *_ in want)


@pytest.mark.parametrize("limits", [{}, {"GROUP": 1, "MAX_SIDE": 0}, {"MAX_FILTER": 1 << 12}])
def test_sides_groups_and_a_full_filter_change_nothing(spark, monkeypatch, limits):
    docs, items = tables(random.Random(8))
    for name, value in limits.items():
        monkeypatch.setattr(decontaminate, name, value)
    d = spark.createDataFrame([(*x, "r", 1) for x in docs], "doc_id bigint, text string, row string, c0 int").repartition(3, "row")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((tuple(r) for r in decontaminate.overlaps(d, b).collect()), key=str) == brute(docs, items)
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns
    clean = [(i, t, "r", 1) for i, t in docs if not brute([(i, t)], items)]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_one_word_throughout_text_and_item():
    for n, m in ((2000, 2000), (100_000, 300)):
        began = time.perf_counter()
        assert decontaminate.best(decontaminate.Text(np.full(n, 7, np.uint64)), np.full(m, 7, np.uint64)) == (m, m, 0)
        assert time.perf_counter() - began < 5


def test_places_by_seeds_and_by_trial_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(60):
        text, item = decontaminate.Text(rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint64)), rng.integers(0, 3, rng.integers(5, 40)).astype(np.uint64)
        got = decontaminate.places(text, item).tolist()
        assert got == [d for d in range(1 - len(item), len(text.hashes)) if decontaminate.seeded(*decontaminate.laid(text, item, d), len(item))]


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(40))
    long = " ".join(f"w{i % 5003}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, item), (6, "q1 q2 q3 q4 q5 q6 q7 q8 q9")], "item_id bigint, text string")
    assert sorted(tuple(r) for r in decontaminate.overlaps(docs, bench).collect()) == [(1, 5, 40, 40, 400_000), (1, 6, 9, 9, 400_001)]
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [2]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.overlaps(d, b).collect() == []
    assert decontaminate.decontaminated(d, b).collect() == []


def test_items_with_a_fifth_of_their_words_substituted_are_found(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"i{k}w{q}" for q in range(n))) for k, n in enumerate([5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 25, 33, 40, 60] * 3)]
    docs = []
    for k, text in items:
        n = len(text.split())
        last = rng.randrange(5)
        patterns = [range(last, n, 5), [1, 2, n - 2][: n // 5], rng.sample(range(n), n // 5), rng.sample(range(n), n // 5)]
        for gone in patterns:
            gone = list(gone)[: n // 5]
            passage = ["changed" if q in gone else w for q, w in enumerate(text.split())]
            docs.append((len(docs), k, " ".join(["own"] * 7 + passage + ["words"] * 9)))
    # Below 80 % everywhere: every third word substituted (of five words that is one, which may be).
    for k, text in items:
        if len(text.split()) > 5:
            docs.append((len(docs), None, " ".join("changed" if q % 3 == 2 else w for q, w in enumerate(text.split()))))
    found = decontaminate.overlaps(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(i, k) for i, k, _ in docs if k is not None}


def test_the_widest_stretch_is_that_of_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(15, 40)
        gone = set(rng.sample(range(n), rng.randrange(0, n // 2)))
        equal = [q not in gone for q in range(n)]
        want = max(sum(equal[i:j]) for i in range(n) for j in range(i, n + 1) if 5 * sum(equal[i:j]) >= 4 * (j - i))
        i, j = decontaminate.widest(np.array(equal))
        assert sum(equal[i:j]) == want and 5 * want >= 4 * (j - i)
