import random
from collections import defaultdict

import pytest

from ledgerloom.llm import line_dedup, queries
from ledgerloom.llm.common import numbered

SCHEMA = "doc_id bigint, text string, h string, first string, s string"


def placed(spark, docs):
    """(doc_id, place, text) of every row; the place only says which of the rows of one doc_id comes first."""
    return [(r.doc_id, r[line_dedup.ROW], r.text) for r in numbered(docs.select("doc_id", "text"), line_dedup.ROW).collect()]


def boundaries(texts):
    """For each text the ends of its chunks and its repeated pairs, from the definition."""
    seen = defaultdict(list)
    for t in texts:
        for i in range(1, len(t)):
            seen[t[i - 1], t[i]].append((t[i - 2] if i > 1 else None, t[i + 1] if i + 1 < len(t) else None))
    for t in texts:
        ends, repeated = {len(t)}, set()
        for i in range(1, len(t)):
            around = seen[t[i - 1], t[i]]
            if len(around) == 1:
                ends.add(i)
                continue
            repeated.add(i)
            if len({l for l, _ in around}) > 1:
                ends.add(i - 1)
            if len({r for _, r in around}) > 1:
                ends.add(i + 1)
        yield sorted(ends - {0}), repeated


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {row: (doc_id, None, []) for doc_id, row, text in rows if text is None}
    texts = [(doc_id, row, text.split("\n")) for doc_id, row, text in rows if text is not None]
    # Spans of lines that may go: chunks, and repeated pairs with a line that is a chunk of its own.
    spans, first = [], {}
    for k, ((_, _, t), (ends, repeated)) in enumerate(zip(texts, boundaries([x[2] for x in texts]))):
        cut = list(zip([0, *ends], ends))
        alone = {s for s, e in cut if e - s == 1}
        spans.append((alone, [x for x in cut if x[1] - x[0] > 1], [(i - 1, i + 1) for i in sorted(repeated) if {i - 1, i} & alone]))
        for s, e in sorted(spans[-1][1] + spans[-1][2]):
            first.setdefault(tuple(t[s:e]), (k, s))
    for k, ((doc_id, row, t), (alone, chunks, pairs)) in enumerate(zip(texts, spans)):
        gone = [(s, e) for s, e in chunks if first[tuple(t[s:e])] != (k, s)]
        whole = {i for s, e in gone for i in range(s, e)}
        lines = set()
        for s, e in pairs:
            f = first[tuple(t[s:e])]
            if f in ((k, s), (k, s - 1)):
                continue
            lines |= {i for i, other in ((s, s + 1), (s + 1, s)) if i in alone and (other in alone or other in whole)}
        out[row] = (doc_id, "\n".join(x for i, x in enumerate(t) if i not in whole | lines), sorted(gone + [(i, i + 1) for i in lines]))
    return sorted(out.values(), key=str)


def tables(rng):
    passages = [[f"line {k} {i} é" for i in range(rng.randrange(2, 14))] for k in range(12)]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "\n\n\n"), (None, "a\nb\nc\nd"), (4, "a\nb\nc\nd"), (4, "a\nb\nc\nd")]
    for i in range(5, 120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [f"own {i} {rng.random()}"] * rng.randrange(1, 4)
        rows.append((i, "\n".join(lines)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in tables(random.Random(seed))], SCHEMA)
    got = line_dedup.deduplicated(docs, cut="spans")
    assert got.columns == [*docs.columns, "spans"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r["spans"]]) for r in got.collect()), key=str)
    want = brute(placed(spark, docs))
    assert got == want
    assert sum(len(x[2]) for x in want) > 50


def test_boundaries_survive_a_shift(spark):
    rng = random.Random(5)
    lines = [f"shared {rng.random()}" for _ in range(60)]
    docs = spark.createDataFrame([(0, "\n".join(["x", *lines])), (1, "\n".join(["p", "q", "r", *lines, "t"]))], "doc_id bigint, text string")
    left = {r.doc_id: r.text.split("\n") for r in line_dedup.deduplicated(docs).collect()}
    assert len(left[0]) == 61 and len(left[1]) < 35


def test_equal_hashes_of_different_bytes_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *c: real(*c).bitwiseAND(F.lit(0)) + 1)
    docs = spark.createDataFrame([(0, "a\nb"), (1, "c\nd"), (2, "a\nb")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()} == {0: "a\nb", 1: "c\nd", 2: ""}


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op4_line_dedup(spark, str(tmp_path)).collect() == []


def test_embedded_passages_of_few_lines_go(spark):
    rng = random.Random(9)
    passages = [["" if i == 1 and n > 2 else f"passage {k} {i}" for i in range(n)] for k, n in enumerate([2, 3, 4, 5] * 10)]
    own = lambda i, n: [f"own {i} {rng.random()}" for _ in range(n)]
    docs, want = [], {}
    for i in range(2 * len(passages)):
        before, after = own(i, rng.randrange(1, 6)), own(i, rng.randrange(1, 6))
        docs.append((i, "\n".join([*before, *passages[i % len(passages)], *after])))
        want[i] = docs[-1][1] if i < len(passages) else "\n".join(before + after)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want


def test_clashing_names_shuffled_input_and_a_long_text(spark):
    long = "\n".join(f"row {i}" for i in range(60_000))
    rows = [(1, "a\nb\nc", "k1", 5, None), (2, "x\na\nb\nc\ny", "k2", 6, [1]), (2, "x\na\nb\nc\ny", "k2", 6, [1]), (3, long, "k3", 7, []), (4, "top\n" + long, "k4", 8, [2, 3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __llm_row string, __llm_cut int, LINES array<int>").repartition(3, "doc_id")
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    want = [("a\nb\nc", "k1", 5, None), ("x\ny", "k2", 6, [1]), ("x\ny", "k2", 6, [1]), (long, "k3", 7, []), ("top", "k4", 8, [2, 3])]
    got = sorted(tuple(r)[1:] for r in got.collect())
    # Of the two equal rows one keeps what is its first occurrence of the line pairs around the passage.
    assert [r for r in got if r[1] != "k2"] == [r for r in sorted(want) if r[1] != "k2"]
    assert {r[1:] for r in map(lambda r: (r[0], r[1], r[2], str(r[3])), got)} == {(r[1], r[2], str(r[3])) for r in want}
    with pytest.raises(ValueError):
        line_dedup.deduplicated(docs, cut="__llm_cut")


def test_forked_passages_go_whole(spark):
    """Recall of the words in passages that occur before, found without the operator's chunks."""
    rng = random.Random(11)
    pieces = [[f"piece {k} {i} " + "word " * 8 for i in range(rng.randrange(1, 4))] for k in range(14)]
    own = lambda i: [f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 4))]
    rows = []
    for i in range(80):
        middle = [line for _ in range(rng.randrange(2, 7)) for line in rng.choice(pieces)]
        rows.append((i, "\n".join(own(i) + middle + own(i))))
    left = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), cut="spans").collect()}
    before, repeated, gone, clean = set(), 0, 0, 0
    for i, text in rows:
        t = text.split("\n")
        cut = {k for s, e in left[i]["spans"] for k in range(s, e)}
        again = {k for k in range(len(t)) if (k and tuple(t[k - 1 : k + 1]) in before) or tuple(t[k : k + 2]) in before}
        inside = {k for k in range(len(t)) if (k and t[k - 1 : k + 1] in [t[j : j + 2] for j in range(k - 1)]) or t[k : k + 2] in [t[j : j + 2] for j in range(k)]}
        repeated += sum(len(t[k].split()) for k in again)
        gone += sum(len(t[k].split()) for k in again & cut)
        clean += len(cut - again - inside)
        before |= {tuple(t[k : k + 2]) for k in range(len(t) - 1)}
    assert repeated > 4_000 and gone >= 0.97 * repeated and clean == 0


def test_a_run_of_equal_lines_keeps_its_first_pair(spark):
    rows = [(0, "x\na\na\na\na\na\ny"), (1, "p\na\na\na\nq"), (2, "a"), (3, "r\na\ns")]
    left = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left == {0: "x\na\na\ny", 1: "p\nq", 2: "a", 3: "r\na\ns"}
