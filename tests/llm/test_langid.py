import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, queries

N = langid.ORDER


def plain_letters(text):
    out = " " * (N - 1)
    for c in text:
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out += c
    return out + " " if out.strip() and out[-1] != " " else out


def plain_model(texts):
    """Interpolated Kneser-Ney of one language, from its definition: probability(letter, letters before, alphabet)."""
    grams = [Counter() for _ in range(N + 1)]
    for t in texts:
        s = plain_letters(t)
        for i in range(N - 1, len(s)):
            grams[N][s[i - N + 1 : i + 1]] += 1
    for k in range(N - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    cuts = [0.0] * (N + 1)
    after = [defaultdict(list) for _ in range(N + 1)]
    for k in range(1, N + 1):
        n1, n2 = (sum(v == x for v in grams[k].values()) for x in (1, 2))
        cuts[k] = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
        for g, n in grams[k].items():
            after[k][g[:-1]].append(n)

    def p(g, alphabet):
        k = len(g)
        if k == 0:
            return 1 / alphabet
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:], alphabet)
        return max(grams[k][g] - cuts[k], 0) / sum(seen) + cuts[k] * len(seen) / sum(seen) * p(g[1:], alphabet) if grams[k][g] else cuts[k] * len(seen) / sum(seen) * p(g[1:], alphabet)

    return p


def prose(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)).capitalize() + rng.choice([".", "!", "", " 12"])


SYLLABLES = {"aa": ["ka", "lo", "min", "tê", "ra"], "bb": ["ка", "лой", "Мин", "та"], "cc": ["ka", "ost", "ung", "ß", "ra"]}


def fixture(n=40, seed=2):
    rng = random.Random(seed)
    return [(3 * i + k, prose(rng, SYLLABLES[x], rng.randrange(1, 60)), x) for i in range(n) for k, x in enumerate(SYLLABLES)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_cross_entropies_against_a_plain_model(spark):
    rows = fixture()
    tried = [r[1] for r in fixture(3, seed=7)] + ["", "日本 語", "a", None, "123", "KÂLO" * 50, "𝔘𝔫 xyz"]
    model = langid.fit(frame(spark, rows))
    got = {r.i: r for r in langid.entropies(spark.createDataFrame(list(enumerate(tried)), "i int, text string"), model, "i").collect()}
    alphabet = len({c for r in rows for c in plain_letters(r[1])[N - 1 :]}) + 1
    plain = {x: plain_model([r[1] for r in rows if r[2] == x]) for x in SYLLABLES}
    for i, text in enumerate(tried):
        s = plain_letters(text or "")
        ends = range(N - 1, len(s))
        assert got[i].letters == len(ends)
        for k, x in enumerate(SYLLABLES):
            want = -sum(math.log(plain[x](s[j - N + 1 : j + 1], alphabet)) for j in ends) / max(1, len(ends))
            assert math.isclose(got[i].entropies[k], want, rel_tol=1e-5, abs_tol=1e-9), (text, x)


def test_a_small_model_still_tells_languages_apart(spark):
    rows = fixture()
    model = langid.fit(frame(spark, rows), entries=300)
    assert all(len(h) <= 100 and (np.diff(h.astype(object)) > 0).all() for h in model.hashes)
    got = langid.entropies(frame(spark, rows), model, "lang").select("lang", langid.winner().alias("w")).collect()
    assert sum(list(SYLLABLES)[r.w] == r.lang for r in got) > 0.95 * len(got)


def test_a_bounded_broadcast_loses_no_window(spark):
    rows = fixture()
    odd = [(900, "zzqx wwq 日本 語", None), (901, "", None), (902, rows[0][1] * 3 + " 𝔘𝔫 xyz", None)]
    docs = frame(spark, rows + odd)
    whole = langid.fit(frame(spark, rows))
    want = {r.doc_id: r for r in langid.entropies(docs, whole, "doc_id").collect()}
    for entries in (300, 3):
        model = langid.fit(frame(spark, rows), entries=entries)
        assert sum(map(len, model.hashes)) <= entries < sum(map(len, whole.hashes))
        got = {r.doc_id: r for r in langid.entropies(docs, model, "doc_id").collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k].letters == r.letters and np.allclose(got[k].entropies, r.entropies, rtol=1e-6), (entries, k)


def test_pieces_of_long_texts_are_one_text(spark, monkeypatch):
    text = prose(random.Random(1), SYLLABLES["aa"], 500) + " " * 50 + "é1é" * 9
    whole = langid.windows(next(langid.pieces(text)), np.array([0]))[1]
    monkeypatch.setattr(langid, "PIECE", 7)
    cut = [p for p in langid.pieces(text)]
    assert len(cut) > 100 and (np.concatenate([langid.windows(p, np.array([0]))[1] for p in cut]) == whole).all()
    assert list(langid.pieces("")) == list(langid.pieces("12 3!")) == []


def test_a_text_of_many_pieces(spark):
    rows = fixture()
    model = langid.fit(frame(spark, rows))
    long = rows[0][1] * (3_000_000 // len(rows[0][1]))
    got = langid.entropies(frame(spark, [(0, long, None), (1, rows[0][1], None)]), model, "doc_id").collect()
    assert {r.doc_id: list(SYLLABLES)[int(np.argmin(r.entropies))] for r in got} == {0: "aa", 1: "aa"}
    assert max(r.letters for r in got) > 2_000_000


def test_odd_tables(spark, tmp_path):
    rows = [(i, t, x, "s", i) for i, t, x in fixture()] + [(900, None, "aa", None, 0), (901, "", None, "s", 0), (902, "12 !!", "bb", "s", 0), (None, "kalo minra", "aa", "s", 0), (903, "kalo", None, "s", 0), (903, "kalo", None, "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, letters bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {k: ("und", 0.0) for k in (900, 901, 902)}
    assert all(r.lang_pred in SYLLABLES for r in got if r.doc_id not in (900, 901, 902))
    assert sum(dict((r[0], r[2]) for r in rows).get(r.doc_id) == r.lang_pred for r in got if r.held_out and r.doc_id < 900) > 0.9 * sum(r.held_out and r.doc_id < 900 for r in got)
    docs = spark.createDataFrame(rows, schema).withColumn("a.b", F.lit(1))
    with pytest.raises(ValueError):
        langid.learned(docs.withColumn("score", F.lit(1)), F.lit(True))
    nothing = langid.learned(docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in nothing} == {("und", 0.0, False)} and nothing[0]["a.b"] == 1
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_language_id(spark, f"{tmp_path}/none").collect() == []


def test_a_strange_text_is_not_accepted(spark):
    rows = fixture(120)
    docs = frame(spark, rows + [(999, "qqqq xxwx zzqz wwqx qzxw " * 20, None)])
    got = {r.doc_id: r for r in langid.learned(docs.filter("doc_id < 900 or doc_id = 999"), F.col("lang").isNotNull()).collect() if r.doc_id == 999}
    assert not got[999].accepted and got[999].lang_pred in SYLLABLES
    other = langid.learned(docs, F.col("lang").isNotNull()).filter("lang is not null").agg(F.avg(F.col("accepted").cast("int"))).first()[0]
    assert other > 0.8


def test_held_out_accuracy_on_the_test_table(spark):
    got = queries.op13_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
