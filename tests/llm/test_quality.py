import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality, queries

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    held = labels.filter("pmod(xxhash64(doc_id), 3) = 0")
    model = quality.train(docs, labels.join(held, "doc_id", "left_anti"))
    got = quality.scored(docs, model, ["doc_id"], ("s_low", "s_toxic")).join(held, "doc_id").select("quality", "toxic", "s_low", "s_toxic").toPandas()
    low, toxic = got.quality == 0, got.toxic == 1
    assert len(got) > 1000
    assert ((got.s_low > 0) == low).mean() > 0.98
    assert ((got.s_toxic > 0) == toxic).mean() > 0.95
    assert (got.s_toxic > 0)[~toxic].mean() < 0.02


def test_kept_documents(spark, tables):
    docs, labels = tables
    out = quality.classified(docs, labels)
    assert out.columns == [*docs.columns, "p_low", "p_toxic", "keep"] and out.count() == docs.count()
    got = out.join(labels, "doc_id").select("quality", "toxic", "keep").toPandas()
    clean = (got.quality == 1) & (got.toxic == 0)
    assert got.keep[clean].mean() > 0.98
    assert got.keep[got.quality == 0].mean() < 0.02


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_posteriors(rows):
    """(host, path, low, toxic) -> posterior probabilities, by plain loops."""
    out = [[] for _ in rows]
    for k in (2, 3):
        p = [sigmoid(r[k]) for r in rows]
        hosts, paths = defaultdict(list), defaultdict(list)
        for r, x in zip(rows, p, strict=True):
            hosts[r[0]].append(x)
            paths[r[0], r[1]].append(x)
        n, h, total = len(rows), len(hosts), sum(p)
        rate = (total + 0.5) / (n + 1)
        means = sum(sum(v) ** 2 / len(v) for v in hosts.values())
        within = max(1e-6, (sum(x * x for x in p) - means) / max(1, n - h))
        between = (means - total * total / n - (h - 1) * within) / max(1.0, n - sum(len(v) ** 2 for v in hosts.values()) / n)
        prior = min(10000.0, max(10.0, within / max(between, 1e-9)))
        for i, r in enumerate(rows):
            v, w = hosts[r[0]], paths[r[0], r[1]]
            host = (sum(v) + prior * rate) / (len(v) + prior)
            path = (sum(w) + prior * host) / (len(w) + prior)
            out[i].append(sigmoid(r[k] + math.log(path / (1 - path)) - math.log(rate / (1 - rate))))
    return out


def test_posteriors_match_a_plain_model(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs.withColumn("source", F.expr("if(doc_id % 17 = 0, null, source)")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs, labels)
    rows = quality.scored(docs, model, ["doc_id", "source", "lang"]).collect()
    want = plain_posteriors([(r.source or "", r.lang or "", r.low, r.toxic) for r in rows])
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r, (low, toxic) in zip(rows, want, strict=True):
        assert abs(got[r.doc_id].p_low - low) < 1e-6 and abs(got[r.doc_id].p_toxic - toxic) < 1e-6
        assert got[r.doc_id].keep == (low <= 0.5 and toxic <= 0.5)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 1.5, "x", 7, "h", True), (2, "%%% 99", "s", "en", 2.5, None, 8, "i", False)], "doc_id bigint, text string, source string, lang string, __llm_low double, __llm_toxic string, p_low int, host string, __llm_keep boolean")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    with pytest.raises(ValueError, match="p_low"):
        quality.classified(docs, labels)
    out = quality.classified(docs, labels, names=("a", "b", "c"))
    assert out.columns == [*docs.columns, "a", "b", "c"]
    assert sorted(tuple(r)[: len(docs.columns)] for r in out.collect()) == sorted(map(tuple, docs.collect()))
    left = quality.kept(docs, labels)
    assert left.columns == docs.columns and {tuple(r) for r in left.collect()} <= {tuple(r) for r in docs.collect()}


def test_sparse_sites_shrink_and_full_sites_speak(spark):
    rows = [("h1", "h1/a", 4.0)] * 300 + [("h2", "h2/a", -4.0)] * 300 + [("h3", "h3/a", 4.0)] + [("h1", "h1/b", -4.0)]
    df = spark.createDataFrame([(h, p, s, -4.0) for h, p, s in rows], "host string, path string, low double, toxic double")
    shift = {r.path: (r.shift_low, r.shift_toxic) for r in quality.site_shifts(quality.site_sums(df)).collect()}
    assert shift["h1/a"][0] > 1 > shift["h3/a"][0] > 0 > -1 > shift["h2/a"][0]
    assert shift["h1/a"][0] > shift["h1/b"][0] > 0
    assert all(abs(t) < 0.1 for _, t in shift.values())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (None, "some words", "s", "en"), (2, "", "s", "en")], "doc_id bigint, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.keep for r in quality.classified(docs, none).collect()] == [True] * 4
    some = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classified(docs, some).count() == 4
    assert quality.classified(docs, some, max_sites=0).count() == 4
    assert quality.classified(docs.limit(0), some).collect() == []
    assert quality.classified(spark.createDataFrame([], docs.schema), some).collect() == []


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"one two two", "café %%% 12".encode(), b"a" * 50]
    offsets = np.cumsum([0, *map(len, texts)])
    form, row, bucket = quality.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, t in enumerate(texts):
        alone, _, own = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], form[i]) and sorted(own) == sorted(bucket[row == i])


def fitted(texts, faults):
    offsets = np.cumsum([0, *map(len, texts)])
    return quality.fit(*quality.features(np.frombuffer(b"".join(texts), np.uint8), offsets), faults)


def test_copies_are_found_by_their_marks():
    texts = [b"", b"a b c d e f", b"x y", b"a b c d e f", b"x y", b"one two three four five six seven"]
    marks = quality.min_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert quality.one_of_each(marks).tolist() == [0, 1, 2, 5]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a longer word or two " * 150_000, "s", "en"), (2, "%%% 99", "s", "en")], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.classified(docs, labels, carry=["doc_id"]).count() == 2


def test_toxic_words_of_a_small_language_are_found():
    rng = np.random.default_rng(5)
    pick = lambda stem, n, k: [f"{stem}{i}" for i in rng.choice(n, k, replace=False)]
    texts, kinds = [], []
    for kind, n in (("en", 1500), ("en toxic", 150), ("xx", 150), ("xx toxic", 60)):
        for _ in range(n):
            lang, _, toxic = kind.partition(" ")
            body = [*pick(lang, 400, 40), *(pick(lang + "bad", 60, 6) if toxic else [])]
            texts.append(" ".join(rng.permutation(body)).encode())
            kinds.append(kind)
    kinds = np.array(kinds)
    train = np.arange(len(kinds)) % 2 == 0
    model = fitted([t for t, x in zip(texts, train, strict=True) if x], np.array([(False, "toxic" in k) for k in kinds[train]]))
    offsets = np.cumsum([0, *map(len, texts)])
    toxic = model.scores(np.frombuffer(b"".join(texts), np.uint8), offsets)[:, 1] > 0
    for kind in ("en toxic", "xx toxic"):
        assert toxic[~train & (kinds == kind)].mean() > 0.8
    assert toxic[~train & np.isin(kinds, ["en", "xx"])].mean() < 0.02


def test_small_strata_are_sampled_whole(spark, monkeypatch):
    assert quality.rates([5, 1000, 10, 500], 115) == [1.0, 0.05, 1.0, 0.1] and quality.rates([3, 4], 10) == [1.0, 1.0]
    rows = [(i, f"en {i}", "en", 1, 0) for i in range(1000)] + [(1000 + i, f"xx {i}", "xx", 1, i % 2) for i in range(20)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], *r[3:]) for r in rows], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "fit", lambda form, row, bucket, faults, weight: (form, weight))
    monkeypatch.setattr(quality, "one_of_each", lambda marks: np.arange(len(marks)))
    form, weight = quality.train(docs, labels, 120)
    assert len(form) == len(weight) and (weight == 1.0).sum() == 20 and 60 < (weight == 10.0).sum() <= 100
    assert set(weight) == {1.0, 10.0}
