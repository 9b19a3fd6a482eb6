import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm.common import stored
from tests.llm import test_decontaminate, test_line_dedup, test_simhash

DATA = "/root/testdata/sf0.001"


def write(spark, path):
    rng = random.Random(12)
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = list(real)
    for k in range(6):
        i, text, lang, source, n = real[rng.randrange(len(real))]
        rows.append((10_000 + k, text, lang, source, n))
        rows.append((20_000 + k, f"{text}\n{rng.choice(items)[1]}", lang, source, n))
    rows += [(30_000, None, None, None, None), (30_001, "", "en", "src0", 0), (None, rows[5][1], "en", "src1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return str(path), items


def test_each_stage_matches_its_plain_version(spark, tmp_path):
    d, items = write(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]

    kept = stored(steps["quality"](spark, docs, d))
    assert kept.columns == columns
    stays = [r.doc_id for r in kept.collect()]
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert len(set(stays) & set(clean)) >= 0.97 * len(clean)
    assert not [i for i in stays if i in labels and labels[i].quality == 0]

    cut = stored(steps["line_dedup"](spark, kept, d))
    assert cut.columns == columns
    want = [(i, t) for i, t, _ in test_line_dedup.brute(test_line_dedup.placed(spark, kept))]
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut.collect())

    one = stored(steps["near_dedup"](spark, cut, d))
    assert one.columns == columns
    known = [(r.doc_id if r.doc_id is not None else 1 << 40, r.text) for r in cut.collect()]
    want = {component for _, _, component in test_simhash.brute(known)}
    got = [r.doc_id if r.doc_id is not None else 1 << 40 for r in one.collect()]
    assert sorted(got) == sorted(want)

    free = stored(steps["decontaminate"](spark, one, d))
    rows = [(r.doc_id, r.text) for r in one.collect()]
    hit = {i for i, *_ in test_decontaminate.brute(rows, items)}
    assert sorted((r.doc_id for r in free.collect()), key=str) == sorted((i for i, _ in rows if i not in hit), key=str)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in free.collect()}
    last = steps["bpe"](spark, free, d).collect()
    assert len(last) == len(texts)
    for r in last:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)

    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, d).collect() if r.doc_id is not None) == sorted((r.doc_id, r.n_tokens) for r in last if r.doc_id is not None)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
