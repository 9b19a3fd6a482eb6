import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "é", "日", "本", "'s", "1", "23", "<|endoftext|>", "ing", "!!!", " ", "\t", "💡", "‍", "क", "\u001c", "\r\n", "Z" * 40]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def test_random_texts_match_the_library(own, library):
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choices(PIECES, k=rng.randrange(30)))
        ids = own.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_does(own, library):
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_cut_as_the_library_cuts_it(own, library):
    for c in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 61)]:
        text = f"a{chr(c)}b 1{chr(c)}!"
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_unbroken_text(own, library):
    text = "z" * 20000 + "aaab" * 3000
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_pieces_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO", 20)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    small, rng = bpe.Bpe(PATH), random.Random(2)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdetion", k=rng.randrange(1, 9))) for _ in range(30))
        assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(small.new) + len(small.old) <= 22


def test_query(spark, tmp_path, library):
    texts = [None, "", "Hello world", "<|endoftext|> é💡", "x " * 3000, "Hello world"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op6_bpe(spark, str(tmp_path)).collect() == []
