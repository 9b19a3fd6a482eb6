"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token. For each end, an automaton over the vocabulary (Aho-Corasick)
gives the tokens that are suffixes of the prefix; the last token is the one that is compatible with the
last token of the prefix before it: encoding the bytes of the pair gives that pair. Back-pointers from the
end then give the ids. Compatibility of two tokens is found by undoing their merges along the seam, and
remembered. No merge is ever applied to a text.

A text is cut into pieces as the tokenizer file says: first at its special tokens, then by the pattern of its byte-level
pre-tokenizer. Pieces recur, so each task keeps the ids of recent pieces, within `MEMO` entries.

The tokenizer file's path is a parameter; the file is read where the task runs, and never copied.

Edge cases: null text is empty and has no ids; invalid UTF-8 cannot occur in a Spark string; ids that do not
make valid UTF-8 decode with replacement characters, as the tokenizer's own decoder does; repeated rows are
repeated in the result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import frugal

#: Fixed value: the pattern of a byte-level pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO, PAIRS = 300_000, 300_000
#: Characters of output in a batch at most, unless a single text is longer.
BATCH = 4 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: raw[t] for t, i in model["vocab"].items()} | {i: t.encode() for t, i in self.special.items()}
        # Of each token that a merge makes: the rank of the merge and its two sides.
        self.rank, self.sides, self.merged = {}, {}, {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merged[left, right] = rank
            if made not in self.sides:
                self.sides[made], self.rank[made] = (left, right), rank
        self.matches = ahocorasick.Automaton()
        self.single = {}
        for t, i in model["vocab"].items():
            if len(raw[t]) == 1 or i in self.sides:
                self.matches.add_word(raw[t].decode("latin-1"), (len(raw[t]), i))
                if self.whole(i):
                    self.single[raw[t]] = i
        self.matches.make_automaton()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: its sides do, and meet in nothing sooner."""
        return token not in self.sides or self.compatible(*self.sides[token], self.rank[token])

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge crosses the seam of two tokens (before the merge ranked `before`, if given) while their own merges run."""
        limit = len(self.merged) if before is None else before
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < limit:
                return False
            # The later of the two sides' last merges is undone: before it, the seam had a smaller neighbour.
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # A crossing merge of equal rank would have come after the left one, which starts further left.
                limit, left = a, self.sides[left][1]
            else:
                limit, right = b + 1, self.sides[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (token := self.single.get(piece)) is not None:
            return [token]
        n = len(piece)
        last: list[int | None] = [None] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, (length, token) in self.matches.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            start = end - length
            if start == 0:
                if self.single.get(piece[:end]) == token:
                    last[end] = token
                continue
            key = last[start] << 32 | token
            fits = pairs.get(key)
            if fits is None:
                fits = pairs[key] = self.single.get(piece[start:end]) == token and compatible(last[start], token)
            if fits:
                last[end] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.bytes[last[at]])
        return out[::-1]

    def ids_of(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit integers, remembered for two generations of MEMO / 2 pieces."""
        found = self.old.get(piece)
        if found is None:
            found = np.array(self.encode_piece(piece.encode()), np.int32).tobytes()
        if len(self.new) >= MEMO // 2:
            self.old, self.new = self.new, {}
        if len(piece) < 64:
            self.new[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            # A generation may end within a text, whose lookups then go on in the one that ends.
            get, make = self.new.get, self.ids_of
            out += [get(piece) or make(piece) for piece in PIECES.findall(part)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def loaded(path: str) -> Bpe:
    """One for each path in a worker process."""
    return Bpe(path)


def _coder(path: str) -> Callable:
    def flush(keys: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
        return pa.RecordBatch.from_arrays([keys, lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids, texts, size, first = [], [], 0, 0
            for k, text in enumerate(batch.column("text")):
                found = bpe.encode(text.as_py() or "")
                ids.append(found)
                texts.append(bpe.decode(found.tolist()))
                size += len(texts[-1])
                if size > BATCH:
                    yield flush(batch.column("doc_id").slice(first, k + 1 - first), ids, texts)
                    ids, texts, size, first = [], [], 0, k + 1
            if ids:
                yield flush(batch.column("doc_id").slice(first, len(ids)), ids, texts)

    return code


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text, and decoded, the text that the ids give."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(frugal(_coder(path)), f"doc_id {kind}, ids array<int>, decoded string")
