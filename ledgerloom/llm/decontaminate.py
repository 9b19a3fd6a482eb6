"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask keeps out of a short span; the words between are
ignored, so a seed survives their substitution. The seeds of the benchmark items and those at every word of
every document are joined. For each document and item that share a seed, the item is laid over the document, without
gaps, at every place at which a seed of theirs agrees, and the overlap is verified word by word: of the stretches with
`SHARE` = 80 % or more equal words, wherever in them the substitutions lie, the one with the most matching words must
have `LEAST`, or 80 % of the item's words if it has fewer than 15. All matching words of the item at the best place (most
matching words, then shortest span, then first) are reported.

The four masks for items of 15 words and more keep five words each. Over 12 words, 13 with any one, 14 with any two, 15 with any
three, 20 with any four or 25 with any five substituted, at least one of them still hits (checked over all placements in the
tests). Shorter items may lack one word (5 to 9 words) or two (10 to 14), at whatever place, also where a text begins or ends
inside them. Their masks keep every second or every third word: each such class of words holds the mask once, and what is
lacking leaves one class whole. Items of five words have masks of any four of them.

How it runs: the seeds of the items fill a Bloom filter (`FILTER_BITS` bits a seed, `MAX_FILTER` = 16 MB at most, whatever the
size of the benchmark), which goes to all tasks. Documents are read once; those with a seed that passes are stored
with these seeds. Seeds are then joined as DataFrames, which also turns away what passed by chance, and the pairs of documents and
items are verified, the items of one document in groups of `GROUP`. Equal items are one class until the end.

Edge cases: null text is empty; items of fewer than SHORTEST words occur by chance and are not searched; repeated
items and rows give repeated results; null ids are kept; texts may have any length, and a word repeated throughout
text and item costs no more than the places at which they overlap; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bytehash import chunks, texts_of, words
from ledgerloom.llm.common import frugal, numbered, stored

#: The places of the five words that each mask keeps.
MASKS = ((0, 2, 4, 5, 6), (0, 2, 3, 4, 9), (0, 1, 3, 4, 7), (0, 2, 6, 8, 9))
LEAST, SHORTEST = 12, 5
#: Of five words of a stretch four are equal.
SHARE = (4, 5)
#: Masks of items of so many words: any four of five, every second word, every third word.
SHORT_MASKS = {(5, 5): ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)), (6, 7): ((0, 2, 4),), (8, 9): ((0, 2, 4, 6),), (10, 11): ((0, 3, 6),), (12, 14): ((0, 3, 6, 9),)}
#: What is hashed.
KINDS = (*MASKS, *(mask for masks in SHORT_MASKS.values() for mask in masks))
FACTORS = np.random.default_rng(3).integers(0, 1 << 63, (len(KINDS), LEAST), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FILTER_BITS, FILTER_PROBES, MAX_FILTER = 64, 4, 1 << 27
#: Items that are verified with one document at a time; seeds and item words up to which a side is broadcast.
GROUP, MAX_SIDE = 256, 500_000


def least(m: int) -> int:
    """How many words of an item of m words must match."""
    return min(LEAST, -(-SHARE[0] * m // SHARE[1]))


def kinds_of(m: int) -> list[int]:
    """The kinds of seeds of an item of m words."""
    masks = next((x for (a, b), x in SHORT_MASKS.items() if a <= m <= b), MASKS if m >= SHORTEST else ())
    return [KINDS.index(mask) for mask in masks]


def seeds(hashes: np.ndarray, rows: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds of one kind and the word at which each starts; a seed stays inside its row."""
    kept = KINDS[kind]
    n = len(hashes) - kept[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, kind, np.uint64)
    for place, factor in zip(kept, FACTORS[kind], strict=False):
        total += hashes[place : place + n] * factor
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    at = np.flatnonzero(rows[:n] == rows[kept[-1] :])
    return total[at], at


def widest(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of a stretch with SHARE or more equal words that has the most of them."""
    # `over` is no less at the end of such a stretch than at its start. For each start the last such end is the last place
    # from which on the greatest value is not below that at the start.
    over = np.r_[0, np.cumsum(np.where(equal, SHARE[1] - SHARE[0], -SHARE[0]))]
    later = np.maximum.accumulate(over[::-1])[::-1]
    ends = np.searchsorted(-later, -over, "right") - 1
    count = np.r_[0, np.cumsum(equal)]
    start = int(np.argmax(count[ends] - count))
    return start, int(ends[start])


class Text:
    """The words of a document, and its seeds in order."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_seeds(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.seeds:
            found, at = seeds(self.hashes, np.zeros(len(self.hashes), np.int8), kind)
            order = np.argsort(found, kind="stable")
            self.seeds[kind] = found[order], at[order]
        return self.seeds[kind]


def places(text: Text, item: np.ndarray) -> np.ndarray:
    """The words of the text at which the item would start, where a seed of theirs agrees; negative where it is cut off."""
    n, m, found = len(text.hashes), len(item), []
    for kind in kinds_of(m):
        known, at = text.sorted_seeds(kind)
        own, start = seeds(item, np.zeros(m, np.int8), kind)
        low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
        counts = high - low
        if counts.sum() > 4 * (n + m):
            # Words that are repeated in both: all places are tried instead, and those without a seed left out.
            return np.array([d for d in range(1 - m, n) if seeded(*laid(text, item, d), m)], np.int64)
        which = np.repeat(np.arange(len(own)), counts)
        found.append(at[np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]] - start[which])
    return np.unique(np.concatenate(found))


def laid(text: Text, item: np.ndarray, at: int) -> tuple[int, np.ndarray]:
    """Of the item laid at word `at`: the first of its words inside the text, and which of those inside are equal."""
    a, b = max(0, at), min(len(text.hashes), at + len(item))
    return a - at, text.hashes[a:b] == item[a - at : b - at]


def seeded(first: int, equal: np.ndarray, m: int) -> bool:
    """Whether a seed agrees there."""
    masks = [KINDS[k] for k in kinds_of(m)]
    if np.count_nonzero(equal) < min(map(len, masks)):
        return False
    return any(len(equal) > k[-1] and np.logical_and.reduce([equal[i : len(equal) - k[-1] + i] for i in k]).any() for k in masks)


def best(text: Text, item: np.ndarray) -> tuple[int, int, int] | None:
    """Matching words, words and first word of the best place of the item, or None."""
    m, found = len(item), []
    for at in places(text, item).tolist():
        first, equal = laid(text, item, at)
        n = int(np.count_nonzero(equal))
        if n >= least(m):
            where = np.flatnonzero(equal)
            found.append((-n, int(where[-1] - where[0]) + 1, at + first + int(where[0]), at))
            if n == m:
                break  # no later place can be better
    for n, length, first, at in sorted(found):
        equal = laid(text, item, at)[1]
        start, end = widest(equal)
        if np.count_nonzero(equal[start:end]) >= least(m):
            return -n, length, first
    return None


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch)
        for i, j in chunks(offsets):
            hashes, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            first = np.searchsorted(rows, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            kinds = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                m = b - a
                kinds.append([(k, x) for k in kinds_of(m) for x in np.unique(seeds(hashes[a:b], np.zeros(m, np.int8), k)[0]).view(np.int64).tolist()])
            found = pa.array([[{"kind": k, "seed": x} for k, x in own] for own in kinds], pa.list_(pa.struct([("kind", pa.int32()), ("seed", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, j - i), lists, found], ["item", "words", "seeds"])


class Filter:
    """A Bloom filter of seeds, and the kinds they are of."""

    def __init__(self, bits: int, rows: list, kinds: list[int]):
        self.bits, self.kinds = bits, kinds
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        if rows:
            at, value = zip(*rows, strict=True)
            self.words[np.array(at)] = np.array(value, np.int64).view(np.uint64)

    @staticmethod
    def slots(seed, bits: int) -> list:
        """The bits of a column of seeds."""
        high, low = F.shiftrightunsigned(seed, 32), seed.bitwiseAND(F.lit(0xFFFFFFFF))
        return [(high + k * low).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(FILTER_PROBES)]

    def passes(self, found: np.ndarray) -> np.ndarray:
        high, low = found >> np.uint64(32), found & np.uint64(0xFFFFFFFF)
        ok = np.arange(len(found))
        for k in range(FILTER_PROBES):
            slot = (high[ok] + np.uint64(k) * low[ok]) & np.uint64((1 << self.bits) - 1)
            ok = ok[(self.words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1]
        return ok


class Benchmark:
    """The items as DataFrames: seeds (seed, item), bodies (item, words) and members (item, item_id)."""

    def __init__(self, benchmark: DataFrame):
        # Equal items are one class, known by the digest of its text.
        rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("item", F.unhex(F.sha2("text", 256)))
        self.members = rows.select("item", "item_id")
        done = stored(rows.groupBy("item").agg(F.first("text").cast("binary").alias("text")).mapInArrow(frugal(_item_words), "item binary, words array<bigint>, seeds array<struct<kind: int, seed: bigint>>"))
        seeded_ = done.select("item", F.explode("seeds").alias("s")).select("item", "s.kind", "s.seed")
        self.seeds = seeded_.select("seed", "item").distinct()
        n = seeded_.agg(F.count("*").alias("n"), F.collect_set("kind").alias("kinds")).first()
        size = done.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        self.small, self.kinds = max(n.n, size) <= MAX_SIDE, sorted(n.kinds)
        self.bodies = done.filter(F.size("seeds") > 0).select("item", "words")
        bits = min(MAX_FILTER, max(1 << 12, n.n * FILTER_BITS)).bit_length()
        bits = min(bits, MAX_FILTER.bit_length() - 1)
        slot = self.seeds.select(F.explode(F.array(*Filter.slots(F.col("seed"), bits))).alias("slot"))
        # At most MAX_FILTER bits, 64 a row.
        packed = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
        self.filter = Filter(bits, [(r.at, r.value) for r in packed.collect()], self.kinds)

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _passing(known: Filter, texts: pa.Array) -> list[list[int]]:
    """For each text the distinct seeds that pass."""
    data, offsets = texts_of(pa.RecordBatch.from_arrays([texts.cast(pa.binary()).fill_null(b"")], ["text"]))
    out: list[list[int]] = []
    for i, j in chunks(offsets):
        hashes, rows = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found: list[set] = [set() for _ in range(j - i)]
        for kind in known.kinds:
            own, at = seeds(hashes, rows, kind)
            ok = known.passes(own)
            for row, seed in zip(rows[at[ok]].tolist(), own[ok].view(np.int64).tolist(), strict=True):
                found[row].add(seed)
        out += [sorted(x) for x in found]
    return out


def _split(known: Filter, text: int, hit: bool) -> Callable:
    """Rows with a passing seed, with these seeds; or the other rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _passing(known, batch.column(text))
            part = batch.filter(pa.array([bool(x) == hit for x in found], pa.bool_()))
            if hit:
                part = pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x in found if x], pa.list_(pa.int64()))], [f"c{k}" for k in range(batch.num_columns + 1)])
            yield part

    return rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch)
        out: list[tuple] = []
        for i, items in enumerate(batch.column("items")):
            text = Text(words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0])
            for one in items:
                won = best(text, one["words"].values.to_numpy(zero_copy_only=False).view(np.uint64))
                if won:
                    out.append((i, one["item"].as_py(), *won))
        if out:
            row, item, *numbers = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row)), pa.array(item, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], ["row", "item", "matched", "words", "first_word"])


def _candidates(docs: DataFrame, known: Benchmark) -> tuple[DataFrame, DataFrame]:
    """Stored rows of docs with a passing seed, their columns inside `doc`, numbered as `row`; and the overlaps
    (row, item, matched, words, first_word) found in them."""
    at = docs.columns.index("text")
    kinds = T.StructType([*[T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)], T.StructField(f"c{len(docs.columns)}", T.ArrayType(T.LongType()))])
    some = stored(docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(frugal(_split(known.filter, at, True)), kinds))
    some = numbered(some, "row", is_table=True).select("row", F.col(f"c{at}").alias("text"), F.col(f"c{len(docs.columns)}").alias("seeds"), F.struct(*[f"c{k}" for k in range(len(docs.columns))]).alias("doc"))
    hits = some.select("row", F.explode("seeds").alias("seed"))
    pairs = stored(hits.join(known.side(known.seeds), "seed").select("row", "item").distinct())
    groups = pairs.groupBy("row").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    lists = pairs.join(groups, "row").join(known.side(known.bodies), "item").groupBy("row", F.pmod(F.xxhash64("item"), "groups").alias("group")).agg(F.collect_list(F.struct("item", "words")).alias("items"))
    asked = some.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).join(lists, "row").select("row", "text", "items")
    schema = T.StructType([some.schema["row"], T.StructField("item", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("matched", "words", "first_word")]])
    return some, asked.mapInArrow(frugal(_verify), schema)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, matched, words and first_word (the item's matching words
    where it has most of them, and the span that they take up)."""
    known = Benchmark(benchmark)
    some, found = _candidates(docs.select("doc_id", "text"), known)
    found = found.join(some.select("row", F.col("doc.c0").alias("doc_id")), "row").join(known.members, "item")
    return found.select("doc_id", "item_id", "matched", "words", "first_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with all their columns. Documents without a passing seed are not moved."""
    known = Benchmark(benchmark)
    some, found = _candidates(docs, known)
    clear = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(frugal(_split(known.filter, docs.columns.index("text"), False)), T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]))
    left = some.join(found.select("row").distinct(), "row", "left_anti").select("doc.*")
    return clear.unionByName(left).toDF(*docs.columns)
