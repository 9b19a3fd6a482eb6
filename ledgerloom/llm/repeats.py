"""Removal of long repeated byte strings over a prefix-free parse.

Every byte is removed that lies in a string of `LENGTH` = 400 bytes which also starts anywhere else in the
corpus. In the corpus order of a suffix array the starts of equal strings are neighbours. That order is made from a
parse, so the work follows the distinct phrases and not the corpus:

1. Texts: exact copies become one row with a count, stored in buckets by key, so that later joins with
   the texts do not shuffle them again.
2. Parse: a rolling hash of 32 bytes triggers phrases. The trigger of a start is the least hash in its
   400 bytes, so equal strings have equal triggers wherever they stand and no start lacks one. A phrase
   is a run of starts with one trigger, extended by the bytes its last string needs, so that no string crosses
   phrases and what the order of the parse would add is in the phrase.
3. Dictionary: equal extended phrases are one class with a weight. A class of weight 2 or more is
   repeated as a whole; a class whose trigger string occurs once is not repeated at all.
4. Blocks of 32 neighbouring suffixes of the rest of the dictionary, mostly phrases around edits: dropped where the
   369 bytes common to the block occur once, taken whole where the bytes of the whole block occur twice.
5. Corpus order of the suffixes that are left: by their common 369 bytes, then by the place of these in the
   suffix, then by the 31 bytes around them. The order is range-partitioned and sorted, each suffix is compared
   with its neighbours, and the ends of the partitions are compared in a second small step. Any number of equal
   suffixes spreads over as many partitions as it takes.

Equality: whole texts, phrases, blocks and common bytes are told apart by cryptographic digests of their bytes (128 bits),
as content-addressed stores do, the 31 bytes around as they are. Rolling hashes choose triggers only, so no text is
lost where they collide. The order of unequal common bytes is that of their digests, not the alphabet:
removal asks for equal neighbours alone.

Edge cases: null text is empty; texts under 400 bytes stay whole; matches never cross documents; repeated
rows are copies of each other; a null doc_id is kept; a text of any length is one text; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.bytehash import Rolling, chunks, texts_of
from ledgerloom.llm.common import frugal, shared_folder, stored, whole_text

LENGTH, GRAM, BLOCK = 400, 32, 32
WINDOW, COMMON = LENGTH - GRAM + 1, LENGTH - BLOCK + 1


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """128-bit digests of substrings, as two columns of longs."""
    body, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    found = b"".join([make(body[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    pairs = np.frombuffer(found, np.int64).reshape(-1, 2)
    return [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]


def triggers(grams: np.ndarray) -> np.ndarray:
    """For every start the place of the least hash (the first of equals) among the WINDOW grams from there."""
    low = np.uint64((1 << 28) - 1)
    m, span = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while span * 2 <= WINDOW:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    m = np.minimum(m[: len(m) - (WINDOW - span)], m[WINDOW - span :])
    return (m & low).astype(np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch)
        for i, j in chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) < LENGTH:
                continue
            rolling = Rolling(part, (0,))
            at = np.arange(len(part) - GRAM + 1)
            grams = rolling.of(at, at + GRAM, 0)
            trigger = triggers(grams)
            rows = np.repeat(np.arange(j - i), np.diff(own))[: len(trigger)]
            start = np.flatnonzero(np.arange(len(trigger)) + LENGTH <= own[rows + 1])
            if not len(start):
                continue
            trigger, rows = trigger[start], rows[start]
            new = np.flatnonzero(np.r_[True, (np.diff(trigger) != 0) | (np.diff(rows) != 0)])
            first, last = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
            trigger, rows = trigger[new], rows[new]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows + i)),
                    batch.column("copies").take(pa.array(rows + i)),
                    pa.array((first - own[rows]).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)),
                    pa.array((trigger - first).astype(np.int32)),
                    pa.array(grams[trigger].view(np.int64)),
                    *digests(part, first, last + LENGTH),
                ],
                ["key", "copies", "s", "n", "lead", "gram", "e1", "e2"],
            )


PHRASES = "key binary, copies bigint, s int, n int, lead int, gram bigint, e1 bigint, e2 bigint"


def _spread(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each chunk of texts with lists: the bytes, and for each list entry its row, place in the chunk and fields."""
    data, offsets = texts_of(batch)
    lists = batch.column("parts")
    at = np.asarray(lists.offsets)
    fields = {f.name: np.asarray(lists.values.field(k)) for k, f in enumerate(lists.type.value_type)}
    for i, j in chunks(offsets):
        counts = np.diff(at[i : j + 1])
        rows = np.repeat(np.arange(i, j), counts)
        if len(rows):
            yield data[offsets[i] : offsets[j]], rows, offsets[rows] - offsets[i], {k: v[at[i] : at[j]] for k, v in fields.items()}


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... counts times each, and whose they are."""
    own = np.repeat(np.arange(len(first)), counts)
    return np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + first[own], own


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, rows, base, f in _spread(batch):
            s, n, lead = f["s"].astype(np.int64), f["n"].astype(np.int64), f["lead"].astype(np.int64)
            low, high = (lead - n + 1) // BLOCK, lead // BLOCK
            block, own = _ranges(low, high - low + 1)
            # The bytes common to the whole block lie in the text even where the phrase has part of the block only.
            common = (s + lead + base)[own] - BLOCK * block
            lo = np.maximum(common - (BLOCK - 1), (s + base)[own])
            hi = np.minimum(common, (s + base + n - 1)[own])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows[own])),
                    pa.array((lo - base[own]).astype(np.int32)),
                    pa.array((hi - lo + 1).astype(np.int32)),
                    pa.array((common - base[own]).astype(np.int32)),
                    pa.array(f["w"][own].astype(np.int64)),
                    *digests(data, common, common + COMMON),
                    *digests(data, lo, hi + LENGTH),
                ],
                ["key", "s", "n", "at", "w", "c1", "c2", "u1", "u2"],
            )


BLOCKS = "key binary, s int, n int, at int, w bigint, c1 bigint, c2 bigint, u1 bigint, u2 bigint"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single suffixes: their common bytes (digest), how many bytes stand before these, and all bytes around them."""
    for batch in batches:
        for data, rows, base, f in _spread(batch):
            start, own = _ranges(f["s"].astype(np.int64) + base, f["n"].astype(np.int64))
            common = (f["at"].astype(np.int64) + base)[own]
            before, k = common - start, np.arange(BLOCK - 1)
            for a in range(0, len(start), 1 << 16):
                b = min(len(start), a + (1 << 16))
                place = start[a:b, None] + k + np.where(k >= before[a:b, None], COMMON, 0)
                around = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, (b - a + 1) * (BLOCK - 1), BLOCK - 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data[place]))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(rows[own[a:b]])),
                        pa.array((start[a:b] - base[own[a:b]]).astype(np.int32)),
                        pa.array(f["w"][own[a:b]] == 1),
                        pa.array(f["c1"][own[a:b]]),
                        pa.array(f["c2"][own[a:b]]),
                        pa.array(before[a:b].astype(np.int32)),
                        around,
                    ],
                    ["key", "s", "once", "c1", "c2", "before", "around"],
                )


SUFFIXES = "key binary, s int, once boolean, c1 bigint, c2 bigint, before int, around binary"
ORDER = ["c1", "c2", "before", "around"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in corpus order: suffixes equal to a neighbour, and the first and last one, marked `edge`."""
    last, told = None, False

    def plain(table: pa.RecordBatch, rows: np.ndarray, edge: bool) -> pa.RecordBatch:
        part = table.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "s", "once", *ORDER)), pa.array(np.full(len(rows), edge))], ["key", "s", "once", *ORDER, "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            yield plain(batch, np.array([0]), True)
        else:
            batch = pa.concat_batches([last, batch])
        same = np.ones(batch.num_rows - 1, bool)
        for c in ("c1", "c2", "before"):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            same &= x[1:] == x[:-1]
        some = np.flatnonzero(same)
        if len(some):
            x = batch.column("around")
            same[some] = np.asarray(pa.compute.equal(x.take(pa.array(some)), x.take(pa.array(some + 1))))
        found = np.r_[False, same] | np.r_[same, False]
        # The first row is the last of the batch before, which may have been reported already.
        found[0] &= not (last is not None and told)
        told = bool(same[-1]) if len(same) else told
        yield plain(batch, np.flatnonzero(found), False)
        last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield plain(last, np.array([0]), True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and take them out."""
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
            body, merged = text.as_py(), []
            for x in sorted((x["s"], x["e"]) for x in found.as_py() or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], x[1]))
                else:
                    merged.append(x)
            out, at = [], 0
            for a, b in merged:
                out.append(body[at:a])
                at = b
            kept.append(b"".join([*out, body[at:]]))
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def stored_by_key(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder, bucketed by key: joins on key read them without a shuffle. The catalog knows
    them as an external table for the moment only that it takes to refer to them."""
    spark = df.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, "key").write.bucketBy(n, "key").sortBy("key").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, spans (removed runs, byte offsets, sorted) and kept (binary)."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("key"))
    n_bytes = F.octet_length("text").cast("bigint").alias("n_bytes")
    texts = stored_by_key(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.first("doc_id").alias("doc_id")))

    def gathered(parts: DataFrame) -> DataFrame:
        lists = parts.groupBy("key").agg(F.collect_list(F.struct(*[c for c in parts.columns if c != "key"])).alias("parts"))
        return texts.select("key", "text").join(lists, "key")

    def span(whole: DataFrame) -> DataFrame:
        return whole.select("key", "s", (F.col("s") + F.col("n") + LENGTH - 1).alias("e"))

    # Classes are counted before anything is joined, so a phrase or trigger that is everywhere is a few rows by then.
    phrases = stored(texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(frugal(_parse), PHRASES))
    classes = stored(phrases.groupBy("gram", "e1", "e2").agg(F.sum("copies").alias("w"), F.min(F.struct("key", "s", "n", "lead")).alias("at")))
    spans = span(phrases.filter("copies = 1").join(classes.filter("w > 1").select("e1", "e2"), ["e1", "e2"], "left_semi"))

    # Phrases that are not repeated as a whole but whose trigger string is, and all that share it.
    open_ = classes.groupBy("gram").agg(F.sum("w").alias("c"), F.count_if(F.col("w") == 1).alias("u")).filter("c > 1 and u > 0").select("gram")
    live = classes.join(open_, "gram", "left_semi").select("at.key", "at.s", "at.n", "at.lead", "w")
    blocks = stored(gathered(live).mapInArrow(frugal(_blocks), BLOCKS))
    same = stored(blocks.groupBy("c1", "c2", "u1", "u2").agg(F.sum("w").alias("c"), F.min(F.struct("key", "s", "n", "at")).alias("first")))
    spans = spans.unionByName(span(blocks.filter("w = 1").join(same.filter("c > 1").select("u1", "u2"), ["u1", "u2"], "left_semi")))

    mixed = same.groupBy("c1", "c2").agg(F.sum("c").alias("w"), F.count_if(F.col("c") == 1).alias("u")).filter("w > 1 and u > 0").select("c1", "c2")
    live = same.join(mixed, ["c1", "c2"], "left_semi").select("first.key", "first.s", "first.n", "first.at", F.col("c").alias("w"), "c1", "c2")
    suffixes = stored(gathered(live).mapInArrow(frugal(_suffixes), SUFFIXES))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*ORDER, "key", "s"]
    beside = stored(suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(frugal(_neighbours), SUFFIXES + ", edge boolean"))
    # Two edges a partition.
    edges = beside.filter("edge").distinct()
    across = edges.join(edges.groupBy(*ORDER).count().filter("count > 1"), ORDER, "left_semi")
    found = beside.filter("not edge").unionByName(across).filter("once").select("key", "s", (F.col("s") + LENGTH).alias("e"))
    spans = spans.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    # A text that one document has is cut where it lies, and what stays of it is not shuffled. Of copies nothing stays, or all of a short text.
    kinds = StructType([docs.schema["doc_id"], *StructType.fromDDL("n_bytes bigint, spans array<struct<start int, end int>>, kept binary").fields])
    single = texts.filter("copies = 1").join(spans, "key", "left").select("doc_id", n_bytes, "text", "spans").mapInArrow(frugal(_cut), kinds)
    whole = F.octet_length("text") >= LENGTH
    runs = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    # The key as an expression is shuffled on both sides of the join, so adaptive skew splitting applies to a large group of copies.
    copied = texts.filter("copies > 1").select(F.concat("key", F.lit(b"")).alias("key"), runs.alias("spans"), F.when(whole, F.lit(b"")).otherwise(F.col("text")).alias("kept"))
    members = rows.select("doc_id", "key", n_bytes)
    return single.unionByName(members.join(copied, "key").select("doc_id", "n_bytes", "spans", "kept"))
