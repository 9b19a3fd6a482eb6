"""Removal of repeated passages of lines in content-defined chunks (DataFrame functions only).

Lines are cut at line feeds and hashed. Every pair of neighbouring lines in the corpus is looked up: how often it
occurs, and whether it always has the same line before and after it. A chunk ends where a pair occurs once only,
before a pair that is entered from different lines, and after a pair that is left to different lines. So a
passage of two or more lines that occurs in two places has a boundary at both its ends in both of them, wherever
it is embedded, and is made of whole chunks in between. A chunk of `LEAST` = 2 or more lines that occurs anywhere
before, in this or another document, is taken out; its first occurrence (smallest doc_id, then place in the
table) stays. Where several repeated passages fork, single lines are left between the chunks. With the line before or
after it such a line makes a pair, and a pair that occurs before, without overlapping that place, is a repeated
passage of two lines: the single line goes if the pair's other line is single too or its chunk goes. A line whose
pairs occur here first stays, and so does any line without a repeated pair. What hashes propose, bytes decide: a chunk
or pair is taken out only where it equals its first occurrence byte by byte.

Only hashes and places are shuffled over the corpus; the texts are dealt out once, by row, and serve both
the comparison and the cut. Counts are pre-aggregated, and the joins on a hash have one row a hash on one
side, so a chunk that a third of all documents share is split like any skewed join.

Edge cases: null text stays null and has no chunks; an empty text has one empty line; repeated rows count
as separate documents; null doc_ids come first; an empty table gives an empty result; all columns of the
input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed, fresh, numbered, unclaimed

#: Lines of a chunk at least, and over how many places a pair of lines must be spread to count as repeated.
LEAST, SPREAD = 2, 2
#: What a span of lines is: a chunk, or a pair of lines of which the left, the right or both are chunks of one line.
CHUNK, LEFT, RIGHT, BOTH = range(4)
ROW, LINES, HASHES, ENDS, GLUED, BEFORE, AFTER, CUT = (f"__llm_{x}" for x in ("row", "lines", "hashes", "ends", "glued", "before", "after", "cut"))


def bounded(df: DataFrame, spread: int) -> DataFrame:
    """Adds LINES, ENDS (the number of lines up to the end of each chunk) and GLUED (the second lines of repeated pairs);
    df is the whole corpus, ROW its key."""
    df = df.withColumn(LINES, F.split("text", "\n", -1)).withColumn(HASHES, F.transform(LINES, lambda x: F.xxhash64(x)))
    at = lambda i: F.coalesce(F.get(F.col(HASHES), i), F.lit(0))
    last = F.size(HASHES)
    pair = lambda i: F.struct(i.alias("i"), F.xxhash64(at(i - 1), at(i)).alias("p"), at(i - 2).alias("l"), at(i + 1).alias("r"))
    pairs = df.filter(last > 1).select(ROW, F.explode(F.transform(F.sequence(F.lit(1), last - 1), pair)).alias("x")).select(ROW, "x.*")
    # One row a pair; its neighbours differ where the least and the greatest do.
    known = pairs.groupBy("p").agg(F.count("*").alias("n"), (F.min("l") != F.max("l")).alias("entered"), (F.min("r") != F.max("r")).alias("left"))
    known = known.filter(F.col("n") >= spread).select("p", "entered", "left")
    marks = pairs.select(ROW, "i", "p").join(known, "p").groupBy(ROW).agg(
        F.collect_list("i").alias(GLUED),
        F.collect_list(F.when(F.col("entered"), F.col("i") - 1)).alias(BEFORE),
        F.collect_list(F.when(F.col("left"), F.col("i") + 1)).alias(AFTER),
    )
    df = df.join(marks, ROW, "left")
    none = F.array().cast("array<int>")
    single = F.array_except(F.sequence(F.lit(1), last), F.coalesce(GLUED, none))
    ends = F.array_union(F.array_union(single, F.coalesce(BEFORE, none)), F.coalesce(AFTER, none))
    return df.withColumn(ENDS, F.when(F.col("text").isNotNull(), F.array_sort(F.filter(ends, lambda i: (i > 0) & (i <= last))))).drop(BEFORE, AFTER)


def chunks(df: DataFrame, *keep: str | Column) -> DataFrame:
    """One row a chunk of LEAST or more lines, or a repeated pair with a single line: `keep`, first line, end (exclusive), hash, kind."""
    spans = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ENDS, 1, F.size(ENDS) - 1)), F.col(ENDS), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    hashed = lambda s, e, kind: F.struct(s.alias("s"), e.alias("e"), F.xxhash64(F.slice(HASHES, s + 1, e - s)).alias("h"), F.lit(kind).alias("kind"))
    long = F.transform(F.filter(spans, lambda x: x["e"] - x["s"] >= LEAST), lambda x: hashed(x["s"], x["e"], CHUNK))
    single = F.transform(F.filter(spans, lambda x: x["e"] - x["s"] == 1), lambda x: x["s"])
    glued = F.coalesce(GLUED, F.array().cast("array<int>"))
    # Sets of second lines; the array functions hash, so a text of any number of lines takes linear time.
    right, left = F.array_intersect(glued, single), F.array_intersect(glued, F.transform(single, lambda i: i + 1))
    both = F.array_intersect(right, left)
    pair = lambda seconds, kind: F.transform(seconds, lambda i: hashed(i - 1, i + 1, kind))
    pairs = [pair(F.array_except(left, right), LEFT), pair(F.array_except(right, left), RIGHT), pair(both, BOTH)]
    found = df.filter(F.col("text").isNotNull()).select(*keep, HASHES, F.explode(F.concat(long, *pairs)).alias("c"))
    return found.select(*keep, "c.s", "c.e", "c.h", "c.kind")


def cut_lines(found: str) -> Column:
    """The (s, e) spans of lines to take out, ascending, of the repeated chunks and pairs (s, e, kind) of a text."""
    of = lambda kind: F.filter(found, lambda x: x["kind"] == kind)
    gone = F.transform(of(CHUNK), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    # The line where the two of a pair meet is the end of a chunk before a single line, and the start of one after it.
    meet = lambda kind, side: F.array_intersect(F.transform(of(kind), lambda x: x["s"] + 1), F.transform(gone, lambda x: x[side]))
    alone = F.array_union(F.transform(of(BOTH), lambda x: x["s"]), F.transform(of(BOTH), lambda x: x["s"] + 1))
    alone = F.array_union(F.array_union(alone, meet(RIGHT, "e")), F.transform(meet(LEFT, "s"), lambda i: i - 1))
    return F.array_sort(F.concat(gone, F.transform(alone, lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))))


def lines_of(lines: str, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(lines, s + 1, e - s), "\n")


def deduplicated(docs: DataFrame, spread: int = SPREAD, cut: str | None = None, is_table: bool = False) -> DataFrame:
    """The documents with repeated chunks taken out of `text`; `cut` names a further column for the (s, e) line spans
    taken out. is_table: docs are read from Parquet files as they are, so need not be stored to tell rows apart."""
    unclaimed(docs, cut)
    others = [c for c in docs.columns if c != "text"]
    (own,) = fresh(docs, "row")
    whole = numbered(docs, own, is_table)
    rows = whole.select(F.col(own).alias(ROW), "doc_id", "text")
    found = checkpointed(chunks(bounded(rows, spread), ROW, "doc_id"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", ROW, "s", "e")
    often = found.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    often = checkpointed(often.select("h", F.col(f"first.{ROW}").alias("first_row"), F.col("first.s").alias("first_s"), F.col("first.e").alias("first_e")))
    overlap = F.when(F.col("kind") == CHUNK, F.lit(0)).otherwise(F.lit(1))
    later = found.join(often.select("h", "first_row", "first_s"), "h").filter((F.col(ROW) != F.col("first_row")) | (F.col("s") > F.col("first_s") + overlap))
    later = checkpointed(later.select(ROW, "s", "e", "h", "kind"))

    # The texts, dealt out by row once: both uses below have this exchange in common.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.select(ROW, "text").repartition(n, ROW)
    wanted = later.select(ROW, "s", "e", "h", "kind", F.lit(False).alias("first")).unionByName(
        often.select(F.col("first_row").alias(ROW), F.col("first_s").alias("s"), F.col("first_e").alias("e"), "h", F.lit(CHUNK).alias("kind"), F.lit(True).alias("first"))
    )
    wanted = wanted.groupBy(ROW).agg(F.collect_list(F.struct("s", "e", "h", "kind", "first")).alias("wanted"))
    read = texts.join(wanted, ROW).withColumn(LINES, F.split("text", "\n", -1))
    pieces = read.select(ROW, LINES, F.explode("wanted").alias("w")).select(ROW, "w.*", lines_of(LINES, F.col("w.s"), F.col("w.e")).alias("piece"))
    firsts = pieces.filter("first").select("h", F.col("piece").alias("own"))
    equal = pieces.filter(~F.col("first")).join(firsts, "h").filter("piece = own")
    gone = equal.groupBy(ROW).agg(F.collect_list(F.struct("s", "e", "kind")).alias(CUT)).withColumn(CUT, cut_lines(CUT))

    left = texts.join(gone, ROW, "left").withColumn(CUT, F.coalesce(CUT, F.array().cast("array<struct<s:int,e:int>>")))
    left = left.withColumn(LINES, F.when(F.size(CUT) > 0, F.split("text", "\n", -1)))
    starts = F.concat(F.array(F.lit(0)), F.transform(CUT, lambda x: x["e"]))
    stops = F.concat(F.transform(CUT, lambda x: x["s"]), F.array(F.size(LINES)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(LINES, a + 1, b - a)))
    left = left.select(ROW, F.when(F.col(LINES).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), CUT)
    spans = [F.col(CUT).alias(cut)] if cut else []
    left = left.select(F.col(ROW).alias(own), "text", F.col(CUT))
    if not others:
        return left.select("text", *spans)
    # The others' names may be anything: the join sees them inside one struct.
    rest = whole.select(own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"))
    done = rest.join(left, own)
    return done.select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns], *spans)
