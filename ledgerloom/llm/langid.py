"""Language identification by interpolated Kneser-Ney models of characters.

1. A text is its letters in lower case, with one space for whatever lies between words. Every window of ORDER letters is
   counted for its language, over all learning documents and whole texts: windows are counted in each task, summed by a
   shuffle, and make one table of (language, window, count). Nothing of it is sampled.
2. From that table come, as aggregates and joins: for the longest windows the counts, for shorter ones how many different
   letters precede them; a discount for each language and length (n1 / (n1 + 2 n2)); the probability of each window's
   last letter, interpolated with that of the shorter window; and for each context the weight with which a letter unseen
   after it is looked up in the shorter one. The shortest falls back to one over the size of all languages' alphabet.
3. The most frequent windows are broadcast as one sorted array of 64-bit hashes with a number for each language, `entries`
   numbers at most (8 bytes a window, 4 a number). A window that is not among them, be it rare or never learned, is
   written out with its text's row and how often it is there. The distinct ones are settled by joins with the whole tables
   of step 2 and joined back, so a text's sum is the same whatever `entries` is, up to rounding.
4. A text's cross-entropy under a language is the mean over its letters, so length does not matter; the least wins. The
   distinct windows of some two million letters are looked up together.
5. One learning document in CALIBRATION is not counted but calibrates: how often the winner is right by how far it is
   ahead (bins, made monotonic) gives the score, and for each language the cross-entropy that all but REJECTED of its own
   documents stay below. A text above that, or with a score below `least_score`, is not accepted.

Edge cases: null texts and texts without a letter are UNKNOWN with score 0; so is everything where nothing was learned;
rows without a language teach nothing; one language only is always the winner; of equal cross-entropies the first language in order of
name wins; repeated rows count again; an empty table gives an empty result; further columns are kept, whatever their names,
and results are refused under a name that the input has; a text of any length is read in pieces with the letters before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import frugal, quoted, stored, unclaimed

ORDER, ENTRIES = 5, 1 << 22
CALIBRATION, REJECTED, LEAST_SCORE = 8, 0.005, 0.5
UNKNOWN = "und"
#: Letters of a text read at once, and letters of all texts looked up together.
PIECE, TOGETHER = 1 << 18, 1 << 21
BINS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """By code point: the letter in lower case, or a space."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def pieces(text: str) -> Iterator[np.ndarray]:
    """The letters of a text and a space after the last, each piece with the ORDER - 1 before it (spaces before the first)."""
    before, last = np.full(ORDER - 1, _SPACE, np.uint32), _SPACE
    for at in range(0, len(text), PIECE):
        codes = letters()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if at + PIECE >= len(text):
            codes = np.append(codes, np.uint32(_SPACE))
        gap = codes == _SPACE
        kept = codes[~(gap & np.concatenate(([last == _SPACE], gap[:-1])))]
        if len(kept):
            whole = np.concatenate((before, kept))
            yield whole
            before, last = whole[-(ORDER - 1) :], kept[-1]


def together(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of the pieces of many texts one after another, the row of each piece and where each begins."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        if not text.is_valid:
            continue
        for piece in pieces(text.as_buffer().to_pybytes().decode("utf-8", "replace")):
            held.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= TOGETHER:
                yield np.concatenate(held), np.array(rows), np.cumsum([0, *[len(p) for p in held[:-1]]])
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.array(rows), np.cumsum([0, *[len(p) for p in held[:-1]]])


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _BASE + codes[:, k].astype(np.uint64)
    return h


def windows(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ORDER codes within one piece begins, and its hash."""
    n = len(codes) - ORDER + 1
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for k in range(1, ORDER):
        h *= _BASE
        h += wide[k : k + n]
    inside = np.ones(n, bool)
    inside[(starts[1:, None] - np.arange(1, ORDER)).ravel()] = False
    at = np.flatnonzero(inside)
    return at, h[at]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: the windows of the texts of some millions of letters, by language."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        of_row = names.indices.to_numpy(zero_copy_only=False)
        for codes, rows, starts in together(batch.column(1).cast(pa.large_binary())):
            at, h = windows(codes, starts)
            sizes = np.diff(np.append(starts, len(codes))) - (ORDER - 1)
            lang = np.repeat(of_row[rows], sizes)
            for k in np.unique(lang):
                own = np.flatnonzero(lang == k)
                _, first, count = np.unique(h[own], return_index=True, return_counts=True)
                grams = np.ascontiguousarray(codes[at[own[first]][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([names.dictionary[int(k)].as_py()] * len(first), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(count, pa.int64())], names=["lang", "gram", "n"])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over whole texts."""
    known = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return known.mapInArrow(frugal(_counted), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _each(n: int, one: Callable[[int], Column]) -> Column:
    """An array with a value for each of n languages."""
    return F.array(*[one(i) for i in range(n)])


def _of(column: str, i: int) -> Column:
    return F.get(column, F.lit(i))


def estimates(grams: DataFrame, langs: list[str], alphabet: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By length, from 1: (gram, n, p), how often each language has the window and, under each, the probability of its last letter after the
    others. By length, from 0: (context, back), the weight of the shorter window for letters unseen after it (1 where a language lacks it)."""
    size = len(langs)
    counted = _each(size, lambda i: F.coalesce(F.sum(F.when(F.col("lang") == langs[i], F.col("n"))), F.lit(0)))
    levels = {ORDER: stored(grams.groupBy("gram").agg(counted.alias("n")))}
    seen = [F.count_if(_of("n", i) > 0) for i in range(size)]
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.array(*seen).alias("n")))
    chances, backs = [], []
    for k in range(1, ORDER + 1):
        rare = levels[k].agg(*[F.count_if(_of("n", i) == x) for i in range(size) for x in (1, 2)]).first()
        cuts = [min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5 for n1, n2 in zip(rare[::2], rare[1::2], strict=True)]
        rows = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
        after = rows.groupBy("context").agg(_each(size, lambda i: F.sum(_of("n", i))).alias("total"), F.array(*seen).alias("kinds"))
        # By functions of whole arrays, so that expressions do not grow with the square of the number of languages.
        cut = F.from_json(F.lit(json.dumps(cuts)), "array<double>")
        back = F.transform(F.arrays_zip(cut.alias("cut"), "total", "kinds"), lambda x: F.when(x["total"] > 0, x["cut"] * x["kinds"] / x["total"]).otherwise(1.0))
        after = after.select("context", "total", back.alias("back"))
        rows = rows.join(after, "context")
        if chances:
            below = chances[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("less"))
            rows = rows.join(below, F.substring("gram", 2, k - 1) == F.col("shorter"))
        else:
            rows = rows.withColumn("less", F.array_repeat(F.lit(1.0 / alphabet), size))
        p = F.transform(F.arrays_zip(cut.alias("cut"), "n", "total", "back", "less"), lambda x: F.greatest(x["n"] - x["cut"], F.lit(0.0)) / F.greatest(x["total"], F.lit(1)) + x["back"] * x["less"])
        chances.append(stored(rows.select("gram", "n", p.alias("p"))))
        backs.append(after.select("context", "back"))
    return chances, backs


@dataclass
class Model:
    """The most frequent windows as sorted hashes with the logarithms of their probability under each language, and the tables of `estimates`,
    which settle any other window."""

    langs: list[str]
    alphabet: int
    hashes: list[np.ndarray]  # of one table
    logs: list[np.ndarray]  # by language
    chances: list[DataFrame]
    backs: list[DataFrame]

    def settled(self, grams: DataFrame) -> DataFrame:
        """(gram, logs) of distinct windows, by joins with all that was learned."""
        size = len(self.langs)
        rows = grams.withColumn("p", F.array_repeat(F.lit(1.0 / self.alphabet), size))
        for k in range(1, ORDER + 1):
            known = self.chances[k - 1].select(F.col("gram").alias("own"), F.col("p").alias("known"))
            context = self.backs[k - 1]
            # Single letters are few, and much has the same.
            if k <= 2:
                context = F.broadcast(context)
            if k == 1:
                known = F.broadcast(known)
            rows = rows.join(known, F.substring("gram", ORDER + 1 - k, k) == F.col("own"), "left")
            rows = rows.join(context, F.substring("gram", ORDER + 1 - k, k - 1) == F.col("context"), "left")
            shorter = F.when(F.col("back").isNull(), F.col("p")).otherwise(F.zip_with("back", "p", lambda b, p: b * p))
            rows = rows.select("gram", F.coalesce("known", shorter).alias("p"))
        return rows.select("gram", F.transform("p", _log).alias("logs"))


def _log(p: Column) -> Column:
    return F.log(p).cast("float")


def _frequent(grams: DataFrame, most: int) -> DataFrame:
    """The windows from some count on, `most` at most; counts within half an octave are held together or not at all."""
    rows = grams.withColumn("bin", F.floor(F.log2(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)) * 2))
    held, least = 0, None
    for r in rows.groupBy("bin").agg(F.count("*").alias("kinds")).sort(F.desc("bin")).collect():
        held += r.kinds
        if held > most:
            break
        least = r.bin
    return rows.filter(F.lit(False) if least is None else F.col("bin") >= least)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> Model:
    """The models of the languages of docs. `entries` bounds the numbers that are broadcast, not what is known."""
    grams = stored(counts(docs, text, lang))
    langs = [r.lang for r in grams.select("lang").distinct().sort("lang").collect()]
    if not langs:
        return Model([], 1, [np.zeros(0, np.uint64)], [], [], [])
    alphabet = grams.select(F.substring("gram", ORDER, 1)).distinct().count() + 1
    chances, backs = estimates(grams, langs, alphabet)
    held = _frequent(chances[-1], entries // len(langs)).select("gram", *[_log(_of("p", i)).alias(f"l{i}") for i in range(len(langs))]).toArrow()
    h = hashed(np.frombuffer("".join(held["gram"].to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER))
    order = np.argsort(h)
    return Model(langs, alphabet, [h[order]], [held[f"l{i}"].to_numpy()[order] for i in range(len(langs))], chances, backs)


def _scored(keys: np.ndarray, logs: list[np.ndarray]) -> Callable:
    """Of rows (text, row, ...): a row each with its windows and, for each language, the sum of the logarithms of those that are held; and
    a row for each distinct window of a piece of text that is not held, with how often it is there."""
    n_langs = len(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[1:], "letters", "sums", "gram", "n"]
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, n_langs))
            for codes, rows, starts in together(batch.column(0).cast(pa.large_binary())):
                at, h = windows(codes, starts)
                sizes = np.diff(np.append(starts, len(codes))) - (ORDER - 1)
                ends = np.cumsum(sizes)
                np.add.at(n, rows, sizes)
                if not n_langs:
                    continue
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                place = np.searchsorted(keys, distinct)
                held = place < len(keys)
                held[held] = keys[place[held]] == distinct[held]
                for k in range(n_langs):
                    values = np.zeros(len(distinct))
                    values[held] = logs[k][place[held]]
                    np.add.at(sums[:, k], rows, np.add.reduceat(values[inverse], ends - sizes))
                lacking = np.flatnonzero(~held[inverse])
                pairs, times = np.unique(np.repeat(rows, sizes)[lacking] * len(distinct) + inverse[lacking], return_counts=True)
                for i in range(0, len(pairs), PIECE):
                    own, which = np.divmod(pairs[i : i + PIECE], len(distinct))
                    grams = np.ascontiguousarray(codes[at[first[which]][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
                    kept = [pa.nulls(len(own), c.type) for c in batch.columns[2:]]
                    open_ = [batch.column(1).take(pa.array(own)), *kept, pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*open_, pa.array(grams.tolist(), pa.string()), pa.array(times[i : i + PIECE], pa.int64())], names=names)
            values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n_langs, pa.int32()), pa.array(sums.ravel()))
            none = [pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n), values, *none], names=names)

    return run


def entropies(docs: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep`, letters (windows of the text) and entropies (nats a letter, under each language)."""
    kept = docs.select(*keep)
    # Under names of our own until the end. The numbers hold within the one job that writes all rows.
    rows = docs.select(F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept.columns)])
    kinds = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields)]
    scored = stored(rows.mapInArrow(frugal(_scored(model.hashes[0], model.logs)), ", ".join(["row bigint", *kinds, "letters bigint", "sums array<double>", "gram string", "n bigint"])))
    texts, open_ = scored.filter("letters is not null"), scored.filter("gram is not null").select("row", "gram", "n")
    sums = F.col("sums")
    if not open_.isEmpty():
        settled = stored(model.settled(open_.select("gram").distinct()))
        size = len(model.langs)
        more = open_.join(settled, "gram").groupBy("row").agg(_each(size, lambda i: F.sum(F.col("n") * _of("logs", i).cast("double"))).alias("more"))
        texts = texts.join(more, "row", "left")
        sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    mean = F.transform(sums, lambda x: -x / F.greatest(F.col("letters"), F.lit(1)))
    return texts.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept.columns)], "letters", mean.alias("entropies"))


@dataclass
class Calibration:
    """How often the winner is right by bins of how far it is ahead, and the cross-entropy up to which a language's texts are accepted."""

    right: list[float]
    limits: list[float]


def ahead() -> Column:
    """The bin of a text: how far the winner is ahead of the next, by the letter and by the length of the text."""
    by = F.when(F.size("entropies") > 1, (F.get(F.array_sort("entropies"), F.lit(1)) - F.array_min("entropies")) * F.sqrt("letters")).otherwise(F.lit(1e9))
    return F.least(F.lit(BINS - 1), F.floor(F.log2(1 + by) * 6)).cast("int")


def winner() -> Column:
    """The index of the least cross-entropy."""
    return F.array_position("entropies", F.array_min("entropies")).cast("int") - 1


def calibrate(scores: DataFrame, model: Model) -> Calibration:
    """From rows of (lang, letters, entropies) that the model has not counted."""
    names = F.array(*[F.lit(x) for x in model.langs])
    rows = stored(scores.filter("letters > 0").select("lang", F.get(names, winner()).alias("won"), F.array_min("entropies").alias("entropy"), ahead().alias("bin")))
    counted = {r.bin: (r.n, r.ok) for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("won") == F.col("lang")).alias("ok")).collect()}
    limits = {r.lang: r.most for r in rows.filter("won = lang").groupBy("lang").agg(F.percentile_approx("entropy", 1 - REJECTED, 10_000).alias("most")).collect()}
    # Pool neighbours that fall, then add a right and a wrong one to each pool.
    pools: list[list[float]] = []
    for b in range(BINS):
        n, ok = counted.get(b, (0, 0))
        pools.append([n, ok, 1])
        while len(pools) > 1 and (pools[-1][0] == 0 or pools[-2][0] == 0 or pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]):
            top = pools.pop()
            pools[-1] = [a + c for a, c in zip(pools[-1], top, strict=True)]
    right = [(ok + 1) / (n + 2) for n, ok, size in pools for _ in range(int(size))]
    return Calibration(list(np.maximum.accumulate(right)), [limits.get(x, float("inf")) for x in model.langs])


def identified(scores: DataFrame, model: Model, how: Calibration, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows of `entropies` with lang_pred, score, entropy and accepted in place of letters and entropies."""
    unclaimed(scores.drop("letters", "entropies"), "lang_pred", "score", "entropy", "accepted")
    known = (F.col("letters") > 0) & F.lit(bool(model.langs))
    # Arrays of constants, one number or name for each bin or language.
    names, limits, right = (F.array(*[F.lit(v) for v in x]) if x else F.lit(None).cast(f"array<{t}>") for x, t in ((model.langs, "string"), (how.limits, "double"), ([float(x) for x in how.right], "double")))
    entropy = F.when(known, F.array_min("entropies"))
    score = F.when(known, F.get(right, ahead())).otherwise(F.lit(0.0))
    accepted = known & (F.array_min("entropies") <= F.get(limits, winner())) & (score >= least_score)
    kept = [F.col(f"`{c}`") for c in scores.columns if c not in ("letters", "entropies")]
    return scores.select(*kept, F.coalesce(F.when(known, F.get(names, winner())), F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), entropy.alias("entropy"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def learned(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", entries: int = ENTRIES) -> DataFrame:
    """All columns of docs but the text, with lang_pred, score, entropy and accepted, by a model of the rows for which `learn` holds. One in
    CALIBRATION of them is left for calibration; each text is scored once."""
    unclaimed(docs, "lang_pred", "score", "entropy", "accepted")
    # By the hash of the text, so that copies of a text play the same part.
    part = F.when(~F.coalesce(learn, F.lit(False)) | quoted(lang).isNull(), 0).when(F.pmod(F.xxhash64(quoted(text)), F.lit(CALIBRATION)) == 0, 2).otherwise(1)
    # Under names of our own, whatever those of the input are.
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(others)], quoted(text).cast("string").alias("text"), quoted(lang).cast("string").alias("lang"), part.alias("part"))
    model = fit(rows.filter("part = 1"), entries=entries)
    scores = stored(entropies(rows, model, *[f"c{i}" for i in range(len(others))], "lang", "part"))
    how = calibrate(scores.filter("part = 2"), model) if model.langs else Calibration([], [])
    found = identified(scores.drop("lang", "part"), model, how)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], "lang_pred", "score", "entropy", "accepted")
