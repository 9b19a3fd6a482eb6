"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

1. Training, on at most `max_labelled` = 10,000 labelled documents. Executors measure their texts; the driver gets numbers only. Each language and pair of labels is a stratum
   and small strata are taken whole; of the others those with the least hash of doc_id and label are taken, so the
   choice does not depend on the order of rows, and they count for more in the regression. For each of the two
   faults, low quality and toxic, the words that are significantly more frequent in faulty documents (exact binomial
   tail, false discovery rate `FALSE_WORDS`, so that few labels suffice) are weighed, and a logistic regression
   combines the sum of their weights with measures of form (share of symbols, digits and
   capitals, repeated words, word length and so on). The model is a few small arrays.
2. Evidence: every document, whole, gets a log-odds score for each fault, once; the scores are stored.
3. Sites: scores are aggregated over all documents by host (`source`) and by path (`source` and `lang`).
   A host's rate of faults is shrunk toward the global rate, a path's toward its host's, each by a prior
   weight from the variance between sites (method of moments), so sparse sites say little.
4. A document's posterior log-odds are its evidence plus the shift of its path from the global rate. It is
   rejected where the probability of either fault is over `threshold`.

Edge cases: null text is empty, which has its own feature; null or missing hosts and paths are sites of
their own; without labels nothing is known and every document is kept; repeated rows are scored alike; an
empty table gives an empty result; further columns are kept, whatever their names, and results are refused under a
name that the input has; a text of any length is one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bytehash import chunks, texts_of, words
from ledgerloom.llm.common import fresh, frugal, stored, unclaimed

FAULTS = ("low", "toxic")
BITS = 18
#: Of the words weighed so many may have come by chance.
FALSE_WORDS = 0.1
MAX_LABELLED, MAX_SITES, MAX_STRATA = 10_000, 100_000, 1_000
#: How many documents' worth a score may say, and how far a site may shift a document, in log-odds.
LIMIT = 12.0


def _classes() -> np.ndarray:
    """Per byte: 0 other, 1 letter or byte of a longer sequence, 2 capital, 3 digit, 4 space, 5 line feed, 6 common mark, 7 symbol."""
    kinds = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kinds[b] = 1 if b >= 128 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 6 if c in ".,;:'\"()-?" else 7 if 33 <= b < 127 else 0
    return kinds


CLASSES = _classes()
N_FORM = 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of form for each text, and the distinct (row, word bucket) pairs."""
    n = len(offsets) - 1
    kinds = CLASSES[data]
    rows = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(rows * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(np.float64)
    size = np.maximum(1, np.diff(offsets))
    hashes, own = words(data, offsets)
    total = np.bincount(own, minlength=n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(hashes), bool)
    twice[2:] = (hashes[2:] == hashes[:-2]) & (own[2:] == own[:-2])
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((own << BITS) | bucket)
    row, bucket = pairs >> BITS, pairs & ((1 << BITS) - 1)
    distinct = np.bincount(row, minlength=n)
    breaks = np.zeros(len(data), bool)
    breaks[1:] = (kinds[1:] >= 6) & (kinds[:-1] >= 6)
    per_word = np.maximum(1, total)
    form = np.stack(
        [
            *(counts[:, 1:8] / size[:, None]).T,
            np.log1p(total),
            distinct / np.maximum(1.0, total) ** 0.75,
            np.bincount(own, weights=same, minlength=n) / per_word,
            np.bincount(own, weights=twice, minlength=n) / per_word,
            (counts[:, 1] + counts[:, 2]) / per_word / 10,
            np.bincount(rows, weights=breaks, minlength=n) / size,
            np.log1p(counts[:, 7]) - np.log1p(total) / 2,
            counts[:, 7] > 0.02 * size,
            total == 0,
        ],
        axis=1,
    )
    return form, row, bucket


@dataclass
class Model:
    """weights: for each fault a weight for each word bucket; of the regression: mean, scale, coefficients with the intercept last."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray

    def inputs(self, form: np.ndarray, row: np.ndarray, bucket: np.ndarray, k: int) -> np.ndarray:
        said = np.bincount(row, weights=self.weights[k][bucket], minlength=len(form))
        return np.column_stack([form, np.minimum(said, LIMIT)])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        form, row, bucket = features(data, offsets)
        out = []
        for k in range(len(FAULTS)):
            x = (self.inputs(form, row, bucket, k) - self.mean[k]) / self.scale[k]
            out.append(np.clip(np.clip(x, -6, 6) @ self.coefficients[k][:-1] + self.coefficients[k][-1], -LIMIT, LIMIT))
        return np.stack(out, axis=1)


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is last and not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + shrink
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def tails(a: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """Binomial probability of a or more of n, by the share of one."""
    pairs, back = np.unique(np.stack([a, n]), axis=1, return_inverse=True)
    logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, n.max(initial=0) + 1)))]
    out = np.ones(pairs.shape[1])
    for q, (i, m) in enumerate(pairs.T.tolist()):
        k = np.arange(i, m + 1)
        out[q] = np.exp(logs[m] - logs[k] - logs[m - k] + k * np.log(share) + (m - k) * np.log1p(-share)).sum()
    return np.minimum(out, 1.0)[back.reshape(-1)]


def word_weights(row: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratios of how often faulty and other documents have a word, where the difference is significant, else 0."""
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    a = np.bincount(bucket[y[row]], minlength=1 << BITS)
    b = np.bincount(bucket[~y[row]], minlength=1 << BITS)
    ratio = np.log((a + 0.1) / (n1 + 0.2)) - np.log((b + 0.1) / (n0 + 0.2))
    share = n1 / (n1 + n0)
    # Words too rare to be significant whoever has them are no tests; the others are held to the false discovery rate.
    tested = (a + b > 1) & ((a + b) * np.log(share) <= np.log(FALSE_WORDS))
    some = np.flatnonzero(tested & (ratio > np.log(4)))
    chance = tails(a[some], (a + b)[some], share)
    ranked = np.sort(chance)
    passed = np.flatnonzero(ranked <= FALSE_WORDS * np.arange(1, len(ranked) + 1) / max(1, int(tested.sum())))
    out = np.zeros(1 << BITS)
    if len(passed):
        chosen = some[chance <= ranked[passed[-1]]]
        out[chosen] = np.clip(ratio[chosen], 0, 6)
    return out


def min_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two min-hashes over the 4-word shingles of each text."""
    hashes, own = words(data, offsets)
    first = np.searchsorted(own, np.arange(len(offsets)))
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = max(1, b - a - 3)
        runs = sum((hashes[a + k : a + k + n] * np.uint64(2 * k + 3) for k in range(min(4, b - a))), np.zeros(n if b > a else 1, np.uint64))
        out[i] = [((runs ^ (runs >> np.uint64(27))) * np.uint64(f)).min() for f in (0x9E3779B97F4A7C15, 0x94D049BB133111EB)]
    return out


def one_of_each(marks: np.ndarray) -> np.ndarray:
    """The places of texts that share neither of their two marks with one before: copies would count as many."""
    seen: list[set] = [set(), set()]
    kept = []
    for i, low in enumerate(marks.tolist()):
        if all(x not in m for x, m in zip(low, seen, strict=True)):
            kept.append(i)
        for x, m in zip(low, seen, strict=True):
            m.add(x)
    return np.array(kept, np.int64)


def fit(form: np.ndarray, row: np.ndarray, bucket: np.ndarray, faults: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """form, row and bucket as `features` gives them; faults: a row each text, a boolean for each of FAULTS; weight: how many
    documents each text stands for."""
    weight = np.ones(len(form)) if weight is None else weight
    dims = N_FORM + 1
    model = Model(np.zeros((2, 1 << BITS)), np.zeros((2, dims)), np.ones((2, dims)), np.zeros((2, dims + 1)))
    for k in range(len(FAULTS)):
        y = faults[:, k]
        model.weights[k] = word_weights(row, bucket, y)
        x = model.inputs(form, row, bucket, k)
        model.mean[k], model.scale[k] = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        model.coefficients[k] = regression(np.clip((x - model.mean[k]) / model.scale[k], -6, 6), y.astype(float), weight)
    return model


def rates(counts: list[int], most: int) -> list[float]:
    """The share of each stratum to take: all of the small ones, and the same number from each of the others."""
    left, rest = float(most), len(counts)
    for n in sorted(counts):
        if n * rest > left:
            return [min(1.0, left / rest / c) for c in counts]
        left, rest = left - n, rest - 1
    return [1.0] * len(counts)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its measures of form, distinct word buckets and min-hash marks, instead of the text."""
    for batch in batches:
        data, offsets = texts_of(batch)
        for i, j in chunks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            form, row, bucket = features(part, own)
            marks = min_hashes(part, own)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(i, j - i) for c in ("doc_id", "quality", "toxic", "rate")),
                    pa.FixedSizeListArray.from_arrays(pa.array(form.reshape(-1)), N_FORM).cast(pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32))),
                    pa.array(marks[:, 0].view(np.int64)),
                    pa.array(marks[:, 1].view(np.int64)),
                ],
                ["doc_id", "quality", "toxic", "rate", "form", "buckets", "m1", "m2"],
            )


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, path: str = "lang") -> Model | None:
    """The driver gets measures of at most max_labelled texts: N_FORM numbers and at most 2^BITS word buckets (1 MB) each, no texts."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", "quality", "toxic")
    kind = F.coalesce(F.col(path).cast("string"), F.lit(""))
    known = docs.select("doc_id", kind.alias("kind")).join(known, "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("kind").alias("kind"))
    # Bounded by MAX_STRATA, the largest first.
    sizes = known.groupBy("kind", "quality", "toxic").count().orderBy(F.desc("count"), "kind", "quality", "toxic").limit(MAX_STRATA).collect()
    if not sizes:
        return None
    share = dict(zip([(r.kind, r.quality, r.toxic) for r in sizes], rates([r["count"] for r in sizes], max_labelled), strict=True))
    strata = docs.sparkSession.createDataFrame([(*k, v) for k, v in share.items()], known.select("kind", "quality", "toxic", F.lit(1.0).alias("rate")).schema)
    mark = F.pmod(F.xxhash64("doc_id", "quality", "toxic"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(strata), ["kind", "quality", "toxic"]).withColumn("mark", mark / F.col("rate")).filter("mark < 1")
    chosen = chosen.orderBy("mark", "doc_id", "quality", "toxic").limit(max_labelled).select("doc_id", "quality", "toxic", "rate")
    # At most max_labelled ids and labels: small enough to broadcast whatever the size of the tables. A document id
    # that comes with several rows counts once.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality", "toxic", "rate").agg(F.min("text").cast("binary").alias("text"))
    id_kind, label_kinds = docs.schema["doc_id"].dataType.simpleString(), [labels.schema[c].dataType.simpleString() for c in ("quality", "toxic")]
    schema = f"doc_id {id_kind}, quality {label_kinds[0]}, toxic {label_kinds[1]}, rate double, form array<double>, buckets array<int>, m1 bigint, m2 bigint"
    rows = rows.mapInArrow(frugal(_measured), schema).orderBy("doc_id", "quality", "toxic").limit(max_labelled)
    got = [(r.form, np.asarray(r.buckets, np.int32), r.m1, r.m2, r.quality == 0, r.toxic == 1, 1 / r.rate) for r in rows.toLocalIterator()]
    if not got:
        return None
    form, buckets, m1, m2, low, toxic, weight = zip(*got, strict=True)
    kept = one_of_each(np.stack([m1, m2], axis=1))
    row = np.repeat(np.arange(len(kept)), [len(buckets[i]) for i in kept])
    return fit(np.array(form)[kept], row, np.concatenate([buckets[i] for i in kept]).astype(np.int64), np.stack([low, toxic], axis=1)[kept], np.array(weight)[kept])


def _scorer(model: Model, carry: list[str], names: list[str]) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(carry)).cast(pa.binary()).fill_null(b"")
            data, offsets = texts_of(pa.RecordBatch.from_arrays([text], ["text"]))
            found = [model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            found = np.concatenate(found) if found else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found[:, 0]), pa.array(found[:, 1])], [*carry, *names])

    return score


def scored(docs: DataFrame, model: Model, carry: list[str], names: tuple[str, str] = ("low", "toxic")) -> DataFrame:
    """The columns `carry` of docs with two more, the log-odds of the faults by their texts alone."""
    body = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias(fresh(docs, "text")[0]))
    added = [T.StructField(name, T.DoubleType()) for name in names]
    return body.mapInArrow(frugal(_scorer(model, carry, list(names))), T.StructType([*[docs.schema[c] for c in carry], *added]))


def logit(p):
    return F.log(p / (1 - p))


def site_sums(evidence: DataFrame) -> DataFrame:
    """A row for each host and path of the scored documents (host, path, low, toxic): documents, and sums of the probabilities
    of each fault and of their squares."""
    sums = []
    for k in FAULTS:
        p = 1 / (1 + F.exp(-F.col(k)))
        sums += [F.sum(p).alias(f"s_{k}"), F.sum(p * p).alias(f"q_{k}")]
    return evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *sums)


def site_shifts(paths: DataFrame) -> DataFrame:
    """For each (host, path) how far its shrunk rate of each fault lies from the global one, in log-odds, and its documents."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"{a}_{k}").alias(f"h{a}_{k}") for k in FAULTS for a in "sq"])
    # One row: global rates, and the weight of the prior by the spread of host rates beyond that of documents.
    spread = []
    for k in FAULTS:
        spread += [F.sum(f"hs_{k}").alias(f"gs_{k}"), F.sum(f"hq_{k}").alias(f"gq_{k}"), F.sum(F.col(f"hs_{k}") * F.col(f"hs_{k}") / F.col("hn")).alias(f"gm_{k}")]
    whole = hosts.agg(F.sum("hn").alias("gn"), F.count("*").alias("gh"), F.sum(F.col("hn") * F.col("hn")).alias("gnn"), *spread)
    for k in FAULTS:
        rate = (F.col(f"gs_{k}") + 0.5) / (F.col("gn") + 1)
        within = F.greatest(F.lit(1e-6), (F.col(f"gq_{k}") - F.col(f"gm_{k}")) / F.greatest(F.lit(1), F.col("gn") - F.col("gh")))
        between = (F.col(f"gm_{k}") - F.col(f"gs_{k}") * F.col(f"gs_{k}") / F.col("gn") - (F.col("gh") - 1) * within) / F.greatest(F.lit(1.0), F.col("gn") - F.col("gnn") / F.col("gn"))
        whole = whole.withColumn(f"rate_{k}", rate).withColumn(f"prior_{k}", F.least(F.lit(10000.0), F.greatest(F.lit(10.0), within / F.greatest(between, F.lit(1e-9)))))
    whole = whole.select(*[f"{a}_{k}" for k in FAULTS for a in ("rate", "prior")])
    out = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]).join(F.broadcast(whole))
    for k in FAULTS:
        host = (F.col(f"hs_{k}") + F.col(f"prior_{k}") * F.col(f"rate_{k}")) / (F.col("hn") + F.col(f"prior_{k}"))
        path = (F.col(f"s_{k}") + F.col(f"prior_{k}") * host) / (F.col("n") + F.col(f"prior_{k}"))
        out = out.withColumn(f"shift_{k}", F.round(logit(path) - logit(F.col(f"rate_{k}")), 9))
    return out.select("host", "path", "n", *[f"shift_{k}" for k in FAULTS])


def _decided(docs: DataFrame, labels: DataFrame, carry: list[str], names: list[str], host: str, path: str, threshold: float, max_sites: int, max_labelled: int) -> DataFrame:
    """The columns `carry` of docs, and under three names the probabilities of the faults and whether the document is kept."""
    model = train(docs, labels, max_labelled, path)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in carry], F.lit(0.0).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(True).alias(names[2]))
    low, toxic, at_host, at_path = fresh(docs, "low", "toxic", "host", "path")
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    docs = docs.withColumns({at_host: site, at_path: F.concat_ws("/", site, F.coalesce(F.col(path).cast("string"), F.lit("")))})
    # The texts are scored once; sites and decisions both read what is stored here.
    rows = stored(scored(docs, model, [*carry, at_host, at_path], (low, toxic)))
    paths = stored(site_sums(rows.select(F.col(at_host).alias("host"), F.col(at_path).alias("path"), F.col(low).alias("low"), F.col(toxic).alias("toxic"))))
    shifts = site_shifts(paths).select(F.col("host").alias(at_host), F.col("path").alias(at_path), *[F.col(f"shift_{k}").alias(f"{x}_shift") for k, x in zip(FAULTS, (low, toxic), strict=True)])
    side = F.broadcast(shifts) if paths.count() <= max_sites else shifts
    rows = rows.join(side, [at_host, at_path], "left")
    p = [1 / (1 + F.exp(-(F.col(x) + F.coalesce(f"{x}_shift", F.lit(0.0))))) for x in (low, toxic)]
    return rows.select(*[F.col(f"`{c}`") for c in carry], p[0].alias(names[0]), p[1].alias(names[1]), ((p[0] <= threshold) & (p[1] <= threshold)).alias(names[2]))


def classified(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, max_sites: int = MAX_SITES, max_labelled: int = MAX_LABELLED,
    carry: list[str] | None = None, names: tuple[str, str, str] = ("p_low", "p_toxic", "keep"),
) -> DataFrame:
    """All documents (their columns `carry`, by default all) with three more under `names`: posterior probabilities of low
    quality and of toxicity, and whether the document is kept."""
    carry = docs.columns if carry is None else carry
    unclaimed(docs.select(*[F.col(f"`{c}`") for c in carry]), *names)
    return _decided(docs, labels, carry, list(names), host, path, threshold, max_sites, max_labelled)


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their columns."""
    names = fresh(docs, "p_low", "p_toxic", "keep")
    return classified(docs, labels, names=tuple(names), **options).filter(names[2]).select(*[F.col(f"`{c}`") for c in docs.columns])
