"""Secret scan with multipart credential linking (DataFrame functions only).

Parts of credentials are found by pattern in every whole text. Strong parts are reported as they are:

- assign: a named value of 12 or more characters (plays secret);
- access: an access key identifier of 18 or more characters (plays identifier);
- hex: a run of 16 or more hexadecimal digits (plays secret).

Weak parts are found in many harmless texts and are reported only when the parts that complete them lie
in scope, that is start or end within `scope` code points:

- weak_id: a named user, account or client (identifier), reported beside a secret;
- weak_secret: a named value of 4 to 11 characters, or a token of 20 or more characters that mixes digits
  and both cases (secret), reported beside an identifier;
- endpoint: a URL or a named host, reported beside an identifier and a secret.

The interval join sorts the parts of a text by position and carries the nearest end before and nearest
start after for each role along (two running windows), so its work is linear in the parts and no pairs
are made. A weak part that overlaps a strong one is not reported.

Edge cases: null text is empty; a null doc_id is kept; repeated rows are separate documents; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the kinds in order, their patterns, and the least length of the whole match.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_secret", "endpoint", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ASSIGN,
    r"AKIA[A-Z0-9]{14,}",
    r"[0-9a-f]{16,}",
    r"""(?i)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,64}""",
    ASSIGN,
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+",
    r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""",
    r"""(?i)\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{4,}""",
)
ROLES = ("secret", "id", "secret", "id", "secret", "secret", "endpoint", "endpoint")
STRONG = 3


def keeps(kind: int, match: Column) -> Column:
    """Whether a match counts."""
    if PATTERNS[kind] != ASSIGN:
        return F.lit(True)
    value = F.length(F.regexp_extract(match, ASSIGN, 2))
    return value >= 12 if kind < STRONG else (value >= 4) & (value < 12)


def placed(kind: int):
    """Of a match and the text between it and the match before."""
    return lambda x, gap: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(x).alias("size"), keeps(kind, x).alias("ok"))


def scan(docs: DataFrame, scope: int = 160) -> DataFrame:
    """One row a document: doc_id and spans, an array of (start, kind number, name, end), sorted, in code points."""
    text = F.col("text")
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    distinct = {p: f"m{i}" for i, p in reversed(list(enumerate(PATTERNS)))}
    found = found.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(m) for p, m in distinct.items()])
    parts = []
    for kind, pattern in enumerate(PATTERNS):
        m = F.col(distinct[pattern])
        # The text between two matches gives the positions, in code points.
        parts.append(F.when(F.size(m) > 0, F.filter(F.zip_with(m, F.split(text, pattern, -1), placed(kind)), lambda s: s["size"].isNotNull())))
    own = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("ok")))
    rows = found.select("rid", "doc_id", F.posexplode(F.concat(own, *[F.coalesce(p, F.filter(own, lambda s: F.lit(False))) for p in parts])).alias("pos", "part"))
    rows = rows.select("rid", "doc_id", "pos", "part.*")
    before = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.filter(F.col("ok") | (F.col("kind") < 0)).drop("pos", "gap", "size", "ok")

    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("kind") + 1)
    rows = rows.withColumn("role", F.when(F.col("kind") >= 0, role)).withColumn("strong", F.col("kind").between(0, STRONG - 1))
    ahead = Window.partitionBy("rid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for name, such in (("id", F.col("role") == "id"), ("secret", F.col("role") == "secret"), ("strong", F.col("strong"))):
        rows = rows.withColumn(f"{name}_end", F.max(F.when(such, F.col("end"))).over(ahead)).withColumn(f"{name}_start", F.min(F.when(such, F.col("start"))).over(after))
        near[name] = F.coalesce(F.col("start") - F.col(f"{name}_end") <= scope, F.lit(False)) | F.coalesce(F.col(f"{name}_start") - F.col("end") <= scope, F.lit(False))
    overlaps = F.coalesce(F.col("strong_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_start") < F.col("end"), F.lit(False))
    completed = F.when(F.col("role") == "id", near["secret"]).when(F.col("role") == "secret", near["id"]).otherwise(near["id"] & near["secret"])
    rows = rows.filter((F.col("kind") < 0) | F.col("strong") | (completed & ~overlaps))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.when(F.col("kind") >= 0, name).alias("name"), "end")
    spans = F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, span)))
    return rows.groupBy("rid").agg(F.min("doc_id").alias("doc_id"), spans.alias("spans")).drop("rid")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
