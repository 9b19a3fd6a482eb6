import random
import re
import string

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import license_scan, queries


def shingles_of(text):
    own = [w for w in re.split("[" + re.escape(string.whitespace + string.punctuation) + "]+", (text or "").lower()) if w]
    return [" ".join(own[k : k + 5]) for k in range(len(own) - 4)]


def brute(texts):
    """(doc_id, license) where a stretch of a text contains 80 % of a template's shingles: stretches of twice the least power of two
    (16 at least) that holds the template, one every such power."""
    sets = [(name, set(shingles_of(t))) for name, t in license_scan.TEMPLATES]
    out = set()
    for i, text in texts:
        own = shingles_of(text)
        for name, wanted in sets:
            m = 16
            while m < len(wanted):
                m *= 2
            if any(5 * len(wanted & set(own[at : at + 2 * m])) >= 4 * len(wanted) for at in range(0, len(own), m)):
                out.add((i, name))
    return sorted(out, key=str)


def tables(rng):
    words = ["the", "license", "software", "of", "and", "permission", "licensed", "under"] + [f"w{i}" for i in range(80)]
    rows = [(0, None), (1, ""), (2, "Released under the MIT License."), (3, "released UNDER the\nMIT license"), (4, "Released under the"), (None, license_scan.TEMPLATES[0][1]), (2, "Released under the MIT License.")]
    for i in range(5, 150):
        body = rng.choices(words, k=rng.randrange(200))
        for _ in range(rng.randrange(3)):
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.choice((0, 0, 0, 1, 1, 3))):
                t[rng.randrange(len(t))] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = t
        rows.append((i, " ".join(body)))
    return rows


def test_matches_brute_force(spark, tmp_path):
    rows = tables(random.Random(3))
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, license string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_license_scans(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert len(want) > 80
    assert sorted({(r.doc_id, r.license) for r in got}, key=str) == want
    assert sum(r.doc_id == 2 for r in got) == 2


def test_any_place_of_a_template_is_found(spark):
    t = license_scan.TEMPLATES[5][1]
    rows = [(k, " ".join([f"a{i}" for i in range(k)] + t.split() + [f"b{i}" for i in range(300 - k)])) for k in range(0, 300, 7)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in rows] and all(r.matched == r.shingles for r in got)


def test_signatures_are_the_least_of_each_bin(spark):
    rng = random.Random(4)
    h = [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    (got,) = spark.createDataFrame([(h,)], "h array<bigint>").select(license_scan.signature(F.col("h"), 32).alias("s")).first()
    want = {}
    for x in h:
        u = x & (1 << 64) - 1
        want[u & 63] = min(want.get(u & 63, 1 << 64), u >> 7)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert sorted(got) == sorted(signed((b << 57 | v) & (1 << 64) - 1) for b, v in want.items())


def test_a_template_of_half_its_group_with_faults_is_found(spark):
    rng = random.Random(6)
    template = " ".join(f"t{i}" for i in range(40))
    docs = []
    for k in range(300):
        t = template.split()
        t[rng.randrange(40)] = "other"
        body = [f"x{rng.randrange(10**6)}" for _ in range(200)]
        at = rng.randrange(200)
        docs.append((k, " ".join(body[:at] + t + body[at:])))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id int, text string"), (("T", template),)).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 7919}" for i in range(300_000))
    got = license_scan.scan(spark.createDataFrame([(1, long + " " + license_scan.TEMPLATES[5][1] + " " + long)], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT")]


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([], "doc_id int, text string"), (("x", "too short"),))


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []
