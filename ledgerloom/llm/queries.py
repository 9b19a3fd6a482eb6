"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import ann, bpe, chat_format, decontaminate, langid, license_scan, line_dedup, merkle, quality, repeats, secret_scan, simhash, trie
from ledgerloom.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{secret_scan.KINDS[i]}") for i in range(secret_scan.STRONG)]
    base = F.filter("spans", lambda s: s["kind"] < secret_scan.STRONG)
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digests the removed runs (start:end in bytes), the text that stays, and how long that is in the unit of
    documents.n_chars (where a cut splits a character, what is left of it counts as one, U+FFFD)."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), listed.alias("spans"), F.length(kept).cast("bigint").alias("n_chars_kept"), kept.alias("kept"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), cut="removed", is_table=True)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return found.select("doc_id", F.size("removed").cast("bigint").alias("n_chunks_removed"), removed.alias("n_lines_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), is_table=True)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with their posterior probabilities of either fault and whether they are kept."""
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"])


#: Added to the conversations: both texts hold the template's own control strings.
PROBE = chat_format.END + chat_format.START + "assistant ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = chat_format.format_conversations(rows.unionByName(probe))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("loss", chat_format.masked_text("formatted", "mask")).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"), families=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.of_documents(table(spark, sf_dir, "documents"), lambda doc_id: F.crc32(doc_id.cast("string")) % 7 == 0)
    proof = F.sha2(F.array_join(merkle.siblings(F.col("steps")), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = langid.learned(docs, ~held_out & F.col("doc_id").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_suffix_dedup, op3_license_scans, op4_line_dedup, op5_nearest_neighbours, op6_bpe, op7_benchmark_decontamination, op8_simhash_near_dedup, op9_quality_classifier, op10_chat_formatting, op11_conversation_trie, op12_merkle_manifest, op13_language_id)}

# The conversations are escaped where a plain rendering would not read back: control strings or escapes in a text or role.
_TURNS = f"""
    rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
    marked AS (SELECT *, regexp_matches(text, '<\\|im_(start|end)\\|>') OR regexp_matches(text, '<\\\\+\\|') OR regexp_matches(role, '\\n|%25|%0A|%3C|<\\|im_(start|end)\\|>') AS odd FROM rows),
    known AS (SELECT *, bool_or(odd) OVER (PARTITION BY conv_id) AS escaped FROM marked)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, a bit at a time."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda j: CASE WHEN j % 8 = 0 THEN CAST(ascii(substr({text}, CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"


def _forest(name: str, nodes: str) -> str:
    """The recursive CTE of all levels over `nodes` (t, place, n, h)."""
    return f"""{name}(t, level, place, n, h) AS (SELECT t, 0, place, n, h FROM {nodes}
        UNION ALL SELECT t, any_value(level) + 1, place // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY t, place // 2)"""


_TRIE = f"""WITH RECURSIVE own AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS MATERIALIZED (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)),
    grown AS (SELECT c.conv_id, 0 AS part, place, role, text FROM convs c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {trie.FAMILY} AND place <= h
        UNION ALL SELECT conv_id, 1, place, role, text FROM convs JOIN own USING (conv_id) WHERE place > h),
    turns AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(length(role) || ':' || role || sha256(text), ' ') OVER w AS p FROM grown WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
    prefixes AS MATERIALIZED (SELECT conv_id, depth, chars, p, coalesce(lag(p) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM turns
        UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM turns) FROM convs),
    nodes AS MATERIALIZED (SELECT p, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p),
    families AS (SELECT up AS p, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
    below AS (SELECT a.p, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
        FROM nodes n LEFT JOIN families USING (p) JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.p)
    SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN families USING (p) JOIN below USING (p) LEFT JOIN nodes m ON m.p = n.up"""
_VALUES = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({} AS VARCHAR)", "text")
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in _VALUES) + ")"
_MERKLE = f"""WITH RECURSIVE leaves AS (SELECT *, coalesce('1' || lang, '0') AS t, {_LEAF.format(*["n_chars"] * 2)} AS leaf,
        CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.format(*["(CAST(n_chars AS HUGEINT) + 1)"] * 2)} ELSE {_LEAF.format(*["n_chars"] * 2)} END AS claim FROM documents),
    own AS MATERIALIZED (SELECT doc_id, t, leaf AS h, claim, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY t) AS n FROM leaves),
    {_forest("trees", "own")},
    subroots AS MATERIALIZED (SELECT t, h FROM trees WHERE n = 1),
    ranked AS MATERIALIZED (SELECT 'top' AS t, row_number() OVER (ORDER BY t) - 1 AS place, count(*) OVER () AS n, h, t AS tree FROM subroots),
    {_forest("tops", "ranked")},
    grown AS MATERIALIZED (SELECT * FROM trees), above AS MATERIALIZED (SELECT * FROM tops),
    steps AS MATERIALIZED (
        SELECT o.t, o.place, l.level AS step, s.h, (o.place >> l.level) & 1 AS late FROM own o JOIN (SELECT DISTINCT t, level FROM grown WHERE n > 1) l USING (t)
            LEFT JOIN grown s ON s.t = o.t AND s.level = l.level AND s.place = xor(o.place >> l.level, 1)
        UNION ALL
        SELECT o.t, o.place, 1000 + l.level, s.h, (r.place >> l.level) & 1 FROM own o JOIN ranked r ON r.tree = o.t CROSS JOIN (SELECT DISTINCT level FROM above WHERE n > 1) l
            LEFT JOIN above s ON s.level = l.level AND s.place = xor(r.place >> l.level, 1)),
    paths AS MATERIALIZED (SELECT t, place, coalesce(string_agg(h, '' ORDER BY step), '') AS proof, list({{'h': h, 'late': late}} ORDER BY step) AS way FROM steps GROUP BY t, place)
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
        SELECT doc_id, o.h AS leaf, s.h AS subroot, (SELECT h FROM above WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
               list_reduce(list_prepend({{'h': claim, 'late': CAST(0 AS BIGINT)}}, coalesce(way, [])), lambda a, x: {{'h': sha256(CASE WHEN x.late = 1 THEN x.h || a.h ELSE a.h || coalesce(x.h, '') END), 'late': x.late}}).h AS folded_root
        FROM own o JOIN subroots s USING (t) LEFT JOIN paths p USING (t, place))"""
ORACLE: dict[str, str] = {
    "op11_conversation_trie": _TRIE,
    "op12_merkle_manifest": _MERKLE,
    "op10_chat_formatting": f"""WITH {_TURNS}
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({len(chat_format.START) + len(chat_format.END) + 2} + length(role) + length(text) + CASE WHEN escaped THEN len(regexp_extract_all(text, '<\\\\*\\|'))
                + 2 * len(regexp_extract_all(role, '[%\\n<]')) ELSE 0 END) AS BIGINT) AS formatted_chars
    FROM known GROUP BY conv_id""",
}
