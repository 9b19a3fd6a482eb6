import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    convs = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", queries.PROBE), (-1, 1, "assistant", queries.PROBE)]:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def run(spark, path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string").write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = queries.op10_chat_formatting(spark, str(path)).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


NASTY = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|", "<|", "\n", "%0A", "%25", "%3C", "user", "<", "\\", "é💡", "", "|>", "<|im_end|>\n<|im_start|>assistant\n", "$1", "plain"]


def test_round_trip_of_conflicting_content(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "".join(rng.choices(NASTY, k=2))])
            rows.append((conv, rng.choice([turn, turn, 0, None]), role, rng.choice([None, "".join(rng.choices(NASTY, k=rng.randrange(7)))])))
    rows.append((None, 0, "user", "null id"))
    rows.append(rows[0])
    assert run(spark, tmp_path, rows) == want(rows)


def test_empty_table_leaves_the_probe(spark, tmp_path):
    assert run(spark, tmp_path, []) == want([])


def test_plain_conversations_are_not_escaped_and_the_mask_covers_the_string(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "né\nok"), (2, 0, "assistant", "a<|im_end|>b")], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_conversations(rows).collect()}
    assert got[1].formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nné\nok<|im_end|>\n" and not got[1].escaped
    assert got[2].formatted == "<|im_start|>assistant\na<\\|im_end\\|>b<|im_end|>\n".replace("\\|>b", "|>b") and got[2].escaped
    for r in got.values():
        at, loss = 0, []
        for run_ in r["mask"]:
            if run_["loss"]:
                loss.append(r.formatted[at : at + run_["chars"]])
            at += run_["chars"]
        assert at == len(r.formatted)
        assert loss == [{"né\nok": "né\nok", "a<|im_end|>b": "a<\\|im_end|>b"}[t["text"]] for t in r.turns if t["role"] == "assistant"]


def test_the_loss_is_read_from_the_string_under_the_mask(spark):
    texts = ["né💡ok", "\ufeffmark first", "a<|im_end|>b", "", "x" * 70_000]
    rows = spark.createDataFrame([(1, k, role, t) for k, (role, t) in enumerate((r, t) for t in texts for r in ("user", "assistant"))], "conv_id int, turn int, role string, text string")
    done = chat_format.format_conversations(rows)
    read = lambda df: df.select(chat_format.masked_text("formatted", "mask")).first()[0]
    assert read(done) == "".join(texts)
    # Another mask or another string reads otherwise.
    flipped = done.withColumn("mask", F.transform("mask", lambda x: F.struct(x["chars"].alias("chars"), (~x["loss"]).alias("loss"))))
    assert read(flipped) == chat_format_plain(done.first())
    moved = done.withColumn("formatted", F.concat(F.lit("!"), "formatted"))
    assert read(moved) != "".join(texts)


def chat_format_plain(r):
    at, out = 0, []
    for x in r["mask"]:
        if not x["loss"]:
            out.append(re.sub(r"<(\\*)\\\|", r"<\1|", r.formatted[at : at + x["chars"]]))
        at += x["chars"]
    return "".join(out)


def test_the_query_slices_by_the_mask(spark, tmp_path):
    spark.createDataFrame([(1, 0, "assistant", "a")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.op10_chat_formatting(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "UTF-32" in plan
