import hashlib

from pyspark.sql import functions as F

from corepick.llm import chat
from tests.llm.helpers import SF, run_sql, same_rows


def write(spark, folder, rows, schema="conv_id long, turn long, role string, text string, formatted string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_query_equals_sql(spark):
    same_rows(chat.op5_chat_parts(spark, SF).toPandas(), run_sql(chat.OP5_SQL))


def test_hard_rows_equal_sql_and_read_back(spark, tmp_path):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[\\INST]\\\\", None, "", "é\U0001f600<image>", "x" * 100000, "a\nb"]
    rows = [(i % 3 if i < 20 else None, None if i == 7 else i // 3, ["user", "assistant", "a[INST]", None][i % 4], nasty[i % len(nasty)], "clash") for i in range(27)]
    rows += [(9, t, "assistant", f"t{t}", None) for t in range(-3, 700)] + [(9, 5, "assistant", "tie", None)] * 2
    folder = write(spark, tmp_path, rows)
    got = chat.op5_chat_parts(spark, folder).toPandas()
    same_rows(got, run_sql(chat.OP5_SQL, folder))
    own = got[got.conv_id == -1].iloc[0]
    text = "</s>[INST] ok [/INST]"
    assert own.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert own.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and own.loss_chars == len(text)


def test_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path, [])
    assert [r.conv_id for r in chat.op5_chat_parts(spark, folder).collect()] == [-1]


def test_parts_are_flattened_in_order(spark):
    rows = [(1, 0, "user", [("text", "see <image> ", None, None), ("image", None, "a.png", None), ("audio", "", "b.wav", 9), (None, " end", None, None), ("video", None, "c", 5)]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.read_back(chat.format_chat(df)).first()
    assert r.formatted == "<s>[INST] user [/INST]see <\\image> <image><audio> end<document></s><s>[INST] assistant [/INST]</s>"
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 576), ("audio", "b.wav", 9), ("document", "c", 5)]
    assert r.attachment_tokens == 590 and r.n_turns == 2


def test_plan_is_native(spark):
    plan = chat.op5_chat_parts(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
