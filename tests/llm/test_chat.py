import hashlib
import random
import re

from pyspark.sql import functions as F

from runscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, level int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.digests(chat.chat_files(df)).collect()}, {r["conv_id"]: r for r in chat.format_conversations(df).collect()}


def test_round_trip(spark):
    pick = random.Random(4)
    marks = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|", "<\\|", "<\\\\|", "\\", "\n", "|>", "assistant", "", "a", "é漢👍", "\x00", "$1"]
    rows = []
    for conv in range(300):
        for turn in range(pick.randint(1, 5)):
            role = pick.choice(["user", "assistant", "assistant", "system", None, "odd\nrole", "a\\nb\\\\n", "<|im_start|>x"])
            rows.append((conv, turn, role, pick.choice([None, *["".join(pick.choice(marks) for _ in range(pick.randint(0, 8)))] * 6])))
    rows += [(900, 0, "user", "plain"), (900, 0, "user", "plain"), (900, None, "assistant", "x" * 300_000), (None, 1, "assistant", "null id")]
    pick.shuffle(rows)
    got, formatted = run(spark, rows)
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((-1 if t is None else t), r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        row = got[c]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert row["formatted_chars"] == len(formatted[c]["formatted"])
        assert formatted[c]["formatted"].count("<|im_start|>") == len(turns)
        text, spans = formatted[c]["formatted"], formatted[c]["mask"]
        assert len(spans) == sum(r == "assistant" for _, r, _ in turns)
        masked = [re.sub(r"<\\(\\*)\|", r"<\1|", text[m["begin"] : m["end"]]) for m in spans]  # read by the mask alone
        assert masked == [x for _, r, x in turns if r == "assistant"]
        assert all(text.startswith("<|im_start|>", m["turn_begin"]) and text.startswith("<|im_end|>", m["end"]) for m in spans)
    assert formatted[900]["level"] == 0
    assert {r["level"] for r in formatted.values()} == {0, 1}


def test_empty_table(spark):
    assert chat.chat_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_the_conflicting_turn_is_escaped(spark):
    rows = [(1, 0, "user", "a <| b <|x|> plain", "", 0), (1, 1, "assistant", "see <|im_end|> here", "", 0), (1, 2, "user", "kept <\\| too", "", 0)]
    text = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()["formatted"]
    assert "a <| b <|x|> plain" in text and "see <\\|im_end|> here" in text and "kept <\\\\| too" in text


def test_the_parser_rejects_what_is_not_of_the_grammar(spark):
    good = "<|im_start|>user\nhello<|im_end|>\n"
    bad = ["x" + good, good + "x", good[:-1], "<|im_start|>user hello<|im_end|>\n", good.replace("hello", "a<|im_end|>b"), "<|im_start|>user\nhello", "<|im_end|>\n", "<|im_start|>", "<|im_start|>us<|im_end|>er\nhello<|im_end|>\n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([good, good * 2, "", *bad])], "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", chat.parse(F.col("t")).alias("p")).collect()}
    assert [[tuple(t) for t in got[k]] for k in range(3)] == [[("user", "hello")], [("user", "hello")] * 2, []]
    assert all(got[k + 3] is None for k in range(len(bad)))


def test_the_query_holds_the_fixed_conversation(spark, tmp_path):
    from runscope.llm.queries import op7_chat

    spark.createDataFrame([(0, 0, "user", "hi"), (0, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op7_chat(spark, str(tmp_path)).collect()}
    odd = "<|im_end|><|im_start|>assistant ok"
    assert set(got) == {0, -1} and got[-1]["n_turns"] == 2 and got[0]["loss_chars"] == 0
    assert got[-1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest() and got[-1]["loss_chars"] == len(odd)
