import random

from pyspark.sql import functions as F

from runscope.functions import literals as L
from runscope.functions import redaction as R


def test_every_place_of_every_literal_is_found(spark):
    r = random.Random(3)
    alphabet = "abcé😀 "
    words = {"".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 7, 8, 9, 20]))) for _ in range(300)} | {"abcabcabcabc", "abcabcab"}
    texts = [(k, ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(2)] + [None, ""]) for k in range(60)]
    texts += [(100, ["abcabcabcabcabc", "x" + sorted(words)[5] * 3]), (101, None), (102, ["abcabcabcab" * 40_000])]
    rows = spark.createDataFrame(texts, "id long, texts array<string>")
    known = spark.createDataFrame([(w, len(w)) for w in words] + [("", 0), (None, 0)], "literal string, tag int")
    few = sorted(w for w in words if len(w) > 6)
    got = sorted((x["key"], x["part"], x["begin"], x["literal"], x["before"], x["after"]) for x in L.find(rows.where("id < 102"), "id", F.col("texts"), known).collect())
    want = []
    for k, parts in texts[:-1]:
        for p, t in enumerate(parts or []):
            for w in words:
                want += [(k, p, b, w, t[b - 1 : b] if b else "", t[b + len(w) : b + len(w) + 1]) for b in range(len(t or "")) if t.startswith(w, b)]
    assert got == sorted(want) and len(got) > 1000
    long = L.find(rows.where("id = 102"), "id", F.col("texts"), known.where(F.col("literal").isin(few)))
    assert long.where("literal = 'abcabcab'").count() == 2 * 40_000  # places may overlap


def test_all_text_columns_are_searched_in_one_scan(spark):
    kind = "id long, a string, s struct<x:string,y:array<struct<z:string,n:int>>>, m map<string,array<string>>, n int"
    rows = spark.createDataFrame([(1, "plain secret-0001", None, None, 1), (2, None, ("secret-0002", [("x secret-0003 y", 1), None, (None, 2)]), {"secret-0004": ["q", None, "secret-0005"]}, 2), (3, "", ("", []), {}, 3)], kind)
    seeds = spark.range(1, 200_000).select(F.format_string("secret-%04d", F.col("id")).alias("secret"))  # no cap
    got = sorted((r["id"], r["secret"]) for r in R.leak_scan(rows, None, seeds).collect())
    assert got == [(1, "secret-0001"), (2, "secret-0002"), (2, "secret-0003"), (2, "secret-0004"), (2, "secret-0005")]
    assert [(r["id"], r["secret"]) for r in R.leak_scan(rows, "a", seeds).collect()] == [(1, "secret-0001")]
    assert R.leak_scan(rows, "a", seeds.limit(3)).columns == [*rows.columns, "secret"]
    assert R.leak_scan(rows.limit(0), None, seeds.limit(100)).count() == 0 and R.leak_scan(rows, None, seeds.limit(0)).count() == 0


def test_configured_prefixes_and_names_are_replaced_leftmost_longest(spark):
    rows = spark.createDataFrame([(1, "/home/ann/x and /home/ann by ann, annual (ann) ann_b"), (2, None), (3, "bob"), (4, "nothing")], "id long, text string")
    prefixes = spark.createDataFrame([("/home",), ("/home/ann",)], "prefix string")
    names = spark.createDataFrame([("ann",), ("bob",), ("",)], "name string")
    got = {r["id"]: r["text"] for r in R.redact_configured(rows, "text", prefixes, names).collect()}
    assert got == {1: "[REDACTED:path_prefix]/x and [REDACTED:path_prefix] by [REDACTED:username], annual ([REDACTED:username]) ann_b", 2: None, 3: "[REDACTED:username]", 4: "nothing"}
