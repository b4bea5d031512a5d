import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"
WORDS = {"en": ["the", "thing", "other", "with", "heron", "and", "within", "shore"], "de": ["und", "schön", "nicht", "über", "schaft", "machen", "ein", "straße"]}


def texts():
    r = random.Random(2)
    made = [(" ".join(r.choice(WORDS[x]) + r.choice(["", "er", "in"]) for _ in range(r.randint(60, 90))), x) for x in r.choices(list(WORDS), k=60)]
    leak = " ".join(r.choice(WORDS["en"]) + r.choice(["ou", "st", "ly"]) for _ in range(40))
    rows = [(k, t, x) for k, (t, x) in enumerate(made)]
    rows += [(100, made[0][0], "en"), (101, made[1][0] + " the", "en"), (102, None, "en"), (103, "", None), (104, "12 34 !!", "de"), (105, "漢字 漢字", None)]
    rows += [(106, made[2][0] + "\n" + leak, "en"), (107, "mail ada.l@corp.example.org or +1 (212) 555-0147 " + made[3][0][:200], "en"), (0, made[0][0], "en"), (None, made[4][0] + " lonely tail of words here", "de")]
    return rows, leak


def test_each_stage_decides_and_nothing_clean_is_lost(spark, tmp_path):
    rows, leak = texts()
    spark.createDataFrame([(i, t, x, "s", len(t or ""), 1.0, "clash") for i, t, x in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if r[0] not in (102, 103, 104, 105)]
    roots = plain_components({plain_fingerprint(t) for _, t, _ in kept})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups = {}
    for i, t, _ in kept:
        groups.setdefault(roots[plain_fingerprint(t)], []).append(i)
    want = Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    want.pop(106)
    assert Counter(r["doc_id"] for r in out) == want
    source = {i: t for i, t, _ in kept}
    for r in out:
        if r["doc_id"] == 107:
            assert "ada.l" not in r["text"] and "555-0147" not in r["text"] and "@" in r["text"]
        elif r["doc_id"] is not None:
            assert r["text"] == source[r["doc_id"]]
        assert r["round_trip"] and r["n_tokens"] == len(r["piece_ids"]) and r["n_chars"] == len(r["text"])
        assert r["lang"] in WORDS and r["score"] == 1.0 and r["fp"] == "clash"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns


def test_language_without_labels_keeps_what_has_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "漢字", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 4]


CLASHES = ("lang_pred", "score", "ranked", "fp", "sid", "root", "row", "pii_kinds", "piece_ids", "decoded", "n_tokens", "round_trip", "kind", "value")


def test_columns_of_any_name_survive(spark, tmp_path):
    rows, leak = texts()
    columns = ", ".join(f"{c} string" for c in CLASHES)
    made = [(i, t, x, "s", len(t or ""), *[f"{c} of {k}" for c in CLASHES]) for k, (i, t, x) in enumerate(rows)]
    spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {columns}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert len(set(out.columns)) == len(out.columns) and out.columns[-3:] == list(corpus_pipeline.ENCODED)
    by_id = {}
    for r in made:
        by_id.setdefault(r[0], []).append(r[5:])
    kept = out.collect()
    assert len(kept) > 50
    for r in kept:
        assert tuple(r[f"source_{c}" if c in corpus_pipeline.ENCODED else c] for c in CLASHES) in by_id[r["doc_id"]]
        assert r["n_tokens"] == len(r["piece_ids"]) and r["round_trip"]


def test_what_stages_wrote_for_themselves_is_removed(spark, tmp_path):
    from runscope.session import _written

    rows, leak = texts()
    spark.createDataFrame([(i, t, x, "s", len(t or ""), 1.0, "") for i, t, x in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(_written(spark))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in _written(spark) if p not in before] == [n.replace(" ", "_") for n, _ in corpus_pipeline.STAGES[:-1]]
    assert out.count() > 50


ENGLISH = "the people of the town went down to the river in the morning and there they found that an old boat had been left on the shore with all of its nets and most of the fish that the men had caught that night while others were still asleep in their houses under the hill".split()
GERMAN = "die leute aus der stadt gingen am morgen hinunter zum fluss und dort fanden sie dass ein altes boot am ufer lag mit allen netzen und den meisten fischen die die männer in der nacht gefangen hatten während andere noch in ihren häusern unter dem hügel schliefen".split()
POLISH = "ludzie z miasta poszli rano nad rzekę i znaleźli tam starą łódź którą ktoś zostawił na brzegu razem ze wszystkimi sieciami oraz rybami które mężczyźni złowili tej nocy podczas gdy inni jeszcze spali w swoich domach pod wzgórzem"


def test_texts_of_no_learned_language_are_rejected(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(w) for _ in range(n)), x) for k, (x, w, n) in enumerate([(x, w, n) for x, w in (("en", ENGLISH), ("de", GERMAN)) for n in (12, 60) for _ in range(60)])]
    mash = [(1000 + k, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(60)), None) for k in range(10)]
    docs = spark.createDataFrame([*rows, *mash, (2000, POLISH, None), (2001, "the river in the town", None)], "doc_id long, text string, lang string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.language(spark, docs, "").collect()) == [*range(len(rows)), 2001]
