import random
import resource
import time

import numpy as np

from runscope.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id long, begin string"


def compared(text):
    """The compared characters, by the definition: letters and digits in lower case, runs of others as a space, none in front."""
    out = []
    for c in text or "":
        if c.isalnum():
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def edits_of_windows(windows, text):
    """Fewest edits of each window (all of one length) anywhere in the text, by the full table."""
    text = np.array([ord(c) for c in text], np.int64)
    windows = np.array([[ord(c) for c in w] for w in windows], np.int64)
    steps = np.arange(len(text) + 1)
    row = np.zeros((len(windows), len(text) + 1), np.int64)
    for i in range(windows.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (windows[:, i : i + 1] != text), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


def brute(item, text):
    """The fewest edits of a window of the item in the text, None where all are over their budget; every window is tried."""
    p, t = compared(item).strip(), compared(text)
    if not p:
        return None
    if len(p) < 12:
        return 0 if f" {p} " in f" {t.strip()} " else None
    m = min(50, len(p))
    k = 2 if m == 50 else 1 if m >= 25 else 0
    least = int(edits_of_windows([p[i : i + m] for i in range(len(p) - m + 1)], t).min())
    return least if least <= k else None


def invented(r, n):
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        t[k] = r.choice(["", "q", t[k] + "z"])
    return "".join(t)


def cases():
    r = random.Random(7)
    items = [(k, invented(r, n)) for k, n in enumerate([12, 20, 30, 45, 60, 4])] + [(70, "Ab cd"), (71, "one 2 three four"), (72, "just over the short ones"), (90, ""), (92, None), (93, "?!")]
    docs = [(0, None), (1, ""), (2, "ab"), (3, "xab cd"), (4, "so ab, CD it is"), (5, "ab cd"), (6, "one 2 three four five"), (7, "one 2 three fours")]
    for k in range(50):
        item = r.choice(items[:6])[1]
        a = r.randrange(0, max(1, len(item) - 160))
        piece = edited(r, item[a : a + r.choice([45, 60, 100, 170, 1000])], r.choice([0, 0, 2, 3, 4, 6, 9]))
        docs.append((10 + k, invented(r, r.randint(0, 12)) + r.choice([" ", "", ". "]) + r.choice([piece, piece.upper(), piece.replace(" ", ",\n")]) + " " + invented(r, r.randint(0, 12))))
    docs += [(500, "x " * 60_000 + items[2][1] + " y" * 10), (501, items[0][1]), (501, items[0][1])]
    return items, docs


def test_matches_are_those_of_brute_force_over_all_windows(spark):
    items, docs = cases()
    got = d.matches(spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for i, t in docs:
        hits = [(item, brute(p, (t or "")[-3000:])) for item, p in items]  # the planted part of the one long text
        want += [(i, item, k) for item, k in hits if k is not None]
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == sorted(want)
    assert len(want) >= 40 and {k for _, _, k in want} == {0, 1, 2} and {70, 71} <= {i for _, i, _ in want}
    whole = dict(docs)
    for r in got:
        assert 0 <= r["begin"] < r["end"] <= len(whole[r["doc_id"]])
        if r["edits"] == 0:  # the span begins and ends with an unedited window
            span, item = compared(whole[r["doc_id"]][r["begin"] : r["end"]]), compared(dict(items)[r["item_id"]])
            assert span[:50] in item and span.strip()[-50:] in item
        if r["doc_id"] == 500:
            assert whole[500][r["begin"] : r["end"]].strip() == items[2][1]
    stay = d.without_leaks(spark.createDataFrame([(i, t, 5, "clash") for i, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert stay.columns == ["doc_id", "text", "item_id", "begin"]
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(i for i, _ in docs if i not in {w[0] for w in want})


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a text", 0, "")], SCHEMA)
    assert d.matches(none, items).count() == d.matches(some, items).count() == 0
    assert d.without_leaks(some, items).count() == 1


def test_benchmark_in_blocks_gives_the_same_rows_in_one_pass(spark, monkeypatch):
    items, docs = cases()
    items += [(0, items[1][1]), (0, items[1][1])]  # rows of one item
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    one, clean = rows(d.matches(table, bench)), rows(d.without_leaks(table, bench))
    assert len(d.Blocks(bench).held) == 1 and one and len(clean) < len(docs)
    monkeypatch.setattr(d, "BLOCK_CHARS", 60)
    assert len(d.Blocks(bench).held) > 4
    several = d.matches(table, bench)
    assert rows(several) == one and rows(d.without_leaks(table, bench)) == clean
    for plan in (several, d.without_leaks(table, bench)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("MapInArrow") == 1 and text.count("Scan") == 1  # one worker and one scan for all blocks
    c = d.gram_codes(d.normalized("Ab, c" * 20)[0])
    assert np.array_equal(c, d.gram_codes(d.normalized("aB  c" * 20)[0]))


def test_every_window_of_a_hundred_characters_with_five_edits_is_found():
    r = random.Random(11)
    item = invented(r, 80)[:330]
    c = compared(item)
    index = d.Index([(1, item)])
    texts = []
    for a in range(len(c) - 100 + 1):
        piece = list(c[a : a + 100])
        for k in r.sample(range(100), 5):
            piece[k] = r.choice(["", "ß", piece[k] + "ß"])
        texts.append(f"{invented(r, 5)} zz{''.join(piece)}zz {invented(r, 5)}")
    assert [h[0] for h in d.search(index, texts)] == list(range(len(texts)))
    fragments = [c[a : a + d.SURE] for a in range(len(c) - d.SURE + 1)]
    hits = d.search(index, [f"{invented(r, 5)}zz{f}zz{invented(r, 5)}" for f in fragments])
    assert [(h[0], h[4]) for h in hits] == [(k, 0) for k in range(len(fragments))]


def test_a_phrase_that_many_items_share_stays_cheap():
    r = random.Random(3)
    phrase = "choose the best answer to the question below "
    items = [(k, phrase + invented(r, 12)) for k in range(20_000)]
    index = d.Index(items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    began = time.time()
    hits = d.search(index, [" ".join(phrase + f"{invented(r, 2)} filler {k}" for k in range(20)) + items[77][1]])
    assert 77 in {h[1] for h in hits}
    assert time.time() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000
    one = d.search(d.Index(items[:200]), [phrase * 3 + items[5][1], phrase])
    assert {h[1] for h in one if h[0] == 0} == {k for k, t in items[:200] if brute(t, phrase * 3 + items[5][1]) is not None}
