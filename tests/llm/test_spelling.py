import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from runscope.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 5}


def brute(rows):
    words = brute_words(rows)
    forms, out = {}, []
    for w, n in words.items():
        others = [o for o in words if o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out.append((w, n, len(others)))
    done = []
    for w, n, k in out:
        root = w
        while forms[root]:
            root = forms[root]
        done.append((w, forms[w], root, n, k, words[forms[w]] if forms[w] else None))
    return sorted(done)


def found(df, **more):
    return sorted((tuple(r) for r in spelling.variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def mutated(r, w):
    k = r.randrange(len(w))
    return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcdeéÿÀ") + w[k:], w[:k] + r.choice("abcdeéÿÀ") + w[k + 1 :]])


@pytest.mark.parametrize("cell_words", [40, 8192])
def test_equal_to_brute_force(spark, monkeypatch, cell_words):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 4)
    r = random.Random(2)
    words = ["".join(r.choice("abcdé") for _ in range(r.choice([6, 6, 6, 7, 8]))) for _ in range(150)] + ["Straße", "naïvelyÉ", "a" * 130]
    for _ in range(3):
        words += [mutated(r, w) for w in r.sample(words, 80)]
    words += ["abcdea", "bacdea", "aabcde"]  # anagrams are no variants
    rows = []
    for w in words:
        for _ in range(r.choice([2, 5, 6, 30, 200])):
            rows.append((r.randrange(60), w if r.random() < 0.8 else w.upper()))
    texts = [(i, " ".join(w for j, w in rows if j == i)) for i in range(60)]
    texts += [(70, None), (71, ""), (72, "12 _- é"), (None, "abcdef " * 30), (3, texts[3][1]), (4, "x" * 200_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], SCHEMA).repartition(5)
    got, want = found(df, cell_words=cell_words), brute(texts)
    assert got == want
    assert any(w[2] != (w[1] or w[0]) for w in want) and any(w[4] > 2 for w in want)


def test_deleted_code_points_and_empty_tables(spark):
    texts = [(i, "thirteen éèàâôû") for i in range(3000)]  # many of these hash to a multiple of 199
    df = spark.createDataFrame([(i, t, "", 0) for i, t in texts], SCHEMA)
    assert {r["word"]: r["n"] for r in spelling.runs(df).groupBy("word").count().withColumnRenamed("count", "n").where("n >= 5").collect()} == brute_words(texts)
    assert found(df.limit(0)) == []


def test_trees_reach_and_place_every_word_and_prune():
    r = np.random.default_rng(0)
    letters = (97 + np.minimum(r.geometric(0.15, size=(3000, 9)), 25)).astype(np.uint8)
    x = spelling.counts(letters)
    for tight in (True, False):
        tree = spelling.Tree(x, 30, tight=tight)
        placed = tree.place(x)
        assert all(set(own.tolist()) == set(np.flatnonzero(placed == k).tolist()) for k, own in enumerate(tree.leaves))
        reached = set()
        for leaf, rows in tree.reach(x[:300], 1, 1):
            reached |= {(leaf, int(q)) for q in rows}
        up = np.maximum(x[None, :] - x[:300, None].astype(np.int32), 0).sum(axis=2)
        down = np.maximum(x[:300, None].astype(np.int32) - x[None, :], 0).sum(axis=2)
        q, d = np.nonzero((up <= 1) & (down <= 1))
        assert {(int(placed[j]), int(i)) for i, j in zip(q, d, strict=True)} <= reached
        if tight:
            assert len(reached) < 0.4 * 300 * len(tree.leaves)


def test_one_edit_on_rows_of_code_points():
    pairs = [("abcdef", "abcdef"), ("abcdef", "abcdeg"), ("abcdef", "xbcdeg"), ("abcdef", "xabcdef"), ("abcdef", "abcdefx"), ("abcdef", "abcxdef"), ("abcdef", "abxdcef"), ("aaaaaa", "aaaaaaa"), ("ababab", "bababab"), ("ababab", "baxbabb")]
    for a, b in pairs:
        assert spelling.one_edit(spelling.codes([a]), spelling.codes([b])).tolist() == [near(a, b)]
