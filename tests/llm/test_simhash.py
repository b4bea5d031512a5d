import random

import numpy as np
from xxhash import xxh64_intdigest

from runscope.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def clusters(n, seed=3):
    r = random.Random(seed)
    found = set()
    while len(found) < n:
        at = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 30])):
            found.add(at)
            for _ in range(r.randint(1, 4)):
                at ^= 1 << r.randrange(64)
    return sorted(found)


def test_fingerprint_matches_definition():
    for t in [None, "", " \n", "One", "one TWO", "a b c", "É x\x0by z w q", "a b " * 500]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_index_finds_the_classes_of_brute_force():
    fps = clusters(700)
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    label = index.classes()
    want = plain_components(fps)
    own = [int(f) for f in index.fps]
    groups = {}
    for f, k in zip(own, label, strict=True):
        groups.setdefault(k, set()).add(f)
    expected = {}
    for f in fps:
        expected.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_forest_and_components_with_cut_shards(spark):
    fps = clusters(600, 5) + [f ^ 5 for f in range(1 << 20, (1 << 20) + 300)]
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(set(fps))]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for rows in (10_000, 20):
        got = {r["node"]: r["root"] for r in simhash.components(simhash.link_forest(df, rows)).collect()}
        want = plain_components([f % (1 << 64) for f in signed])
        classes = {}
        for f in signed:
            classes.setdefault(want[f % (1 << 64)], set()).add(f)
        for members in classes.values():
            assert {got.get(f, f) for f in members} == {min(members)} or len(members) == 1


def test_groups_on_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "  "), (6, base + " x"), (7, "solo words here"), (None, "odd one"), (None, base), (8, "y " * 50_000)]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.groups(docs).collect()), key=str)
    want = plain_components({plain_fingerprint(t) for _, t in rows})
    smallest = {}
    for i, t in rows:
        c = want[plain_fingerprint(t)]
        smallest[c] = min(x for x in (smallest.get(c), i) if x is not None) if i is not None or c in smallest and smallest[c] is not None else smallest.get(c)
    assert got == sorted(((i, smallest[want[plain_fingerprint(t)]]) for i, t in rows), key=str)
    kept = sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([1, 3, 7, 8, None], key=str)
    assert simhash.keep_one(docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_row_of_each_group_stays_whatever_the_order(spark):
    r = random.Random(9)
    invented = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(120))
    w, x, z, lone = invented(), invented(), invented(), invented()
    y = invented()
    rows = [(2, z), (5, z), (5, w), (9, x), (9, y), (None, lone), (None, lone), (None, w), (2, z)]
    wanted = sorted([(2, z), (5, w), (9, x), (9, y), (None, lone)], key=str)
    for made in (simhash.keep_one, jaccard.keep_one):
        for seed in range(3):
            random.Random(seed).shuffle(rows)
            docs = spark.createDataFrame([(i, t, "clash", 0, {"k": "v"}) for i, t in rows], SCHEMA + ", m map<string,string>").repartition(3)
            assert sorted(((k["doc_id"], k["text"]) for k in made(docs).collect()), key=str) == wanted
