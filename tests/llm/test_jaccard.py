import random

from runscope.llm import jaccard
from tests.llm.test_simhash import plain_fingerprint

SCHEMA = "doc_id long, text string, root string, sid int"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


def test_groups_are_those_of_brute_force(spark):
    r = random.Random(4)
    texts = []
    for _ in range(40):
        text = " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(30, 300)))
        texts.append(text)
        for _ in range(r.choice([0, 1, 1, 3])):
            text = near(r, text, r.randint(0, 8))  # chains too
            texts.append(text)
    hub = " ".join(f"h{k}" for k in range(200))
    texts += [near(r, hub, 2) for _ in range(60)] + [hub + " tail"] + [f"{hub} {' '.join(f'u{i}-{k}' for k in range(60))}" for i in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  B"), (3, texts[3]), (None, texts[5]), (None, "lone words"), (None, "lone words")]
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    groups = {}
    for (i, _), k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append(i)
    want = sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((x["doc_id"] for x in out.collect()), key=str) == want
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if 0.8 <= likeness(sets[a], sets[b]) < 1]
    assert sum((plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 3 for a, b in linked) > 20  # more than the radius of op9 holds
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_long_look_alikes_below_the_similarity_are_not_all_verified(spark, monkeypatch):
    r = random.Random(9)
    common = [f"c{k}" for k in range(1800)]
    texts = []
    for i in range(400):  # each shares 0.7 of its shingles with every other one
        own = [f"o{i}-{k}" for k in range(388)]
        texts.append(" ".join(common + own))
    texts += [near(r, texts[k], 30) for k in range(20)]  # and some are real copies of one of them
    tried, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (tried.append(pairs.count()), verified(pairs, *a))[1])
    sets = [plain_set(t) for t in texts]
    assert 0.68 < likeness(sets[0], sets[1]) < 0.72 and 0.8 <= likeness(sets[0], sets[400]) < 1
    out = jaccard.keep_one(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA))
    assert sorted(x["doc_id"] for x in out.collect()) == list(range(400))
    assert sum(tried) < 10 * len(texts), tried  # of 88,000 pairs


def test_rare_shingles_meet_in_every_pair_that_reaches_the_similarity(spark):
    r = random.Random(11)
    texts = {}
    for k in range(60):
        base = " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([6, 9, 25, 60])))
        texts[3 * k], texts[3 * k + 1] = base, near(r, base, 1)
        texts[3 * k + 2] = base + " " + " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([1, 2, 12])))
    sets = {k: plain_set(t) for k, t in texts.items()}
    rows = spark.createDataFrame([(k, len(s), k) for k, s in sets.items()], "sid long, n long, label long")
    own = spark.createDataFrame(list(texts.items()), "sid long, text string")
    got = {(x["u"], x["v"]) for x in jaccard.rare_pairs(rows, own, 5, 0.8).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and likeness(sets[a], sets[b]) >= 0.8}
    assert want and want <= got and len(got) < 600
