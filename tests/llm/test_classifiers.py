import random
import zlib

import numpy as np

from runscope.llm import langid, quality

DOCS = "doc_id long, text string, lang string, score string, features int"
LABELS = "doc_id long, quality int, toxic int, text string"
SYLLABLES = {"en": "th er on an re he in ed nd ou", "fr": "é è ai eau ou que tre ment la eux", "de": "sch ein ich ung ver zu ß ä ö pf"}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        good = r.random() < 0.7
        text = " ".join(words) + "." if good else r.choice([" | ", "!! ", "%%% "]).join(w.upper() if k % 2 else w for w in words)
        docs.append((k, text, lang if k % 17 else None, "clash", 1))
        labels.append((k, int(good), 0, "clash"))
    return docs, labels


AWKWARD = [(1000, None, None, "", 0), (1001, "", "en", "", 0), (1002, "12 !! 3", "en", "", 0), (1003, "x" * 300_000, None, "", 0), (None, "the other thing", "en", "", 0), (1001, "", "en", "", 0)]


def out_of_place(text, profiles, size):
    """The rule by definition, with strings."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    count = {}
    for w in words:
        p = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g == " " or (n == 3 and g[1] == " "):
                    continue
                count[g] = count.get(g, 0) + 1
    if not count:
        return "und", 0.0
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = sorted(count, key=lambda g: (-count[g], code(g)))[:size]
    best = min(sorted(profiles), key=lambda p: (sum(abs(i - profiles[p].index(code(g))) if code(g) in profiles[p] else size for i, g in enumerate(top)), p))
    apart = sum(abs(i - profiles[best].index(code(g))) if code(g) in profiles[best] else size for i, g in enumerate(top))
    return best, 1 - apart / (size * len(top))


def test_language_by_out_of_place_distance(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows + AWKWARD, DOCS)
    profiles = langid.trained_on(docs)
    assert set(profiles) == set(SYLLABLES) and all(len(p) <= langid.PROFILE for p in profiles.values())
    out = langid.identify(docs, profiles)
    assert out.columns == ["doc_id", "text", "lang", "features", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) + len(AWKWARD)
    held = [r for r in got if r["lang"] and r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    for r in got:
        name, score = out_of_place(r["text"], profiles, langid.PROFILE)
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-9
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1000, 1001, 1002)] == ["und"] * 4
    none = docs.limit(0)
    assert langid.identify(none, langid.trained_on(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


def test_quality_on_held_out_documents(spark):
    rows, marks = corpus(seed=2)
    docs, labels = spark.createDataFrame(rows + AWKWARD, DOCS), spark.createDataFrame(marks + [(1002, None, 0, ""), (5000, 1, 0, ""), (None, 0, 0, ""), marks[0]], LABELS)
    ranking = quality.trained_on(docs, labels)
    out = quality.score(docs, ranking)
    assert out.columns == ["doc_id", "text", "lang", "features", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) + len(AWKWARD)
    truth = {k: q for k, q, *_ in marks}
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    one_class = quality.learn(docs, labels.where("quality = 1"))
    assert {round(r["score"], 9) for r in quality.score(docs, one_class).collect()} == {0.3}
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0


def test_pairs_order_strengths():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, len(quality.FEATURES)))
    strength = 2 * x[:, 0] - x[:, 3]
    label = (strength + 0.3 * r.normal(size=400) > 0.8).astype(int)
    rank = quality.Ranking(x, label)
    s = rank.score(x)
    won = np.mean([s[i] > s[j] for i in np.flatnonzero(label == 1) for j in np.flatnonzero(label == 0)])
    assert won > 0.95 and np.mean((s >= 0.3) == label) > 0.9


def test_weights_are_the_least_of_the_pairwise_loss_and_the_threshold_separates_most():
    r = np.random.default_rng(4)
    x = r.normal(size=(120, len(quality.FEATURES)))
    label = (x[:, 0] - 0.7 * x[:, 3] + r.normal(size=120) > 0).astype(int)
    found = quality.Ranking(x, label)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pick = np.random.default_rng(0)
    winners = np.concatenate([np.repeat(good, quality.PARTNERS), pick.choice(good, len(bad) * quality.PARTNERS)])
    losers = np.concatenate([pick.choice(bad, len(good) * quality.PARTNERS), np.repeat(bad, quality.PARTNERS)])

    def loss(w):
        return float(np.mean([np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in zip(winners, losers, strict=True)])) + 5e-4 * float(w @ w)

    least = loss(found.weight)
    for k in range(len(found.weight)):  # no step along any weight lowers the loss
        for step in (-1e-3, 1e-3):
            moved = found.weight.copy()
            moved[k] += step
            assert loss(moved) >= least - 1e-12
    strength = z @ found.weight
    right = lambda t: sum((s >= t) == (y == 1) for s, y in zip(strength, label, strict=True))
    assert right(found.threshold) >= max(right(t) for t in strength) - 2
    scores = found.score(x)
    assert all((s >= quality.DECIDES) == (v >= found.threshold) for s, v in zip(scores, strength, strict=True))
    assert (np.argsort(scores) == np.argsort(strength)).all()


def test_samples_are_bounded_in_rows_and_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "Ranking", lambda x, y: seen.append(len(x)))
    docs = spark.range(300).selectExpr("id % 5 as doc_id", "concat('text number ', id) as text")  # sixty texts for each id
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int")
    quality.learn(docs, labels, rows=10)
    assert seen[0] <= 20
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    many = spark.range(400).selectExpr("id as doc_id", "'some words' as text", "concat('l', floor(sqrt(id))) as lang")
    assert sorted(langid.learn(many)) == ["l17", "l18", "l19"]


def test_every_labelled_row_counts_for_profiles_and_bounds(spark):
    """One text of 3,000 is quite another than the rest: its n-grams are in the profile, its score is the bound of its length."""
    plain, other, odd = "the other thing is in the house and the river runs to the town", "zyxwv vqkjz xqzvk jkqxz zvvkq qxjwk kzwvx wvqzj jzqkx", 46
    assert zlib.crc32(str(odd).encode()) % 3 != 1 and len({len(langid.grams(t)[0]).bit_length() for t in (plain, other)}) == 1
    docs = spark.createDataFrame([(k, plain if k != odd else other, "en") for k in range(3000)], "doc_id long, text string, lang string")
    assert ord("q") in langid.trained_on(docs)["en"]
    rest = langid.trained_on(docs.where(f"doc_id <> {odd}"))
    assert list(langid.least_scores(docs, rest).values()) == [langid.Profiles(rest).predict(other)[1] * langid.LOWEST_SHARE]
