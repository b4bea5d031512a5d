"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text: shares of character
classes, repeats and lengths, and the shares of its words by hashed bucket.  From pairs of a
preferred and a rejected labelled document the weights are learned by logistic
loss on the differences of their features.  The threshold is a quantile of the
strengths of the labelled sample; a score maps the strength so that the threshold
has the score that decides.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches
from runscope.llm.langid import remainder

#: Labelled rows that the weights are learned from, at most about so many; partners of each in pairs; the score that decides.
LEARN_ROWS, PARTNERS, DECIDES = 20_000, 8, 0.3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:'\"-()?", "mark": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~"}
_SETS = [np.frombuffer(v, np.uint8) for v in _CLASSES.values()]
#: Buckets of words; words whose bucket a worker remembers.
BUCKETS, REMEMBERED = 32, 500_000
FEATURES = [f"{a}{b}" for a in (*_CLASSES, "repeat", "same_line", "few_words") for b in ("", "_root")] + ["log_words", "word_length", "line_length"] + [f"words_{k}" for k in range(BUCKETS)]
_bucket: dict[str, int] = {}


def lexical(counts: Counter, n: int) -> list[float]:
    """Roots of the shares of ``n`` words in each bucket of their hashed lower case."""
    if len(_bucket) > REMEMBERED:
        _bucket.clear()
    out = [0] * BUCKETS
    for word, times in counts.items():
        k = _bucket.get(word)
        if k is None:
            k = _bucket[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        out[k] += times
    return [(x / n) ** 0.5 for x in out]


def features(text: str | None) -> list[float]:
    """Of a whole text; all zero for a text without words."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    chars = max(1, len(raw) - int(seen[[9, 10, 13, 32]].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [float(seen[s].sum()) / chars for s in _SETS]
    shares.append(sum(map(operator.eq, words, words[1:])) / n)
    shares.append(1 - len(set(lines)) / len(lines))
    counts = Counter(words)
    shares.append(1 - np.log1p(len(counts)) / np.log1p(n))
    out = []
    for x in shares:
        out += [x, x**0.5]
    return [*out, float(np.log1p(n)), min(chars / n, 50) / 10, float(np.log1p(len(raw) / len(lines))), *lexical(counts, n)]


class Ranking:
    """Weights, and the map from strengths to scores."""

    def __init__(self, x: np.ndarray, label: np.ndarray, partners: int = PARTNERS):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
        self.spread = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(len(FEATURES))
        self.weight = np.zeros(len(FEATURES))
        self.threshold, self.scale = 0.0, 1.0
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        if not len(good) or not len(bad):
            return
        z = (x - self.mean) / self.spread
        pick = np.random.default_rng(0)
        won = np.concatenate([np.repeat(good, partners), pick.choice(good, len(bad) * partners)])
        lost = np.concatenate([pick.choice(bad, len(good) * partners), np.repeat(bad, partners)])
        d = z[won] - z[lost]
        for _ in range(25):  # Newton steps on the mean logistic loss with a small ridge
            p = 1 / (1 + np.exp(np.clip(d @ self.weight, -30, 30)))
            slope = -(d * p[:, None]).mean(axis=0) + 1e-3 * self.weight
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(d.shape[1])
            self.weight = self.weight - np.linalg.solve(curve, slope)
        strength = z @ self.weight
        levels = np.quantile(strength, np.arange(1, 1000) / 1000)  # the threshold is the quantile that separates most
        right = [int((strength[good] >= t).sum() + (strength[bad] < t).sum()) for t in levels]
        best = np.flatnonzero(np.array(right) == max(right))
        self.threshold = float(levels[best].mean())
        self.scale = max(1e-6, float(np.std(strength)) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; DECIDES at the threshold."""
        strength = ((x - self.mean) / self.spread) @ self.weight
        return 1 / (1 + np.exp(-np.clip((strength - self.threshold) / self.scale + np.log(DECIDES / (1 - DECIDES)), -500, 500)))


def _featured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def make():
        return lambda batch: [*[batch.column(k) for k in range(len(keep))], [features(t) for t in batch.column(len(keep)).to_pylist()]]

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(keep, "text")[0])), make, schema)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Ranking:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1; other values teach nothing).

    Fitted on a bounded sample: the labels whose hashed doc_id is below a share
    that gives about ``rows`` of them, and at most 2 * ``rows`` texts of these (by hash,
    where a doc_id has many rows).  The sample is broadcast, and its features
    come to the driver, where one class alone leaves all scores equal.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    share = min(1.0, rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("pairs")), F.lit(1 << 30)) < share * (1 << 30))
    few = _featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "quality"], "text")
    found = few.orderBy(F.xxhash64("doc_id", "quality", "features"), "doc_id", "quality").limit(2 * rows).collect()
    found.sort(key=lambda r: (r["doc_id"], r["quality"]))
    return Ranking(np.array([r["features"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in found]))


def score(docs: DataFrame, ranking: Ranking, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from DECIDES on) to the columns ``keep`` (all by default).

    Null, empty and blank texts get the score of all-zero features.  A score
    depends on the row's whole text alone; columns named like the new ones are
    replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def make():
        def run(batch: pa.RecordBatch):
            x = np.array([features(t) for t in batch.column(len(keep)).to_pylist()])
            return [*[batch.column(k) for k in range(len(keep))], pa.array(ranking.score(x))]

        return run

    scored = map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(keep, "text")[0])), make, schema)
    return scored.withColumn("predicted", (F.col("score") >= DECIDES).cast("int"))


def trained_on(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from the labels that are not held out."""
    return learn(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
