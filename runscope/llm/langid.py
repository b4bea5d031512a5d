"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, most
frequent first.  A document is ranked the same way and compared to each profile
by the out-of-place distance: the sum over its n-grams of how far their ranks lie
apart, PROFILE for an n-gram that the profile does not have.  The nearest wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches, struct

#: N-grams of a profile; longest n-gram.
PROFILE, LONGEST = 300, 3
#: Languages that are learned at most, the most frequent ones.
LANGUAGES = 500
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of letters within words, a word edge counting as a space.

    An n-gram's code has 21 bits for each character, the first highest.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.int64)
    edge = c == 32
    c = c[np.concatenate([[True], ~(edge[1:] & edge[:-1])])]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equals by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), size, np.int64)
        self.missing = np.ones((len(self.codes) + 1, len(self.names)), bool)
        for k, name in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(profiles[name], np.int64))
            self.ranks[at, k] = np.arange(len(at))
            self.missing[at, k] = False

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """The nearest language (the first by name of equals), 1 less its share of the largest distance, and the n-grams ranked."""
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0, 0
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        apart = np.where(self.missing[at], self.size, np.abs(self.ranks[at] - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.size * len(top))), len(top)


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def _labelled(docs: DataFrame) -> DataFrame | None:
    """(lang, text) of every row of the LANGUAGES most frequent languages; None without a language."""
    known = docs.where("lang is not null and text is not null")
    most = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    return known.where(F.col("lang").isin(most)).select("lang", "text") if most else None


def learn(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of the languages in ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    Counted over every row of a language.  Counts are added up in the tasks and again
    after a shuffle by n-gram; ``size`` rows a language reach the driver.
    """
    rows = _labelled(labelled)
    if rows is None:
        return {}

    def make():
        def run(batch: pa.RecordBatch):
            found: dict[str, list] = {}
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found.setdefault(lang, []).append(grams(text))
            out = ([], [], [])
            for lang, parts in found.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
                out[0].extend([lang] * len(codes))
                out[1].extend(codes.tolist())
                out[2].extend(n.tolist())
            return out

        return run

    counts = map_batches(rows, make, struct(("lang", T.StringType()), ("code", T.LongType()), ("n", T.LongType()))).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: list[str] | None = None, ranked_as: str | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1; or other ``names``) to the columns ``keep`` (all by default), and the number of n-grams ranked as ``ranked_as``.

    A null text, a text without a letter, and any text where no profile was
    learned are ``und`` with score 0.  Every row is judged by its whole text
    alone, so repeated rows agree; columns named like the new ones are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())] + ([T.StructField(ranked_as, T.LongType())] if ranked_as else []))

    def make():
        judge = Profiles(profiles)

        def run(batch: pa.RecordBatch):
            found = [judge.predict(t) for t in batch.column(len(keep)).to_pylist()]
            return [*[batch.column(k) for k in range(len(keep))], *[[f[k] for f in found] for k in range(3 if ranked_as else 2)]]

        return run

    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(fresh(keep, "text")[0])), make, schema)


def trained_on(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from the rows of documents that are not held out."""
    return learn(docs.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))


#: Labelled texts of a length from which a bound is taken; the parts of their lowest and of their median score that it may be.
BOUND_ROWS, LOWEST_SHARE, MEDIAN_SHARE = 30, 0.95, 0.5


def length_class(n: Column) -> Column:
    """Texts of about as many ranked n-grams."""
    return F.floor(F.log2(n.cast("double"))).cast("int")


def least_scores(docs: DataFrame, profiles: dict[str, list[int]]) -> dict[int, float]:
    """The least score of a text of its language, for each length class; none where few labelled texts are of that length.

    Taken over every labelled row that is not held out.  It is just under the lowest score of a labelled text that gets its own language,
    and no more than half of their median: where few labelled texts are alike, another
    one of the language may be quite a bit below them all.
    """
    rows = _labelled(docs.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    if rows is None:
        return {}
    right = identify(rows, profiles, ranked_as="n").where("lang = lang_pred")
    found = right.groupBy(length_class(F.col("n")).alias("k")).agg(F.min("score").alias("least"), F.percentile_approx("score", 0.5).alias("middle"), F.count("*").alias("rows")).collect()  # nine rows at most
    return {r["k"]: min(r["least"] * LOWEST_SHARE, r["middle"] * MEDIAN_SHARE) for r in found if r["rows"] >= BOUND_ROWS}


def of_language(docs: DataFrame, profiles: dict[str, list[int]], least: dict[int, float], floor: float, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that are about as like a language as the labelled ones of their length, with the language found as ``lang``.

    ``least`` holds the bound of each length class; a length without one takes the
    loosest of the others, a text shorter than all of them ``floor``, which every text
    must reach.  Null texts and texts without a letter go; repeated rows are judged
    alike; all other columns stay as they are, whatever their names.
    """
    pred, like, size = fresh(docs.columns, "lang_pred", "score", "ranked")
    found = identify(docs, profiles, text, ranked_as=size, names=(pred, like))
    k = length_class(F.col(size))
    bound = F.when(k > min(least), F.lit(max(min(least.values()), floor))).otherwise(floor) if least else F.lit(floor)
    for c, score in least.items():
        bound = F.when(k == c, F.lit(max(score, floor))).otherwise(bound)
    kept = found.where((F.col(pred) != UNDETERMINED) & (F.col(like) >= bound))
    return kept.select(*[F.col(pred).alias(c) if c == lang else F.col(f"`{c}`") for c in docs.columns])
