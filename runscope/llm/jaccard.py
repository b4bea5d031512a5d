"""Near duplicates at a stated similarity of word shingles, from SimHash fingerprints.

Texts of equal shingle sets are one set.  The Gray-order index proposes sets whose
fingerprints link at few bits, which joins most copies.  At similarity 0.8
fingerprints differ in about 10 of 64 bits and up to some 17, a radius that no
index of 64 bits can prune; so sets that agree in all minima of one of BANDS bands
are candidates too (a pair at SIMILARITY is missed by all bands with a probability
of 0.0004).  Every candidate of either kind is verified on the whole texts.  Hot
bands cost little: first only star pairs are tried (each set against the first of
its band).  Among the sets of bands that still hold several groups an exact join
finds the rest: shingles ordered by how few sets have them, and of two sets the
smaller one's first ones against the larger one's, with bounds of length and place.
Look-alikes below the similarity differ in their rare shingles, and so do not meet.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches, struct
from runscope.llm.components import components, one_row_each, placed
from runscope.llm.simhash import link_forest, majority, shingle_hashes
from runscope.session import materialize

WIDTH, SIMILARITY = 5, 0.8
#: Bands of minima, minima of a band; a set's rarest shingles that are told with each of the others, its parity bits.
BANDS, ROWS, AHEAD, BITS = 20, 5, 32, 512
_DRAW = np.random.default_rng(42)
_FLIP, _FACTOR = (_DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTOR |= np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def sketch(own: np.ndarray) -> tuple[int, list[int]]:
    """A set's identity and the hash of each band's minima, as signed longs."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(own), 4096):
        least = np.minimum(least, ((own[k : k + 4096, None] ^ _FLIP) * _FACTOR).min(axis=0))
    bands = np.array([xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)
    name = np.array([xxh64_intdigest(own.tobytes())], np.uint64)
    return int(name.view(np.int64)[0]), bands.view(np.int64).tolist()


#: What a sketch holds: the set's identity, its size, its fingerprint and its bands.
SKETCH = ("sid", "n", "fp", "bands")


def sketched(docs: DataFrame, text: str, names: list[str], width: int = WIDTH) -> DataFrame:
    """All columns and the sketch of each row's shingle set, its fields called ``names`` (in the order of SKETCH).

    Null and empty texts have the empty set; repeated rows stay; an empty table gives no row.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema.fields, *struct(*zip(names, (T.LongType(), T.LongType(), T.LongType(), longs), strict=True)).fields])

    def of(text: str | None) -> tuple:
        hashes = shingle_hashes(text, width)
        own = np.unique(np.array(hashes, np.uint64))
        sid, bands = sketch(own)
        return sid, len(own), int(np.array(majority(hashes), np.uint64).view(np.int64)), bands

    def make(at=docs.columns.index(text)):
        def run(batch: pa.RecordBatch):
            made = [of(t) for t in batch.column(at).to_pylist()]
            return [*batch.columns, *[[m[k] for m in made] for k in range(len(SKETCH))]]

        return run

    return map_batches(docs, make, schema)


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of sets whose whole texts (sid, text) reach the similarity.  Two empty sets are alike; no pairs give no row."""
    side = lambda name, as_: texts.select(F.col("sid").alias(name), F.col("text").alias(as_))
    rows = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")

    def make():
        of = lru_cache(64)(lambda t: shingles(t, width))

        def run(batch: pa.RecordBatch):
            good = [similar(of(a), of(b), similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return [batch.column(k).filter(pa.array(good, pa.bool_())) for k in range(2)]

        return run

    return map_batches(rows, make, struct(("u", T.LongType()), ("v", T.LongType())))


def parity(own: np.ndarray) -> list[int]:
    """For each remainder modulo BITS whether an odd number of shingles has it, as longs."""
    odd = (np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _may_reach(similarity: float) -> Column:
    """Bits that differ are at most as many as shingles that differ, and so bound the similarity; beyond some 500 shingles they rule out little."""
    apart = sum((F.bit_count(F.get("bits", k).bitwiseXOR(F.get("bits1", k))) for k in range(BITS // 64)), F.lit(0))
    return apart <= (F.col("n") + F.col("n1")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def rare_pairs(sets: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Candidate pairs (u, v): sets (sid, n, label) of different labels that may reach the similarity.  None that does is left out.

    Shingles are in the order of how many sets have them; those that one set alone has
    come first and meet nothing, but count for the places of the others.  With an overlap
    of at least ``o`` two sets share one of the first ``n - o + 1`` of each.  For the smaller
    set (by size, then by sid) ``o`` is at least 2s/(1+s) of its size, for the larger one s.
    Of shingles in both prefixes a pair stays only if what is left behind their places
    still can make up the overlap, if the parity bits allow it, and only at the first one, as
    far as AHEAD tells.
    """
    own = texts.join(sets.select("sid", "n", "label"), "sid")

    def make(at=own.columns):
        def run(batch: pa.RecordBatch):
            each = [shingles(t, width).view(np.int64) for t in batch.column(at.index("text")).to_pylist()]
            which = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
            return [*[batch.column(at.index(c)).take(which) for c in ("sid", "n", "label")], np.concatenate([np.zeros(0, np.int64), *each])]

        return run

    def make_bits(at=own.columns):
        return lambda batch: [batch.column(at.index("sid")), [parity(shingles(t, width)) for t in batch.column(at.index("text")).to_pylist()]]

    bits = materialize(map_batches(own, make_bits, struct(("sid", T.LongType()), ("bits", T.ArrayType(T.LongType())))), "parity_bits")
    rows = map_batches(own, make, struct(("sid", T.LongType()), ("n", T.LongType()), ("label", T.LongType()), ("h", T.LongType())), rows=64)
    rows = materialize(rows, "open_shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(common, "h")
    w = Window.partitionBy("sid")
    shared = shared.withColumn("m", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("df", "h")) + F.col("n") - F.col("m"))
    least = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1
    first = shared.where(F.col("place") <= least(similarity)).withColumn("inner", F.col("place") <= least(2 * similarity / (1 + similarity)))
    # of the shingles that a pair shares only the first is wanted: some of those before go along
    ahead = F.array_compact(F.array(*[F.nth_value("h", k).over(w.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)) for k in range(1, AHEAD + 1)]))
    first = materialize(first.withColumn("ahead", ahead).join(bits, "sid").select("h", "sid", "n", "label", "place", "inner", "ahead", "bits"), "rare_shingles")
    small = first.where("inner").select("h", *[F.col(c).alias(f"{c}1") for c in ("sid", "n", "label", "place", "ahead", "bits")])
    met = small.join(first, "h").where(_may_reach(similarity) & ~F.arrays_overlap("ahead1", "ahead")).where((F.struct("n1", "sid1") < F.struct("n", "sid")) & (F.col("label1") != F.col("label")) & (F.col("n1") >= F.col("n") * similarity - 1e-6))
    overlap = (F.col("n") + F.col("n1")) * (similarity / (1 + similarity)) - 1e-6
    met = met.where(1 + F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1")) >= overlap)
    return met.select(F.least("sid", "sid1").alias("u"), F.greatest("sid", "sid1").alias("v")).distinct()


def roots_of(own: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the group of each set of ``own`` (the columns of SKETCH, and text) that is linked to another.

    Empty sets are one set; repeated rows and an empty table give nothing more.
    """
    sets = materialize(own.select(*SKETCH).dropDuplicates(["sid"]), "sets")
    rows = sets.select("sid", F.posexplode("bands").alias("k", "band")).select("sid", F.xxhash64("k", "band").alias("key"))
    firsts = rows.groupBy("key").agg(F.min("sid").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    shared = materialize(rows.join(firsts, "key"), "shared_bands")
    by_print = sets.groupBy("fp").agg(F.min("sid").alias("first"))
    forest = link_forest(by_print.select("fp"))
    of = lambda fp, as_: by_print.select(F.col("fp").alias(fp), F.col("first").alias(as_))
    proposed = forest.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    proposed = materialize(proposed.unionByName(sets.join(by_print, "fp").select(F.col("first").alias("a"), F.col("sid").alias("b")).where("a <> b")), "proposed")
    wanted = shared.select("sid").union(proposed.select("a")).union(proposed.select("b")).distinct()
    texts = materialize(own.select("sid", "text").join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "set_texts")
    star = shared.where("sid <> first").groupBy(F.col("sid").alias("v")).agg(F.min("first").alias("u")).select("u", "v")
    pairs = proposed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(star).distinct()
    links = materialize(verified(pairs, texts, width, similarity), "links0")
    roots = materialize(components(links), "set_roots0")
    for k in (1, 2):
        named = lambda name, as_: roots.select(F.col("node").alias(name), F.col("root").alias(as_))  # noqa: E731, B023
        grouped = shared.join(named("sid", "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        if k == 1:
            tried = grouped.where("sid <> first").join(named("first", "label2"), "first", "left").where(F.col("label") != F.coalesce("label2", "first"))
            pairs = tried.select(F.col("first").alias("u"), F.col("sid").alias("v")).distinct()
        else:
            open_ = grouped.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
            left = grouped.join(open_, "key", "left_semi").select("sid", "label").distinct().join(sets.select("sid", "n"), "sid")
            pairs = rare_pairs(materialize(left, "open_sets"), texts, width, similarity)
        more = materialize(verified(pairs, texts, width, similarity), f"links{k}")
        if not more.isEmpty():  # what is known already is a star for each group
            roots = materialize(components(more.unionByName(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))), f"set_roots{k}")
    return roots


def keep_one(docs: DataFrame, text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate group, with all its columns.

    Rows are linked at ``similarity`` or more of their sets of ``width``-word
    shingles, and groups are what links join.  Texts without words are one group.
    A row is judged by its own text, so rows of one doc_id with unlike texts are of
    different groups.  Of a group the row with the smallest doc_id stays (a null id
    comes last), of equals the one with the smaller hash of its text, then of all
    columns; the order of the rows plays no part; an empty table gives no row.
    """
    names = fresh(docs.columns, *SKETCH, "root", "row", "place")
    made, (root, row, place) = names[: len(SKETCH)], names[len(SKETCH) :]
    own = materialize(placed(sketched(docs, text, made, width), docs.columns, text, (row, place)), "shingle_sets")
    plain = own.select(*[F.col(n).alias(c) for n, c in zip(made, SKETCH, strict=True)], F.col(f"`{text}`").alias("text"))
    roots = roots_of(plain, width, similarity).select(F.col("node").alias(made[0]), F.col("root").alias(root))
    grouped = own.select("doc_id", made[0], row, place).join(roots, made[0], "left").withColumn(root, F.coalesce(root, made[0]))
    return one_row_each(own, grouped, root, (row, place), docs.columns)
