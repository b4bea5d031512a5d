"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One edit changes the counts of letters by two at most: a replacement takes one letter
and adds one, an insertion adds one.  For each pair of word lengths (the same, and next
ones) a range search over the trees of the longer words prunes every box that needs more
than that; the order of the letters decides about what is left.

The top of a tree is fitted on a bounded sample and deals the words of a length to
cells; a word is looked up in each cell that it may reach.  Tasks hold a bounded
block of a cell's words, as a tree, and a bounded block of those looked up in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.packing import pack, values
from runscope.session import materialize

#: Words of a cell and of a block, words that the top of a tree is fitted on, words of a leaf, levels of a top.
CELL_WORDS, FIT_WORDS, LEAF_WORDS, LEVELS = 8192, 20_000, 32, 12
#: Code points of a block at most; bytes of a comparison in a task.
BLOCK_CHARS, STEP_BYTES = 1 << 22, 1 << 23
#: Counts of a word: a to z, and the other letters (U+00C0 to U+00FF) by their code point's remainder.
PLAIN, OTHERS = 26, 6
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "block long, length int, cell int, words array<string>, n array<long>"
ASKED = "asked long, length int, cell int, own int, words array<string>, n array<long>"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6) -> DataFrame:
    """(word): the runs of letters of all texts with at least ``least`` code points, A-Z alone lower-cased.

    Of a run whose unsigned crc32 of ``<key>:<run>`` 199 divides, the code point at
    that number modulo its length is left out.  A null text has no runs; a null key
    is an empty one.
    """
    found = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    found = found.where(F.length("run") >= least).withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of their code points, which are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def counts(letters: np.ndarray) -> np.ndarray:
    """How often each word has each letter."""
    place = np.where(letters >= 0xC0, PLAIN + letters % OTHERS, letters - ord("a")).astype(np.int64)
    n, dims = len(letters), PLAIN + OTHERS
    flat = np.bincount((np.arange(n)[:, None] * dims + place).reshape(-1), minlength=n * dims).reshape(n, dims)
    return flat.astype(np.int8 if letters.shape[1] < 100 else np.int32)


class Tree:
    """A k-d tree over letter counts.

    ``tight`` boxes are those of the words that a node holds; else those of the splits
    alone, so that any word stands in one leaf.
    """

    def __init__(self, x: np.ndarray, leaf: int, levels: int = 64, tight: bool = True):
        self.leaves: list[np.ndarray] = []
        self.top = np.iinfo(x.dtype).max
        dims = x.shape[1]
        self.root = self._grow(x, np.arange(len(x)), np.zeros(dims, x.dtype), np.full(dims, self.top, x.dtype), leaf, levels, tight)

    def _grow(self, x, own, lo, hi, leaf, levels, tight):
        if tight:
            lo, hi = x[own].min(axis=0), x[own].max(axis=0)
        part = x[own]
        if len(own) > leaf and levels:
            spread = part.astype(np.float32).var(axis=0)
            d = int(spread.argmax())
            if spread[d] > 0:
                at = int(np.median(part[:, d]))
                at = min(at, int(part[:, d].max()) - 1)
                left = part[:, d] <= at
                under, over = hi.copy(), lo.copy()
                under[d], over[d] = at, at + 1
                kids = (self._grow(x, own[left], lo, under, leaf, levels - 1, tight), self._grow(x, own[~left], over, hi, leaf, levels - 1, tight))
                return lo, hi, kids, d, at
        self.leaves.append(own)
        return lo, hi, len(self.leaves) - 1, -1, -1

    def reach(self, q: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of q): which words may come into a leaf's box by adding ``more`` letters and taking ``less`` at most."""
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            (lo, hi, kids, _, _), own = stack.pop()
            part = q[own]
            up = np.maximum(lo - part, 0).sum(axis=1, dtype=np.int32)
            down = np.maximum(part - hi, 0).sum(axis=1, dtype=np.int32)
            own = own[(up <= more) & (down <= less)]
            if not len(own):
                continue
            if isinstance(kids, int):
                yield kids, own
            else:
                stack += [(k, own) for k in kids]

    def place(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each word, by the splits."""
        out, stack = np.zeros(len(q), np.int32), [(self.root, np.arange(len(q)))]
        while stack:
            (_, _, kids, d, at), own = stack.pop()
            if isinstance(kids, int):
                out[own] = kids
            else:
                left = q[own, d] <= at
                stack += [(k, o) for k, o in zip(kids, (own[left], own[~left]), strict=True) if len(o)]
        return out


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ by one replaced one (equal lengths) or by one inserted into ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), n)
    last = np.where(behind.any(axis=1), n - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


def pairs_of(tree: Tree, x: np.ndarray, letters: np.ndarray, q: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x) for all words one edit apart; the words of ``x`` have as many letters as those asked for, or one more."""
    longer = letters.shape[1] - asked.shape[1]
    found = []
    step = max(1, STEP_BYTES // (LEAF_WORDS * x.shape[1] * x.itemsize))
    for leaf, rows in tree.reach(q, 1, 1 - longer):
        own = tree.leaves[leaf]
        for k in range(0, len(own), LEAF_WORDS):  # a leaf of words with equal counts may be longer
            part = own[k : k + LEAF_WORDS]
            for s in range(0, len(rows), step):
                r = rows[s : s + step]
                apart = np.abs(q[r][:, None, :] - x[part][None, :, :]).sum(axis=2, dtype=np.int32)
                i, j = np.nonzero(apart <= 2 - longer)
                i, j = r[i], part[j]
                room = max(1, STEP_BYTES // letters.shape[1])
                for e in range(0, len(i), room):
                    near = one_edit(asked[i[e : e + room]], letters[j[e : e + room]])
                    found.append((i[e : e + room][near], j[e : e + room][near]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _best(of: np.ndarray, near: np.ndarray, names: list[str], other: list[str], n: np.ndarray) -> list[pa.Array]:
    """For each word with a near one: the word, how many, the largest count and the smallest word that has it."""
    order_of = np.empty(len(other), np.int64)
    order_of[sorted(range(len(other)), key=other.__getitem__)] = np.arange(len(other))
    order = np.lexsort((order_of[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    many = np.diff([*first.tolist(), len(of)])
    return [pa.array([names[i] for i in of[first]], pa.string()), pa.array(many, pa.int64()), pa.array(n[near[first]], pa.int64()), pa.array([other[i] for i in near[first]], pa.string())]


def neighbours(words: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of a table of different words with counts ``n``: only words with a near one."""
    spark = words.sparkSession
    cores = spark.sparkContext.defaultParallelism
    lengths = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > cell_words).collect()}
    tops = {}
    for length, n in lengths.items():
        sample = [r["word"] for r in words.where(F.length("word") == length).orderBy(F.xxhash64("word"), "word").limit(min(FIT_WORDS, max(1, BLOCK_CHARS // length))).select("word").collect()]
        tops[length] = Tree(counts(codes(sample)), max(1, len(sample) * cell_words // n), LEVELS, tight=False)

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        names = b.column("word").to_pylist()
        sizes = np.array([len(w) for w in names])
        for length in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == length)
            room = max(1, BLOCK_CHARS // length)
            for s in range(0, len(at), room):
                yield length, at[s : s + room], counts(codes([names[i] for i in at[s : s + room]]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, at, x in by_length(b):
                cell = tops[length].place(x) if length in tops else np.zeros(len(at), np.int32)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(np.full(len(at), length, np.int32)), pa.array(cell)], names=["word", "n", "length", "cell"])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, at, x in by_length(b):
                for longer in (0, 1):
                    top = tops.get(length + longer)
                    reached = top.reach(x.astype(np.int32), 1, 1 - longer) if top else [(0, np.arange(len(at)))]
                    for cell, rows in reached:
                        own = b.take(pa.array(at[rows]))
                        yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(np.full(len(rows), k, np.int32)) for k in (length + longer, cell, length)]], names=["word", "n", "length", "cell", "own"])

    def packed(t: pa.Table) -> dict:
        same = {c: t[c][0] for c in ("length", "cell", "own") if c in t.column_names}
        return same | {"words": t["word"].to_pylist(), "n": t["n"].to_numpy()}

    room = lambda key: max(1, min(cell_words, BLOCK_CHARS // key[0]))
    schema = lambda ddl: spark.createDataFrame([], ddl).schema
    many, plain = words.count(), words.select("word", "n")
    blocks = pack(plain.mapInArrow(dealt, "word string, n long, length int, cell int"), ["length", "cell", "word"], ["length", "cell"], room, packed, schema(BLOCK), many, cores)
    blocks = materialize(blocks, "word_blocks")
    asked = pack(plain.mapInArrow(looked_up, "word string, n long, length int, cell int, own int"), ["length", "cell", "own", "word"], ["length", "cell", "own"], room, packed, schema(ASKED), 4 * many, cores)
    asked = materialize(asked.join(blocks.select("length", "cell").distinct(), ["length", "cell"], "left_semi"), "asked_words")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for i in range(b.num_rows):
                block = b.column("block")[i].as_py()
                if block not in held:
                    if len(held) == 4:
                        del held[next(iter(held))]
                    names = b.column("words")[i].as_py()
                    letters = codes(names)
                    x = counts(letters)
                    held[block] = names, letters, x, Tree(x, LEAF_WORDS)
                names, letters, x, tree = held[block]
                others = b.column("others")[i].as_py()
                own = codes(others)
                q, d = pairs_of(tree, x, letters, counts(own).astype(x.dtype), own)
                n, m = values(b, "n", i), values(b, "m", i)
                yield pa.RecordBatch.from_arrays(_best(q, d, others, names, n), names=["word", "n_near", "best_n", "best"])
                if letters.shape[1] > own.shape[1]:  # longer words are not looked up among the shorter ones
                    yield pa.RecordBatch.from_arrays(_best(d, q, names, others, m), names=["word", "n_near", "best_n", "best"])

    tasks = max(1, min(blocks.count(), 20_000))
    asks = asked.select("length", "cell", F.col("words").alias("others"), F.col("n").alias("m")).repartition(tasks, "length", "cell")
    found = asks.join(blocks, ["length", "cell"]).mapInArrow(search, "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
    return best.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead in the end.  Counts grow fivefold with each step, so there are few rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").take(1):
            return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, occurrences: int = 5, times: int = 5, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``least`` code points and ``occurrences`` occurrences.

    ``n_near`` words are one inserted, deleted or replaced code point away.  ``form`` is the
    most frequent of them (of equals the smallest in code-point order) if it occurs at least
    ``times`` times as often, else null as ``form_n`` is; ``root`` follows the forms to the last one,
    the word itself if it has none.  Null and empty texts have no words; repeated rows count
    each time; an empty table gives no row; other columns are ignored.
    """
    vocabulary = materialize(runs(docs, key, text, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences), "words")
    near = neighbours(vocabulary, cell_words)
    fits = F.col("best_n") >= times * F.col("n")
    done = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    done = materialize(done, "forms")
    roots = followed(done.where(F.col("form").isNotNull()))
    return done.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
