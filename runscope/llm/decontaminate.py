"""Benchmark decontamination by the q-gram lemma.

A window of m compared characters of a benchmark item that stands in a document
with at most k edits shares at least m + 1 - Q * (k + 1) of its q-grams with it,
all on diagonals (place in the document less place in the item) that differ by at
most k.  All q-grams of whole items are indexed.  Shared ones are counted in bands
of diagonals that overlap by half; where enough lie within a window's length, the
region is retained and verified by banded alignment over every window of it.
Items shorter than a window are one window by themselves, those too short for a
q-gram must stand unedited on word bounds.  Texts are compared in lower case,
every run of other characters than letters and digits as one space.
"""

from __future__ import annotations

import contextlib
import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from runscope.llm.batches import BATCH_ROWS, struct
from runscope.session import materialize

#: Characters of a q-gram, of a window, and for each of which a window may have an edit.
Q, WINDOW, EDIT_CHARS = 12, 50, 25
#: Diagonals that bands are apart (a band has twice as many; no fewer than the edits of a window).
BAND = 4
#: Compared characters from which an unedited fragment of an item is found wherever it begins.
SURE = WINDOW
#: Characters of benchmark items that tasks hold at once; a larger benchmark is searched in blocks.
BLOCK_CHARS = 4_000_000
#: Postings expanded at once, windows of a region verified together, and regions aligned at once.
POSTINGS, REGION, ROWS = 2_000_000, 256, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Stand for what is beyond a text and beyond an item; they equal no character and not each other.
_NO_TEXT, _NO_ITEM = np.uint32(0), np.uint32(1)


@lru_cache(1)
def _kept() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points compared, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    word = _kept()[c]
    stay = word.copy()
    stay[1:] |= word[:-1]  # one space behind each word
    at = np.flatnonzero(stay)
    return np.where(word[at], c[at], 32).astype(np.uint64), at


def gram_codes(c: np.ndarray) -> np.ndarray:
    """Rolling hash of the Q characters from each place."""
    with np.errstate(over="ignore"):
        power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
        two = c[:-1] * _BASE + c[1:]
        four = two[:-2] * power(2) + two[2:]
        eight = four[:-4] * power(4) + four[4:]
        return (eight[:-4] * power(4) + four[8:]) * _BASE


def budget(size: np.ndarray) -> np.ndarray:
    """Edits that a window of ``size`` characters may have; few enough that the lemma asks for one q-gram at least."""
    size = np.asarray(size, np.int64)
    return np.maximum(0, np.minimum(size // EDIT_CHARS, size // Q - 1))


class Index:
    """Q-gram index of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        #: The item of each text; the compared characters of all texts end to end, and where each begins and ends.
        self.items: list[int] = []
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        parts, sizes = [], []
        for item, text in items:
            c, _ = normalized(text or "")
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if len(c) >= Q:
                self.items.append(item)
                parts.append(c)
                sizes.append(len(c))
            elif len(c):
                self.short.setdefault(len(c), {}).setdefault(tuple(c.tolist()), []).append(item)
        sizes = np.array(sizes, np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.size, self.window = sizes, np.minimum(sizes, WINDOW)
        self.edits = budget(self.window)
        self.bound = self.window + 1 - Q * (self.edits + 1)
        self.chars = np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)
        grams = np.concatenate([gram_codes(p) for p in parts]) if parts else np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(parts)), sizes - Q + 1)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes - Q + 1) - (sizes - Q + 1), sizes - Q + 1)
        order = np.argsort(grams, kind="stable")
        self.grams, self.text, self.place = grams[order], text[order].astype(np.int32), place[order].astype(np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.grams >> np.uint64(64 - _BITS)] = True

    def regions(self, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, lowest diagonal, highest, first window, last window) of every region whose q-grams reach the bound, without repeats.

        Postings are expanded in blocks of
        document places that overlap by more than a window, so that memory is bounded
        however many items share a phrase, and every region lies whole in a block.
        """
        none = np.zeros(0, np.int64)
        if len(c) < Q or not len(self.grams):
            return (none,) * 5
        codes = gram_codes(c)
        at = np.flatnonzero(self.seen[codes >> np.uint64(64 - _BITS)])
        low = np.searchsorted(self.grams, codes[at], "left")
        n = np.searchsorted(self.grams, codes[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends = np.cumsum(n)
        found, begin = [], 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + POSTINGS, "right")))
            behind = int(np.searchsorted(at, at[stop - 1] + 2 * WINDOW, "right"))
            found.append(self._counted(at[begin:behind], low[begin:behind], n[begin:behind]))
            begin = stop
        if not found:
            return (none,) * 5
        key = np.unique(np.concatenate(found, axis=1), axis=1) if len(found) > 1 else found[0]
        return tuple(key)

    def _counted(self, at: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, place = self.text[hit].astype(np.int64), self.place[hit].astype(np.int64)
        diagonal = np.repeat(at, n) - place
        band = diagonal // BAND  # band b holds 2 * BAND diagonals from b * BAND on
        text, place, diagonal, band = np.tile(text, 2), np.tile(place, 2), np.tile(diagonal, 2), np.concatenate([band, band - 1])
        order = _order(text, band, place)
        text, place, diagonal, band = text[order], place[order], diagonal[order], band[order]
        # the first of so many q-grams as the bound asks for, and the last: within one window of the item?
        last = np.arange(len(text)) + self.bound[text] - 1
        inside = last < len(text)
        last = np.where(inside, last, 0)
        fits = inside & (text[last] == text) & (band[last] == band) & (place[last] - place <= self.window[text] - Q)
        first, last = np.flatnonzero(fits), last[fits]
        text, band = text[first], band[first]
        a = np.maximum(0, place[last] - (self.window[text] - Q))
        b = np.minimum(place[first], self.size[text] - self.window[text])
        keep = a <= b
        text, band, a, b, first, last = text[keep], band[keep], a[keep], b[keep], first[keep], last[keep]
        if not len(text):
            return np.zeros((5, 0), np.int64)
        # windows of one text and band that follow each other are a region, cut to REGION windows at most
        head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (band[1:] != band[:-1]) | (a[1:] > b[:-1] + 1)]))
        tail = np.append(head[1:], len(text)) - 1
        text, a, b = text[head], np.minimum.reduceat(a, head), np.maximum.reduceat(b, head)
        ends = np.stack([first[head], last[tail] + 1], axis=1).reshape(-1)
        diagonal = np.append(diagonal, 0)
        low, high = np.minimum.reduceat(diagonal, ends)[::2], np.maximum.reduceat(diagonal, ends)[::2]
        cuts = (b - a) // REGION + 1
        step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        a = np.repeat(a, cuts) + step * REGION
        found = np.stack([np.repeat(text, cuts), np.repeat(low, cuts), np.repeat(high, cuts), a, np.minimum(np.repeat(b, cuts), a + REGION - 1)])
        return np.unique(found, axis=1)  # both bands of the same q-grams give one region


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places in order of the keys, the first one first; as one number where they fit."""
    code, room = np.zeros(len(keys[0]), np.int64), 1
    for k in keys:
        low = int(k.min()) if len(k) else 0
        size = int(k.max()) - low + 1 if len(k) else 1
        room *= size
        if room >= 1 << 62:
            return np.lexsort(keys[::-1])
        code = code * size + (k - low)
    return np.argsort(code, kind="stable")


def reach(item: np.ndarray, text: np.ndarray, edits: int, width: int) -> np.ndarray:
    """How far each place gets: [k, row, place, diagonal] is the most item characters from there on with at most k edits.

    Row r of ``text`` holds the document from the place on that faces the first
    character of row r of ``item`` on the lowest of ``width`` diagonals.
    """
    rows, size = item.shape
    out = np.zeros((edits + 1, rows, size + 1, width), np.int16)
    far = np.full((rows, 1), -1, np.int16)
    for o in range(size - 1, -1, -1):
        same = text[:, o : o + width] == item[:, o : o + 1]
        for k in range(edits + 1):
            on = out[k, :, o + 1] + 1
            if not k:
                out[0, :, o] = np.where(same, on, 0)
                continue
            less = out[k - 1, :, o + 1] + 1  # another character
            dropped = np.concatenate([far, less[:, :-1]], axis=1)  # the item's is missing
            added = np.concatenate([out[k - 1, :, o, 1:], far], axis=1)  # the document has one more
            out[k, :, o] = np.where(same, on, np.maximum(np.maximum(less, dropped), added))
    return out


def _best(index: Index, c: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(row, edits, begin, end) of those regions that hold a window within its budget; the span is that of the windows with the fewest edits."""
    out = ([], [], [], [])
    sizes = rows[4] - rows[3]
    kinds = (rows[2] - rows[1]) << 32 | index.edits[rows[0]] << 16 | index.window[rows[0]]
    for kind in np.unique(kinds):
        own = np.flatnonzero(kinds == kind)
        own = own[np.argsort(sizes[own], kind="stable")]
        k, m = int(kind >> 16) & 0xFFFF, int(kind & 0xFFFF)
        width = int(kind >> 32) + 1 + 2 * k
        at = 0
        while at < len(own):
            long_ = m + k + int(sizes[own[at]]) * 5 // 4 + 16  # rows of about one size together
            part = own[at : at + max(1, min(ROWS * 64 // long_, int(np.searchsorted(sizes[own], long_ - m - k, "right")) - at))]
            at += len(part)
            span = m + k + int(sizes[part].max())
            text, low, _, a, b = (r[part] for r in rows)
            low = low + a - k  # the document's place on the lowest diagonal
            inside = a[:, None] + np.arange(span)
            item = np.where(inside < index.size[text][:, None], index.chars[np.minimum(index.start[text][:, None] + inside, len(index.chars) - 1)], _NO_ITEM)
            there = low[:, None] + np.arange(span + width)
            doc = np.where((there >= 0) & (there < len(c)), c[np.clip(there, 0, len(c) - 1)], _NO_TEXT)
            window = np.arange(span + 1)[None, :, None] <= (b - a)[:, None, None]
            good = np.stack([(r >= m) & window for r in reach(item, doc, k, width)])
            any_ = good.any(axis=(2, 3))
            hit = np.flatnonzero(any_.any(axis=0))
            if not len(hit):
                continue
            fewest = any_[:, hit].argmax(axis=0)
            starts = good[fewest, hit]
            where = np.arange(span + 1)[None, :, None] + np.arange(width)[None, None, :]
            begin = low[hit] + np.where(starts, where, 1 << 30).min(axis=(1, 2))
            # the ends: the same from behind, over the stretch of item that the windows found cover
            first, final = starts.any(axis=2).argmax(axis=1), span - starts.any(axis=2)[:, ::-1].argmax(axis=1)
            over = final - first + m
            most = int(over.max())
            back = (first + over)[:, None] - 1 - np.arange(most)
            item2 = np.where(back >= first[:, None], np.take_along_axis(item[hit], np.maximum(back, 0), 1), _NO_ITEM)
            high = low[hit] + first + over + width - 2  # the last place on the highest diagonal, seen from behind
            there = high[:, None] - np.arange(most + width)
            doc2 = np.where((there >= 0) & (there < len(c)), c[np.clip(there, 0, len(c) - 1)], _NO_TEXT)
            ends = reach(item2, doc2, k, width)[fewest, np.arange(len(hit))] >= m
            ends &= np.arange(most + 1)[None, :, None] <= (over - m)[:, None, None]
            back = np.arange(most + 1)[None, :, None] + np.arange(width)[None, None, :]
            end = high - np.where(ends, back, 1 << 30).min(axis=(1, 2)) + 1
            for o, v in zip(out, (part[hit], fewest, begin, end), strict=True):
                o.append(v)
    return tuple(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out)


def _short_matches(index: Index, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end) of every place where an item of fewer than Q characters stands on word bounds."""
    word = c > 32
    for size, wanted in index.short.items():
        if len(c) < size:
            continue
        codes = c[: len(c) - size + 1].copy()
        hashed = {}
        with np.errstate(over="ignore"):
            for k in range(1, size):
                codes = codes * _BASE + c[k : len(c) - size + 1 + k]
            for chars in wanted:
                h = np.uint64(0)
                for x in chars:
                    h = h * _BASE + np.uint64(x)
                hashed[int(h)] = chars
        edge = np.append(word, False)
        before = np.concatenate([[False], word])
        for at in np.flatnonzero(np.isin(codes, np.array(list(hashed), np.uint64)) & ~before[: len(codes)] & ~edge[size : size + len(codes)]).tolist():
            chars = hashed[int(codes[at])]
            if tuple(c[at : at + size].tolist()) == chars:
                for item in wanted[chars]:
                    yield item, at, at + size


def search(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) for each text and item with a window within its budget.

    edits is the fewest of a window; begin and end span the item's windows with so
    few edits, in characters of the text.  Texts are laid end to end with gaps that
    no window crosses.
    """
    parts, places, starts, at = [], [], [], 0
    gap = np.zeros(Q, np.uint64)
    for t in texts:
        c, where = normalized(t or "")
        starts.append(at)
        parts += [c, gap]
        places.append(where)
        at += len(c) + Q
    if not parts:
        return []
    c = np.concatenate(parts)
    starts = np.array(starts)
    rows = index.regions(c)
    hits = []
    if len(rows[0]):
        row, edits, begin, end = _best(index, c.astype(np.uint32), rows)
        hits = [(index.items[t], *v) for t, *v in zip(rows[0][row].tolist(), edits.tolist(), begin.tolist(), end.tolist(), strict=True)]
    hits += [(item, 0, b, e) for item, b, e in _short_matches(index, c)] if index.short else []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, edits, begin, end in hits:
        text = int(np.searchsorted(starts, begin + (end - begin) // 2, "right")) - 1
        begin, end = max(begin - int(starts[text]), 0), min(end - int(starts[text]), len(places[text]))
        have = found.get((text, item))
        if have is None or edits < have[0]:
            found[text, item] = (edits, begin, end)
        elif edits == have[0]:
            found[text, item] = (edits, min(begin, have[1]), max(end, have[2]))
    return [(t, i, int(places[t][b]), int(places[t][e - 1]) + 1, k) for (t, i), (k, b, e) in sorted(found.items())]


class Blocks:
    """The benchmark's index in blocks of about BLOCK_CHARS characters; the texts of an item are in one block.

    One block goes to the tasks as items, and a worker builds its index once.  Of several
    the indexes are built by tasks, written, and handed to all as they are, so that a
    worker holds one after the other, whatever their number.
    """

    def __init__(self, benchmark: DataFrame, chars: int | None = None):
        spark = benchmark.sparkSession
        chars = chars or BLOCK_CHARS
        items = benchmark.select("item_id", "text").where("text is not null and item_id is not null").distinct()
        n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars)
        self.name = uuid.uuid4().hex
        if n <= 1:
            self.held = [spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.sort("item_id", "text").collect()])] if n else []  # BLOCK_CHARS at most
            return

        def built(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))
            return pa.table({"index": pa.array([pickle.dumps(Index(rows))], pa.binary())})

        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        made = materialize(dealt.groupBy("block").applyInArrow(built, "index binary"), "leak_index")
        self.held = [spark.sparkContext.broadcast(pickle.loads(r["index"])) for r in made.toLocalIterator()]  # the driver holds one at a time

    def __iter__(self) -> Iterator[Index]:
        """In a task: one index after the other, the one before let go."""
        if len(self.held) == 1:
            yield _index_of(self.name, self.held[0])
            return
        for block in self.held:
            yield block.value
            with contextlib.suppress(AttributeError):
                del block._value  # what a worker keeps of a broadcast it has read


_ready: dict[str, Index] = {}


def _index_of(name: str, block) -> Index:
    """The worker's index of a single broadcast block."""
    if name not in _ready:
        _ready.clear()
        value = block.value
        _ready[name] = value if isinstance(value, Index) else Index(value)
    return _ready[name]


MATCHES = (("item_id", T.LongType()), ("begin", T.IntegerType()), ("end", T.IntegerType()), ("edits", T.IntegerType()))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, begin, end, edits): every row of ``docs`` that holds a window of an item.

    A window is any WINDOW compared characters of an item, or the whole of a shorter
    one; it may have an edit for every 25 characters, so every stretch of 100
    characters with five edits or fewer holds one, and so does every fragment of SURE
    unedited characters (some nine words).  An item of fewer than Q compared
    characters must stand unedited on word bounds; one without any cannot be found.
    Null and empty texts hold nothing; repeated rows repeat their matches; an empty
    table of either kind gives no row; rows of one item_id are one item; other
    columns are ignored.

    Documents are read once, by one worker a task, whatever the benchmark's size (see
    ``Blocks``).
    """
    held = Blocks(benchmark)
    schema = struct(("doc_id", docs.schema["doc_id"].dataType), *MATCHES)
    if not held.held:
        return docs.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for index in held:
                for at in range(0, len(texts), BATCH_ROWS):
                    if hits := search(index, texts[at : at + BATCH_ROWS]):
                        cols = [b.column(0).take(pa.array([at + h[0] for h in hits], pa.int64())), *[[h[k] for h in hits] for k in range(1, 5)]]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark (see ``matches``), with all their columns.

    Each row is judged where it lies by its own text: null and empty texts stay,
    repeated rows stay or go together; an empty table of either kind drops nothing.
    """
    held = Blocks(benchmark)
    if not held.held:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            stay = np.ones(len(texts), bool)
            for index in held:
                for k in range(0, len(texts), BATCH_ROWS):
                    own = k + np.flatnonzero(stay[k : k + BATCH_ROWS])
                    stay[[own[h[0]] for h in search(index, [texts[i] for i in own])]] = False
            yield b.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
