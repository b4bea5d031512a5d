"""SentencePiece encoding and decoding (merge-type models).

A text is cut at places that no vocabulary piece crosses, and each part is
encoded exactly by backtracking: an Aho-Corasick automaton gives the pieces that
start at each place, longest first; a piece may follow another only if merging
both again from single characters gives just these two pieces; places from which
no further piece is compatible are marked in a bit field and never tried again.
Encodings of short parts are remembered in a bounded table of the worker.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.llm.batches import fresh, map_batches, struct, texts_of

SPACE = "▁"
#: Parts remembered by a worker, and the longest part worth it.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Characters of a part from which on an integer would be too slow a bit field.
LONG_PART = 256
#: Characters that are cut off the end of a part where no piece joins them to what precedes.
TAILS = frozenset(".,;:!?%&$*#|\")")


class PieceEncoder:
    """Exact encoder of one merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece_of, self.score_of, self.id_of, self.byte_id = {}, {}, {}, {}
        joined: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece_of[i], self.score_of[piece], self.id_of[piece] = piece, sp.get_score(i), i
                self.automaton.add_word(piece, (len(piece), i))
                joined.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.automaton.make_automaton()
        self.longest_piece = max(map(len, self.id_of), default=1)
        self.size_of = [len(self.piece_of.get(i, "")) for i in range(sp.get_piece_size())]
        self.shorter = [next((self.id_of[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), -1) if (p := self.piece_of.get(i)) else -1 for i in range(sp.get_piece_size())]
        self.joined = joined  # neighbours inside some piece; between other characters a text may be cut
        self.unk = sp.unk_id()
        self.single = {c for c in self.id_of if len(c) == 1}
        self.has_newline = any("\n" in p for p in self.id_of)
        self.crosses = any(a != SPACE and b == SPACE for a, b in joined)
        self.other = re.compile(f"([{''.join(map(re.escape, sorted(self.single)))}]+)|(.)", re.S)
        self.compatible: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score_of.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def reached(self, piece: int) -> bool:
        """Whether merging yields the piece from its own characters."""
        known = self.reachable.get(piece)
        if known is None:
            known = self.reachable[piece] = self.merge(self.piece_of[piece]) == [self.piece_of[piece]]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether merging both pieces again from their characters gives just these two."""
        key = left << 24 | right
        known = self.compatible.get(key)
        if known is None:
            a, b = self.piece_of[left], self.piece_of[right]
            known = self.reached(left) and self.reached(right) and (a[-1] + b[0] not in self.joined or self.merge(a + b) == [a, b])
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def encode_part(self, part: str) -> list[int]:
        """A part's ids; characters that no piece has fall back to bytes."""
        if self.single.issuperset(part):
            return self._encode_known(part)
        out: list[int] = []
        for known, other in self.other.findall(part):
            if known:
                out += self._encode_known(known)
            else:
                out += [self.byte_id[b] for b in other.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]
        return out

    def _encode_known(self, part: str) -> list[int]:
        """Backtracking from the longest matches; a part of known characters only."""
        ids, at, left, stop = [], 0, -1, len(part)
        compatible, longest = self.compatible, self.automaton.iter_long
        piece = -1
        for _, (size, piece) in longest(part):
            if left >= 0:
                fits = compatible.get(left << 24 | piece)
                if not (self.follows(left, piece) if fits is None else fits):
                    break
            elif size == stop and not self.reached(piece):
                break
            ids.append(piece)
            at += size
            left = piece
        if at == stop:
            return ids
        if stop > LONG_PART:
            return self._backtrack_long(part, ids, at, piece)
        failed = 0  # bit field of places from which nothing compatible follows
        size_of, shorter = self.size_of, self.shorter
        while at < stop:
            size = size_of[piece]
            if not failed >> (at + size) & 1:
                if ids:
                    fits = compatible.get(ids[-1] << 24 | piece)
                    if fits is None:
                        fits = self.follows(ids[-1], piece)
                else:
                    fits = size < stop or self.reached(piece)
                if fits:
                    ids.append(piece)
                    at += size
                    if at < stop:
                        piece = next(longest(part, at))[1][1]
                    continue
            piece = shorter[piece]
            if piece < 0:
                if not ids:
                    return [self.id_of[p] for p in self.merge(part)]  # not reached for a merge-type model
                failed |= 1 << at
                piece = ids.pop()  # ends at a failed place: its shorter prefix is next
                at -= size_of[piece]
        return ids

    def _backtrack_long(self, part: str, ids: list[int], at: int, piece: int) -> list[int]:
        """The same for a long part, in linear time: the bit field is one of bytes, and only what the longest piece can span is looked at."""
        stop, failed, reach = len(part), bytearray((len(part) >> 3) + 1), self.longest_piece
        while at < stop:
            end = at + self.size_of[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (self.follows(ids[-1], piece) if ids else end < stop or self.reached(piece)):
                ids.append(piece)
                at = end
                if at < stop:
                    piece = next(self.automaton.iter_long(part[at : at + reach]))[1][1]
                continue
            piece = self.shorter[piece]
            if piece < 0:
                if not ids:
                    return [self.id_of[p] for p in self.merge(part)]  # not reached for a merge-type model
                failed[at >> 3] |= 1 << (at & 7)
                piece = ids.pop()
                at -= self.size_of[piece]
        return ids

    def encoded(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit integers, remembered for short parts."""
        known = self.cache.get(part)
        if known is None:
            stem = part
            tail: list[int] = []
            while len(stem) > 1 and stem[-1] in TAILS and stem[-2] + stem[-1] not in self.joined:
                tail[0:0] = self.encode_part(stem[-1])
                stem = stem[:-1]
            if tail:
                known = (self.cache.get(stem) or self.encoded(stem)) + array("i", tail).tobytes()
            else:
                known = array("i", self.encode_part(part)).tobytes()
            if len(part) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[part] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, with the model's leading space."""
        if not text:
            return b""
        if self.crosses or self.has_newline or not self.byte_id:
            return np.array(self.encode_part(SPACE + text.replace(" ", SPACE)), "<i4").tobytes()
        cache, encoded = self.cache, self.encoded
        text = text.replace(SPACE, " ")
        newline = np.array([self.byte_id[10]], "<i4").tobytes()
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(newline)
            else:
                line = " " + line
            if "  " in line or line[-1:] == " ":
                parts = re.findall(r" +[^ ]+|[^ ]+| +", line)
                parts = [p.replace(" ", SPACE) for p in parts]
            else:
                first, *rest = line.split(" ")
                parts = [SPACE + p for p in rest]
                if first:
                    parts.insert(0, first)
            for p in parts:
                out.append(cache.get(p) or encoded(p))
        return b"".join(out)


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a model file."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, decode: bool = True, names: tuple[str, str] = ("piece_ids", "decoded")) -> DataFrame:
    """Adds ``piece_ids`` and, if asked for, ``decoded`` (or other ``names``) to the columns ``keep`` (all others by default).

    Every whole text is encoded as the library's ``encode`` does, without begin
    or end ids, and decoded with its ``decode``.  A null text is an empty text:
    no ids, empty decoded text.  Repeated rows give repeated rows; an empty table
    an empty one; columns of ``docs`` named like the new ones are replaced.
    """
    new = list(names)[: 1 + decode]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(source_name := fresh(keep, "text")[0]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(new[0], T.ArrayType(T.IntegerType(), False)), *[T.StructField(n, T.StringType()) for n in new[1:]]])

    def make():
        enc = encoder(model)

        def run(batch: pa.RecordBatch):
            raw = [enc.encode(t) for t in texts_of(batch, source_name)]
            flat = np.frombuffer(b"".join(raw), "<i4")
            ends = np.cumsum([0, *[len(r) // 4 for r in raw]], dtype=np.int64)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)).cast(pa.list_(pa.field("element", pa.int32(), False)))
            cols = [batch.column(i) for i in range(len(keep))] + [ids]
            if decode:
                cols.append(pa.array(enc.processor.decode([flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], num_threads=1), pa.string()))
            return cols

        return run

    return map_batches(source, make, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of the contract, from the operator's ids and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
