"""Token ids of the word-end tokenizer, by the tokenizers library, word by word.

The tokenizer drops white space and never joins words across it, so each
distinct word is tokenized once per worker by the library's own model and
remembered in a bounded table.  Texts in which the word rule would not hold
(special tokens, characters whose lower case depends on the context, control
characters that only Python counts as space) go to the library whole.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

CACHE_ENTRIES, CACHE_CHARS = 600_000, 40
#: Sigma and dotted I change with their neighbours; the control characters are space for Python alone.
ODD = ("Σ", "İ", "\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")


class WordTokenizer:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.cache: dict[str, bytes] = {}
        self.shown: dict[int, str] = {}

    def _word(self, word: str) -> bytes:
        known = self.cache.get(word)
        if known is None:
            text = word
            if not (word.isascii() and word.isprintable()):
                for c in set(word):
                    if ord(c) not in self.shown:
                        self.shown[ord(c)] = c if c.isascii() and c.isprintable() else self.bytes_of.pre_tokenize_str(c)[0][0]
                text = word.translate(self.shown)
            known = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            self._remember(word, known)
        return known

    def _remember(self, key: str, ids: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[key] = ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[-1] in ".,!" and chunk[:-1].isalpha():  # what the pattern would find
            ids = (self.cache.get(chunk[:-1]) or self._word(chunk[:-1])) + self._word(chunk[-1])
        else:
            ids = b"".join([self._word(w) for w in self.words.findall(chunk)])
        self._remember(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in ODD):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        cache, chunk = self.cache, self._chunk
        return b"".join([cache.get(c) or chunk(c) for c in text.lower().split()])


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a file."""
    return WordTokenizer(path)
