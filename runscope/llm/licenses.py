"""License scans: an exact set-similarity join of text blocks with notices and license texts.

A block is a window of 2 * STEP words, a new one every STEP words, with STEP a
quarter more than the template's length at least, so any stretch of STEP words
lies whole in one.  The tokens of the templates are ordered by their document
frequency over all documents, rarest first.  A block can hold enough of a template
only if it shares a token of the template's prefix (prefix filter), has enough
tokens of templates at all (length filter), and enough are left behind the first
shared one (positional filter); the survivors are counted.  Only DataFrame
functions run.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runscope.llm.notices import TEMPLATES
from runscope.session import materialize

#: Part of a template's words that a block must hold, and of its pairs of words for a label; the smallest step of blocks.
THRESHOLD, ORDERED, STEP = 0.85, 0.6, 24

# Phrases that label a place by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text: digits, letters A-Z in lower case and everything beyond ASCII as it is; none for a null."""
    own = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(F.translate(own, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, _GAPS), "")


def template_words(text: str) -> list[str]:
    """The words of a template, by the same rule."""
    return [w for w in re.split(_GAPS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def pairs_of(words: list[str]) -> list[str]:
    """The words that follow each other, two by two; a single word is a pair by itself."""
    return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words))


def step_for(words: int) -> int:
    """Words from a block to the next for a template of so many: STEP doubled until a quarter more than the template fits."""
    step = STEP
    while step * 4 < words * 5:
        step *= 2
    return step


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(phrase: str) -> Column:
    """Every place in ``words`` where the phrase's words stand consecutively."""
    tokens = phrase.split()
    # the sequence is built only where the phrase occurs, so it is never empty
    found = F.filter(F.sequence(F.lit(0), F.size("words") - len(tokens)), lambda i: _all([F.get("words", i + k) == t for k, t in enumerate(tokens)]))
    return F.when(F.contains(F.concat(F.lit(" "), F.col("joined"), F.lit(" ")), F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def token_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The templates' tokens, rarest in documents first, equals by token; one row for each token comes to the driver."""
    shared = docs.select(F.explode(F.array_intersect(_literal(vocabulary), words_of(F.col(text)))).alias("token"))
    seen = {r["token"]: r["count"] for r in shared.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))


class Join:
    """The prepared templates of one scan: their tokens in global order, the index of their prefixes, the steps of their blocks."""

    def __init__(self, order: list[str], templates: tuple, threshold: float):
        at = {t: k for k, t in enumerate(order)}
        self.order = order
        self.sets = [sorted(set(template_words(t)), key=at.get) for *_, t in templates]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.steps = [step_for(len(template_words(t))) for *_, t in templates]
        self.prefixes = [s[: len(s) - n + 1] for s, n in zip(self.sets, self.need, strict=True)]
        self.pairs = [pairs_of(template_words(t)) for *_, t in templates]

    def tokens_of(self, step: int) -> list[str]:
        """Tokens of the templates whose blocks have this step, in global order."""
        mine = {t for s, k in zip(self.sets, self.steps, strict=True) if k == step for t in s}
        return [t for t in self.order if t in mine]

    def prefix_of(self, step: int) -> list[str]:
        mine = {t for p, k in zip(self.prefixes, self.steps, strict=True) if k == step for t in p}
        return [t for t in self.order if t in mine]

    def paired(self, step: int) -> list[str]:
        return sorted({p for pairs, k in zip(self.pairs, self.steps, strict=True) if k == step for p in pairs})

    def index(self) -> list[tuple]:
        return [(step, token, i, k, tokens, need, self.pairs[k]) for k, (tokens, need, step, prefix) in enumerate(zip(self.sets, self.need, self.steps, self.prefixes, strict=True)) for i, token in enumerate(prefix)]

    def blocks(self, words: Column) -> Column:
        """(step, block, own, pairs) of the blocks of a text that share a prefix token: ``own`` holds its template tokens in global order, ``pairs`` its pairs of words that templates have."""
        return F.concat(*[self._blocks_of(words, step) for step in sorted(set(self.steps))])

    def _blocks_of(self, words: Column, step: int) -> Column:
        tokens, prefix = _literal(self.tokens_of(step)), _literal(self.prefix_of(step))
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - step - 1, F.lit(0)), F.lit(step))
        cut = F.transform(starts, lambda s: F.struct(F.lit(step).alias("step"), s.alias("block"), F.array_intersect(tokens, F.slice(words, s + 1, 2 * step)).alias("own")))
        some = F.filter(cut, lambda b: F.arrays_overlap(b["own"], prefix))
        known = _literal(self.paired(step))
        two = lambda b: F.zip_with(F.slice(words, b["block"] + 1, 2 * step), F.slice(words, b["block"] + 2, 2 * step - 1), lambda x, y: F.concat_ws(" ", x, y))
        some = F.transform(some, lambda b: F.struct(b["step"].alias("step"), b["block"].alias("block"), b["own"].alias("own"), F.array_intersect(known, two(b)).alias("pairs")))
        return F.when(F.arrays_overlap(words, prefix), some).otherwise(F.array().cast("array<struct<step:int,block:int,own:array<string>,pairs:array<string>>>"))


def _met(blocks: DataFrame, keys: list[str], join: Join, templates: tuple) -> DataFrame:
    """(keys, step, block, template, label, containment, ordered) of rows (keys, step, block, own, pairs)."""
    index = blocks.sparkSession.createDataFrame(join.index(), "step int, token string, i int, template int, tokens array<string>, need int, in_order array<string>")
    probes = [F.struct(F.lit(step).alias("step"), _literal(join.prefix_of(step)).alias("prefix")) for step in sorted(set(join.steps))]
    prefix = F.filter(F.array(*probes), lambda p: p["step"] == F.col("step"))[0]["prefix"]
    pairs = blocks.withColumn("token", F.explode(F.array_intersect("own", prefix))).join(F.broadcast(index), ["step", "token"])
    left = F.least(F.size("tokens") - F.col("i"), F.size("own") - F.array_position("own", F.col("token")).cast("int") + 1)
    first = F.size(F.array_intersect(F.slice("tokens", F.lit(1), F.col("i")), F.col("own"))) == 0  # one row for a block and template
    shared = F.size(F.array_intersect("tokens", "own"))
    met = pairs.where((F.size("own") >= F.col("need")) & (left >= F.col("need")) & first).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    label = _literal([t[0] for t in templates])
    return met.select(*keys, "step", "block", "template", F.get(label, F.col("template")).alias("label"), (F.col("shared") / F.size("tokens")).alias("containment"), (F.size(F.array_intersect("in_order", "pairs")) / F.size("in_order")).alias("ordered"), "own")


def similar_blocks(docs: DataFrame, keys: list[str], text: str = "text", templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (keys, step, block, template, label, containment) at or above ``threshold``.

    ``block`` is the first word of the block, 2 * ``step`` words long.  ``templates``
    are (label, words, text) of a short list; a text of any length has blocks that
    hold it.  Null and empty texts have no block that is similar; repeated rows repeat
    theirs; an empty table gives no row.
    """
    join = Join(token_order(docs, sorted({w for *_, t in templates for w in template_words(t)}), text), templates, threshold)
    rows = docs.select(*keys, words_of(F.col(text)).alias("words"))
    return _met(rows.select(*keys, F.inline(join.blocks(F.col("words")))), keys, join, templates).drop("own", "ordered")


def _rivals(join: Join, templates: tuple) -> list[list[int]]:
    """For each template the ones of other labels that alone hold enough of it."""
    sets = [set(s) for s in join.sets]
    return [[u for u in range(len(sets)) if templates[u][0] != templates[t][0] and join.steps[u] == join.steps[t] and len(sets[t] & sets[u]) >= join.need[t]] for t in range(len(sets))]


def scan(docs: DataFrame, text: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Licenses of every whole text, one row for each row of ``docs`` (by doc_id).

    n_words, n_base (places of phrases), first_word and last_word (their smallest
    and largest start, null without one), base_labels, labels (with the joined
    templates' labels; distinct, sorted, joined by commas) and score, the largest
    containment (1 where a phrase stands).  A template gives its label where the
    block has the words that its label asks for and ORDERED of its pairs, unless a template of another label
    explains the block better: one that holds enough of this one's words by itself and
    is contained to a larger part, or to the same part with more words.  Null and
    empty texts have no words and no labels.  Repeated rows give repeated rows, rows
    of one doc_id with different texts are kept apart, an empty table gives no row,
    other columns are ignored.

    Texts are split once to count tokens and once for all else.
    """
    keyed = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    join = Join(token_order(keyed, sorted({w for *_, t in templates for w in template_words(t)})), templates, threshold)
    parts = keyed.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("joined", F.array_join("words", " "))
    parts = parts.select("doc_id", F.size("words").cast("long").alias("n_words"), *[_places(p).alias(f"p{k}") for k, (p, _) in enumerate(phrases)], join.blocks(F.col("words")).alias("blocks"))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    named = F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)])))
    base = parts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), named.alias("base"), "blocks",
    )
    base = materialize(base, "license_words")

    met = _met(base.where(F.size("blocks") > 0).select("row", F.inline("blocks")), ["row"], join, templates)
    asked = F.array(*[_literal(list(t[1])) for t in templates])
    met = met.where((F.size(F.array_except(F.get(asked, F.col("template")), F.col("own"))) == 0) & (F.col("ordered") >= ORDERED - 1e-9))
    # one row for each text and block, then for each text: both are small, a block having at most one row for each template
    by_block = met.groupBy("row", "step", "block").agg(F.collect_set(F.struct("template", "label", "containment")).alias("m"))
    rivals = F.array(*[F.array(*[F.lit(u) for u in r]).cast("array<int>") for r in _rivals(join, templates)])
    sizes = F.array(*[F.lit(len(s)) for s in join.sets])
    size = lambda x: F.get(sizes, x["template"])
    better = lambda x, y: F.array_contains(F.get(rivals, x["template"]), y["template"]) & ((y["containment"] > x["containment"]) | ((y["containment"] == x["containment"]) & (size(y) > size(x))))
    kept = F.filter("m", lambda x: ~F.exists("m", lambda y: better(x, y)))
    by_row = by_block.select("row", F.explode(kept).alias("m")).groupBy("row").agg(F.collect_set("m.label").alias("more"), F.max("m.containment").alias("most"))
    whole = base.drop("blocks").join(by_row, "row", "left")
    none = F.array().cast("array<string>")
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
