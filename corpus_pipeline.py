"""A training corpus from raw documents: five stages, each a written table for the next."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import decontaminate, jaccard, langid, pieces, pii
from runscope.llm.batches import fresh
from runscope.llm.queries import vocabulary
from runscope.session import bounded_batches, materialize, read_table, scratch

#: A document this unlike every language's profile is rejected whatever its length, as one without letters is.
LEAST_LIKE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no learned language; the others get the language found as ``lang``.

    A document must be about as like its language as the least like of the labelled ones of its length.
    Where no document has a language to learn from, only those without a letter are rejected.  Null texts go;
    repeated rows stay or go together; all other columns stay as they are.
    """
    profiles = langid.trained_on(docs)
    if not profiles:
        return docs.where(F.rlike("text", F.lit(r"\p{L}")))
    return langid.of_language(docs, profiles, langid.least_scores(docs, profiles), LEAST_LIKE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by shingles of five words at similarity 0.8, the one with the smallest doc_id.

    Null and empty texts, having no words, are one group; of repeated rows one stays; an
    empty table gives no row; all other columns stay as they are (see ``jaccard.keep_one``).
    """
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts stay.

    Repeated rows stay or go together; an empty table of either kind drops nothing; all
    other columns stay as they are.
    """
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; ``n_chars`` follows the text.  Null texts stay; all other columns stay as they are."""
    (kinds,) = fresh(docs.columns, "pii_kinds")
    done = pii.pseudonymize(docs, kinds=kinds)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(kinds) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The columns that the last stage adds.
ENCODED = ("piece_ids", "n_tokens", "round_trip")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, ``n_tokens`` and whether decoding gives the text back.  A null text is encoded as an empty one.

    Texts of any length are encoded whole; repeated rows stay; an empty table gives no row.  A column of the input that is called like one of these stays as ``source_<name>``.
    """
    ids, decoded = fresh(docs.columns, "piece_ids", "decoded")
    done = pieces.encode_documents(docs, vocabulary("piece_bpe_32k.model"), names=(ids, decoded))
    clash = [c for c in docs.columns if c.lower() in ENCODED]
    renamed = dict(zip(clash, fresh([*docs.columns, *ENCODED], *[f"source_{c}" for c in clash]), strict=True))
    own = [F.col(f"`{c}`").alias(renamed.get(c, c)) for c in docs.columns]
    return done.select(*own, F.col(ids).alias("piece_ids"), F.size(ids).cast("long").alias("n_tokens"), (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("round_trip"))


def _bounded(stage):
    """The stage in a session whose Arrow batches are small enough for whole texts."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language ID", _bounded(language)),
    ("SimHash near-dedup", _bounded(near_duplicates)),
    ("benchmark decontamination", _bounded(benchmark_leaks)),
    ("PII surrogates", _bounded(personal_data)),
    ("SentencePiece encoding", _bounded(encode)),
]

#: No stage can be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what a stage wrote besides its result goes as soon as the result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
