"""Assessors against human labels: metrics and release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.schemas import LABEL


def read_labels(spark, path: str) -> DataFrame:
    return spark.read.schema(LABEL).json(path)


def read_model_outputs(spark, path: str, schema: str) -> DataFrame:
    """Stored answers, for replays without a model."""
    return spark.read.schema(schema).json(path) if path.endswith("json") else spark.read.schema(schema).parquet(path)


def eval_join(predictions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined rows with label_ columns, labels that no prediction answers)."""
    named = labels.select("session_id", *[F.col(c).alias(f"label_{c}") for c in labels.columns if c != "session_id"])
    return predictions.join(named, "session_id"), labels.join(predictions.select("session_id"), "session_id", "left_anti")


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def attention_metrics(joined: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall of needs_attention against label_needs_attention."""
    p, y = F.col("needs_attention"), F.col("label_needs_attention")
    out = joined.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    return out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def confusion(joined: DataFrame) -> DataFrame:
    return joined.groupBy("label_status", "status").agg(F.count("*").alias("n"))


def class_f1(joined: DataFrame) -> DataFrame:
    """tp, fp, fn and F1 of each status that is labelled or predicted."""
    pairs = confusion(joined)
    own = pairs.select(F.col("status").alias("c"), F.when(F.col("status") == F.col("label_status"), F.col("n")).otherwise(0).alias("tp"), F.when(F.col("status") != F.col("label_status"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn"))
    missed = pairs.where("status <> label_status").select(F.col("label_status").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("fn"))
    out = own.unionByName(missed).groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return out.withColumn("f1", F.coalesce(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(joined: DataFrame) -> DataFrame:
    return class_f1(joined).agg(F.count("*").alias("n_classes"), F.avg("f1").alias("macro_f1"))


def false_rates(joined: DataFrame) -> DataFrame:
    """False escalations of sessions that need no attention, and false attention on healthy ones."""
    calm = ~F.col("label_needs_attention")
    healthy = F.col("label_outcome_class") == "healthy"
    return joined.agg(
        _ratio(F.count_if(calm & F.col("escalated")), F.count_if(calm)).alias("false_escalation_rate"), _ratio(F.count_if(healthy & F.col("needs_attention")), F.count_if(healthy)).alias("false_attention_rate")
    )


def factuality(joined: DataFrame) -> DataFrame:
    """Share of summaries that a human called factual; nothing is judged automatically."""
    return joined.where("label_factual is not null").agg(F.count("*").alias("n"), F.avg(F.col("label_factual").cast("double")).alias("factuality"))


def class_distribution(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(outcome_class, n, target, missing) against the corpus targets (outcome_class, target)."""
    have = labels.groupBy("outcome_class").agg(F.count("*").alias("n"))
    out = targets.join(have, "outcome_class", "full_outer").fillna(0, ["n", "target"])
    return out.withColumn("missing", F.greatest(F.col("target") - F.col("n"), F.lit(0)))


def smoke(labels: DataFrame, n: int = 5, key: str = "session_id") -> DataFrame:
    """A fixed small sample, by hash of the key."""
    return labels.orderBy(F.sha2(F.col(key).cast("string"), 256)).limit(n)


def call_stats(calls: DataFrame, exact: bool = False) -> DataFrame:
    """Calls, failures, latency and tokens of each assessor; exact percentiles only where the input is small."""
    quantile = F.percentile if exact else F.percentile_approx
    return calls.groupBy("assessor").agg(
        F.count("*").alias("n"), F.count_if(F.col("call_status") != "ok").alias("n_failed"), F.avg("latency_ms").alias("avg_latency_ms"),
        quantile("latency_ms", 0.5).alias("p50_latency_ms"), quantile("latency_ms", 0.95).alias("p95_latency_ms"), F.sum("input_tokens").alias("input_tokens"),
    )


def release_gates(metrics: DataFrame) -> DataFrame:
    """(gate, value, threshold, pass) from one row: unsupported_citations, anomaly_recall, false_attention_rate, strong_gain.

    A gate without a value fails; a failed last gate turns the strong assessor off.
    """
    gates = [("unsupported_citations", "unsupported_citations", 0.0, -1), ("anomaly_recall", "anomaly_recall", 0.90, 1), ("false_attention_rate", "false_attention_rate", 0.15, -1), ("strong_gain", "strong_gain", 0.10, 1)]
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(s).alias("side")) for g, c, t, s in gates])
    out = metrics.select(F.explode(rows).alias("g")).select("g.*")
    met = F.when(F.col("side") > 0, F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return out.select("gate", "value", "threshold", F.coalesce(met, F.lit(False)).alias("pass"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256) of binary files (``spark.read.format('binaryFile')``)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def check_manifest(frozen: DataFrame, files: DataFrame) -> DataFrame:
    """Frozen entries that are missing or changed."""
    return frozen.join(manifest(files), ["path", "sha256"], "left_anti")


def export_corpus(ev: DataFrame, provenance: DataFrame, salt: str) -> DataFrame:
    """Redacted, pseudonymous events of the sessions whose provenance is complete (authority, source, consent), in order."""
    from runscope.functions import redaction as R
    from runscope.functions import text as X
    from runscope.operators.events import ORDER

    fine = provenance.where("authority is not null and source is not null and consent").select("session_id").distinct()
    out = ev.join(fine, "session_id", "left_semi").withColumn("summary", R.redact(F.col("summary"))).withColumn("path", X.pseudonymize(F.col("path"), salt))
    out = out.withColumn("source_path", X.pseudonymize(F.col("source_path"), salt))
    return out.repartitionByRange("session_id").sortWithinPartitions("session_id", *ORDER)
