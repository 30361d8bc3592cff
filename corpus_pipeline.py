"""A corpus pipeline: toxicity, near-dedup, decontamination, secrets, packing.

Every stage works on all that its predecessor kept.  Null texts count as empty;
an empty table passes through every stage; repeated rows are copies, of which
the near-dedup stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash, packing, queries, secrets, toxicity
from tidemark.llm.common import Scratch, fresh, scope, table

#: SQL cannot express these stages; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    model = toxicity.train(queries.labelled(spark, sf_dir))
    limits = [F.when(F.col("lang") == lang, F.lit(t)) for lang, t in sorted((model.thresholds or {}).items())]
    name, = fresh(docs.columns, "score")
    scored = toxicity.score(docs, model, keep=docs.columns, score_col=name)
    return scored.where(F.col(name) < F.coalesce(*limits, F.lit(0.3))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return minhash.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    found = decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. No document goes."""
    found = secrets.ledger_scan(docs)
    spans = F.col(found.columns[-1])
    found = found.withColumn("text", secrets.redact(F.col("text"), spans))
    return found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path=queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again; what a stage leaves in the shared folder goes with it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
