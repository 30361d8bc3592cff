"""The queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, embedding_dedup, licenses, minhash, packing, secrets, sharding, substring, toxicity, url_filter
from tidemark.llm.common import Scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``/source/lang/thousand/hundred/id``; one that opens with a notice is its thousand's licence file."""
    docs = table(spark, sf_dir, "documents")
    opens = F.regexp_extract(F.coalesce("text", F.lit("")), "^[^\\n]*", 0).rlike("(?i)licensed under|released under")
    top = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string"))
    path = F.when(opens, F.concat(top, F.lit("/"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(top, F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), F.col("doc_id").cast("string")))
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, license_file=opens)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(spark, sf_dir)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a ledger of its own: every blob and rule is new to it, whatever other runs have scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.ledger_scan(docs, ledger=Scratch(spark, "secrets").path("ledger"))
    spans = F.col(found.columns[-1])
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    text = secrets.span_text(spans)
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text, 256).alias("base_sha256"), text.alias("spans"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def labelled(spark: SparkSession, sf_dir: str, rows: int = toxicity.Config().rows) -> DataFrame:
    """A sample of at most ``rows`` labels that may be learned (crc32(doc_id) mod 4 is not 2), with their texts.

    Labels are picked by hash before any text is read, so only picked texts move.
    """
    labels = table(spark, sf_dir, "labels").where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").alias("label"))
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    picked = labels.distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(toxicity.Config().seed)), "doc_id", "label").limit(rows)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.join(F.broadcast(picked), "doc_id").withColumnRenamed("doc_id", "key")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(labelled(spark, sf_dir))
    scored = toxicity.score(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path())


def queries() -> dict:
    found = [op1_license_scan, op2_kd_sharding, op3_decontamination, op4_embedding_dedup, op5_secret_scan, op6_substring_dedup,
             op7_toxicity, op8_url_filter, op9_minhash_dedup, op10_packing]
    return {f.__name__: f for f in found}
