"""A training-data pipeline over ``documents``: filter, dedup, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir), works on everything that its
predecessor kept, and is written as Parquet and read again before the next.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, minhash, pii, toxicity
from quarry.llm.common import read
from quarry.session import ensure_checkpoint_dir

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a struct of the other columns, whose names then cannot meet those of a stage."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(0)).alias("row"))


def _unpacked(done: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them with a new value."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row")[c] for c in docs.columns}
    return done.select(*[changed.get(c, own[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, rejects go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs), model, keep=True).where(F.col("_score") < 0.5), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows with the same id count as one document; of those with equal texts one
    stays.  Rows without an id stay.
    """
    kept = minhash.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    one = (_packed(docs).where("doc_id is not null").join(kept, "doc_id", "left_semi")
           .groupBy("doc_id", F.sha2("text", 256)).agg(F.min_by(F.struct("text", "row"), F.to_json(F.struct("row"))).alias("r"))
           .select("doc_id", "r.*"))
    return _unpacked(one.unionByName(_packed(docs).where("doc_id is null")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.contaminated_items(_packed(docs), read(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("_items") == 0), docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by marks such as <EMAIL>; n_chars follows the new text."""
    found = pii.find_pii(_packed(docs))
    out = _unpacked(found, docs, text=pii.redact(found))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, bpe.vocabulary_path("byte_bpe_50k.json"), ids=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

# Model fitting and BPE are not expressible in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
