"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret
redaction and packing, each stage over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the folder in spark.checkpoint.dir (the warehouse where it is unset) and rereads them, so
a lost executor costs no more than the stage it was in. All stages but the last return the
columns of ``documents``, extra columns included.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm._common import settle
from loomdex.llm.decontamination import drop_contaminated
from loomdex.llm.language_id import UNDECIDED, fit, identify
from loomdex.llm.ngram_join import jaccard_components
from loomdex.llm.packing import pack_documents
from loomdex.llm.queries import tokenizer
from loomdex.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language can be told: null, empty or without a letter.

    The trees learn from the labelled rows of ``docs`` themselves; where there are none,
    every text with a letter stays. Null labels and ids, ties and repeated rows are no reason
    to drop a row; an empty table stays empty.
    """
    trees = fit(docs.select("doc_id", "text", "lang"))
    if not trees.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = identify(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in ("lang_pred", "score")}), trees)
    kept = judged.where(F.col("lang_pred") != UNDECIDED)
    return kept.select(*[F.col(f"_own_{c}" if c in ("lang_pred", "score") else c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles at a Jaccard similarity of 0.8 link.

    The smallest id stays; of rows that repeat an id, one. Rows with a null id stay (they
    belong to no group), and so do texts without a word.
    """
    found = settle(jaccard_components(docs, k=5, percent=80).groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("component_id") != F.col("doc_id")).cast("int")).alias("gone")))
    drop = found.where("doc_id IS NOT NULL AND (gone = 1 OR n > 1)").select("doc_id")
    once = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id IS NOT NULL AND gone = 0 AND n > 1").select("doc_id")
    many = docs.join(F.broadcast(repeated) if repeated.count() <= 10_000 else repeated, "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(many.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("r")).select("r.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, re-parameterised or not. Null texts stay."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), runs=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and puts [SECRET] in place of its secrets; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row for each piece, ids as little-endian unsigned 32-bit binary."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Language ID, decontamination and packing can't be said in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{where.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
