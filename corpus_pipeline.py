"""A training-data pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read again as the next stage's
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, minhash, mixing, repetition, secrets
from barspark.llm.storage import stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: No source is seen more than twice; every document that comes this far is seen at least once.
MIX = mixing.Settings(most_epochs=2.0)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; of repeated rows, all stay or all go.

    Whole texts are judged, however long.  All columns stay as they are, whatever their names.
    """
    return repetition.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.  Of rows that repeat an id, all stay or all go; rows without one stay.

    Texts without words are like no other and stay.  All columns stay as they are, whatever their names.
    """
    gone = minhash.link(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out; the number of characters follows, if there is such a column, and is null for a null text.

    Null and empty texts, repeated rows and other columns stay as they are.
    """
    found = secrets.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as its source's weight asks for, once at least.

    A null source is a source of its own; null and empty texts have no words to weigh and are drawn with the others of their block.
    Repeated rows come equally often.  All columns stay as they are, also such as are named like those of mixing.
    """
    apart = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("epoch", "block", "place")}
    drawn = mixing.mix(docs.withColumnsRenamed(apart), MIX).drop("epoch", "block", "place")
    return drawn.withColumnsRenamed({v: k for k, v in apart.items()}).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and proof that they give the text again.  A null or empty text has no ids; every row has a row; other columns are left out."""
    coded = bpe.encode(docs, VOCABULARY)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the suffix-array verdicts, entropy spans and merges; tests hold the operators against plain versions and the stages against the operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
