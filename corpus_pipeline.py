"""The corpus pipeline: five stages, each over all that its predecessor kept.

Language ID drops documents that no language can be told of and labels the others; SimHash near-dedup keeps one
document of each group; substring dedup takes out passages that occur earlier; personal data
is replaced by its kind; best-fit packing assigns the pieces of all documents to sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, packing, pii, simhash, substring_dedup
from quire.llm._spark import materialize

#: The columns that all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told, and in ``lang`` that language, whatever they
    declare. Null texts, texts without a letter and texts that suit no learned language go."""
    model = langid.fit(docs, kind=langid.StrictModel)
    others = [c for c in COLUMNS if c not in ("text", "lang")]
    kept = docs.select(*others, F.col("text").alias("__text"), F.col("text"))
    found = langid.predict(kept, model, keep=[*others, "__text"])
    return found.where(F.col("lang_pred") != langid.UND).select(*others, F.col("__text").alias("text"), F.col("lang_pred").alias("lang")).select(*COLUMNS)


#: Radius and number of fingerprints of near-dedup, as operator 7 has them. Five bits in any of
#: three find more near copies; the README says why they are not taken.
RADIUS, PRINTS = 3, 1


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    return simhash.keep_one(docs, bits=RADIUS, prints=PRINTS).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of twenty words or more that occur earlier."""
    return _measured(substring_dedup.remove_repeats(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _measured(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("pii", private), ("best_fit_packing", pack)]

#: The models of the stages have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
