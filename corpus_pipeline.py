"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sagebrook.llm import exact_dedup, language_id, packing, simhash, toxicity


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a likely language go.

    A null or empty text stays if its declaration and source name a language; null declarations are no evidence. Repeated rows share a
    decision, of equally likely languages the first by name wins; an empty table stays empty, other columns pass through.
    """
    return language_id.drop_unidentified(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that score one half or more go.

    A null or empty text has the score of no evidence and stays where toxic documents are the fewer. Repeated rows go or stay together; null ids
    only mean no label; an empty table stays empty, other columns pass through.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays.

    Null texts equal empty ones; a null id is smaller than any other; of rows that repeat both id and text one stays. An empty
    table stays empty, other columns pass through.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays, the smallest doc_id.

    Texts without words, null ones too, share the fingerprint zero and are one group. Decisions fall by id and text together; an empty
    table stays empty, other columns pass through.
    """
    return simhash.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row for each piece of a document, with its sequence and place.

    A null or empty text is a piece of its end token alone. Repeated rows are packed as often as they are there; ties go by id. An empty table gives
    no pieces; other columns play no part.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identified),
    ("toxicity", not_toxic),
    ("exact dedup", unique_texts),
    ("SimHash near-dedup", unlike_texts),
    ("packing", packed),
]

#: SQL can't express the trained models, the fingerprints and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, on ``documents``; each but the last is stored for the next."""
    from sagebrook.llm.common import stored

    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, out, sf_dir)
