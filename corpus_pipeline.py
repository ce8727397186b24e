"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

1. toxicity: documents that the classifier rejects go.
2. exact dedup: of documents with the same text, the one with the largest id stays.
3. near-dedup: of documents linked at a similarity of 0.8 over five-word shingles, the smallest id stays.
4. secrets: spans found are replaced in the text; all documents stay.
5. packing: the tokenised texts in sequences of 1024 ids.

All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, minhash_dedup, packing, secret_scan, toxicity
from lectern.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay unless a third of the sample is toxic; repeated rows go or stay together; without
    labels all rows stay; an empty table gives none."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, net).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null counts as empty, so one null or empty text stays. Rows that repeat the id that stays, with its text,
    are that document and all stay. Rows without id go beside one that has an id. An empty table gives none."""
    return exact_dedup.exact_dedup(docs, keep="max").where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and blank texts link with nothing and stay, as do rows without id. Rows that share an id are
    one document and go or stay together. An empty table gives none."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; null texts stay null; n_chars is counted anew where a text changed. An empty table gives none."""
    return secret_scan.redact(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are their separator; repeated rows are packed as often as they occur. An empty table
    gives none."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: Scores of a trained network and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
