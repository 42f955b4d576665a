"""A training corpus from documents: filter, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from tickloom.llm.common import table

    return table(spark, sf_dir, name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.3 or more."""
    from tickloom.llm.quality import keep_good

    return keep_good(docs, _table(spark, sf_dir, "labels"), 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    from tickloom.llm.exactdedup import keep_first

    return keep_first(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8, the row with the smallest doc_id."""
    from tickloom.llm.setsketch import keep_representatives

    return keep_representatives(spark, docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without ten consecutive words of a benchmark item."""
    from tickloom.llm.decontam import remove_documents

    return remove_documents(spark, docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte spans in the text, and the text decoded from the ids."""
    import public_tokenizers

    from tickloom.llm.spm import encode_decode

    return encode_decode(spark, docs, public_tokenizers.path("piece_bpe_32k.model"), ("ids", "begins", "ends", "decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece encoding and decoding", encode),
]

#: The classifier, the sketches and the tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm.common import shared_dir

    docs = _table(spark, sf_dir, "documents")
    path = shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/stage{i}")
        docs = spark.read.parquet(f"{path}/stage{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
