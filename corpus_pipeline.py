"""A corpus pipeline: from raw documents to the tokens of a deduplicated, mixed corpus.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import closecopies, mixing, quality, repeats, tokens
from tidepool.llm.scratch import cut

RANKS = "byte_bpe_multi_50k.tiktoken"


#: Bytes of a string that counts as a repeat: below the length of any passage of over 50 words in the languages at hand (some 6 bytes a word).
REPEAT = 240


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, gives a score below its threshold go.

    Null and empty texts are scored as a text without words, texts of any length whole; repeated rows share their fate; without labels the score is 0.5 and all
    documents go. Columns are taken by place, so others may have any names. An empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each class of texts with at least 0.8 of their five-word shingles in common: that with the smallest id, ids before null.

    Texts without words (null and empty ones too) are one class, as are repeated rows; texts of any length are compared whole. Columns are taken by place, so others
    may have any names. An empty table stays empty.
    """
    return closecopies.first_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte goes that a string of ``REPEAT`` bytes covers which also starts elsewhere; documents stay, their text shortened.

    Null texts become empty; ``n_chars`` follows the text. Repeated rows lose all of a text that is long enough; texts of any length are read whole. Columns are
    taken by place, so others may have any names. An empty table stays empty.
    """
    return repeats.deduplicated(docs, length=REPEAT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times as rows.

    Texts without words (null and empty ones too) are never taken, texts of any length whole or not at all. Null sources are one source. Equal rows are taken or left
    together. Columns are taken by place, so others may have any names. An empty table stays empty.
    """
    return mixing.repeated(mixing.mix(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row: its id, the number of tokens, the ids and the digests of ids and decoded bytes.

    Null and empty texts have no tokens, texts of any length are encoded whole. Repeated rows stay. Columns are taken by place, so others may have any names; they are
    not returned. An empty table stays empty.
    """
    return tokens.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL expresses none of the five stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
