"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last return the columns of docs, whatever others there
are. Rows that share an id, or have none, are rows of their own, but that decontamination
drops all rows of an id it finds. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from itemforge.llm.bpe import bpe_roundtrip
from itemforge.llm.common import materialize, table
from itemforge.llm.decontaminate import remove_contaminated
from itemforge.llm.jaccard import drop_similar
from itemforge.llm.langid import keep_known_languages
from itemforge.llm.linededup import drop_repeated_lines
from pyspark.sql import DataFrame, SparkSession


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null or has no letter, and so no language, go."""
    return keep_known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, and documents of which nothing is left. Of equal lines
    the one with the least id stays, a null id before all, then the first in its text."""
    return drop_repeated_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the least id (null only
    where there is no other, and the first row among equal ids). Texts without words stay."""
    return drop_similar(docs, n=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Texts without words overlap nothing."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the digests of the round trip; null texts are empty."""
    return bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Learned languages, near copies and BPE merges are not expressible; tests/llm/test_pipeline.py
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
