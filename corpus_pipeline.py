"""A pipeline over documents: each stage reads what the one before wrote.

In every stage rows with null or empty text, null or repeated ids and columns of any
names pass through without harm; an empty table gives an empty one.  What becomes of
such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontaminate, language, mixing, near_copies, token_file
from lexforge.llm.common import stored, table
from lexforge.llm.queries import tokenizer


#: Near copies share SHARE hundredths of their SHINGLE-word shingles.
SHINGLE, SHARE = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null, empty and letterless texts go."""
    return language.known(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id.

    Null ids go if their group has an id; rows that repeat id and text are one.
    """
    return near_copies.one_of_each(docs, SHINGLE, SHARE)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate; null texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; a null source is one too."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written and read back: place, length and checksum of each row, repeated ones too."""
    return token_file.round_trip(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Profiles, joins on words and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
