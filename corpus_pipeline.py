"""A corpus pipeline: five stages, each a DataFrame of documents written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.decontam import decontaminate
from loomgraph.llm.language import keep_identified
from loomgraph.llm.mixing import entropy_mix
from loomgraph.llm.secrets import redact_secrets
from loomgraph.llm.simhash import drop_near_duplicates
from loomgraph.sources.shared import passing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: null texts, texts without letters, and those whose words fit no learned one. Rows are judged
    one by one by their text, so repeated rows stay or go together; ids may be null."""
    return keep_identified(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, of repeated rows one. Null texts are one group with empty ones; rows without an id stay."""
    return drop_near_duplicates(docs).select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages. Null texts hold none; repeated rows are judged alike; an empty benchmark drops nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark. Every row stays, repeated ones too; null texts stay null."""
    return redact_secrets(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the mix takes, with their number of copies and the words these give; a null or repeated id is a row like others."""
    return entropy_mix(docs.select(COLUMNS), whole=True).filter("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mix", mix),
]

#: SQL expresses neither the learned models nor the components; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``. What a stage has made goes once its result is written, and that with the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with passing(spark) as kept:
            docs = settle(stage(spark, docs, sf_dir), last)
            kept.append(docs)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
