"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

Each stage's result is written as Parquet and read again as the next one's docs. All but the last return the columns of
their docs, whatever further columns there are and however these are named. In every stage nulls in other columns than text and
source are kept as they are, an empty table gives an empty table, and repeated rows are documents of their own, but for near
deduplication, which keeps one. A null text has no language and goes in the first stage; met later it is kept, and packed as the end alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import langid, line_dedup, mixing
from gleanery.llm.common import written
from gleanery.llm.near_dup import one_of_each
from gleanery.llm.packing import pack, pieces

#: A prediction below this probability is a rejection.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or a calibrated probability below LEAST_SCORE."""
    model = langid.fit(docs.where(~langid.is_held_out()))
    own = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])  # columns named as the prediction's would be replaced
    told = langid.identify(own, model, text=own.columns[docs.columns.index("text")])
    told = told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return told.select(*[F.col(n).alias(c) for n, c in zip(own.columns, docs.columns, strict=True)])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier line exactly or within two edits; documents of which nothing is left go."""
    return line_dedup.without_repeats(docs, tau=2, min_chars=40)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return one_of_each(docs, similarity=0.8, words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as the mix says, which may be none."""
    return mixing.emitted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most 1024."""
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2, remembered=60_000), size=1024)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


#: SQL can't express language identification.
ORACLE_SQL = None
