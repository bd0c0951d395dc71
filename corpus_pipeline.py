"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelace.llm import mixing, packing, quality, secrets, simhash
from tracelace.llm.common import documents
from tracelace.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, with the columns they had.

    Null, empty and short texts fail and go; long texts are judged whole; null ids and repeated rows are judged like
    others; a null source is a host; columns of any name pass; no rows give none.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays.

    Texts without words are one group, so one of them stays; a null id can't be named, so its rows stay; rows alike in id
    and text stay once; texts are compared whole; columns of any name pass; no rows give none.
    """
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars (where the table has it) with them.

    Null and empty texts, null ids, repeated rows and columns of any name stay as they are; no rows give none.
    """
    out = secrets.redact(docs)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the sources' target weights ask.

    A null source is a source; null and empty texts have no words and are taken by their hash; of rows alike as many are
    taken as the target asks; columns of any name pass; no rows give none.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and place there.

    A null or empty text is its end token; a text of more than 4096 tokens has more pieces; null ids and repeated rows have
    pieces of their own; other columns are left aside; no rows give none. Workers that ran the other stages before keep
    fewer words, so that executors stay within their memory.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), most=200_000)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the fingerprints' groups nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
