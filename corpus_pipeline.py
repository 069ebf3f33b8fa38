"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heliograph.llm.decontaminate import decontaminate
from heliograph.llm.language_id import identify, learn
from heliograph.llm.line_dedup import drop_templates
from heliograph.llm.near_dedup import drop_near_copies
from heliograph.llm.packing import pack_documents
from heliograph.storage import Scratch


def language(spark, docs, sf_dir):
    """Documents whose language the models recognise; those they reject go."""
    found = identify(docs, learn(docs))
    return found.where(~F.col("lang_rejected")).select(docs.columns)


def lines(spark, docs, sf_dir):
    """Texts without lines that repeat a template of the corpus; n_chars follows the text."""
    clean = drop_templates(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def copies(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return drop_near_copies(docs).select(docs.columns)


def benchmark(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packing(spark, docs, sf_dir):
    """The documents' tokens, packed into sequences of 1024."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", copies), ("decontaminate", benchmark), ("packing", packing)]
#: Hash-based candidate search, language models and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
