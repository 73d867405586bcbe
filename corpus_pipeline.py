"""From raw documents to packed sequences: five stages, each written as Parquet and read again before the next.

Null texts fail the quality rules, and so leave with the first stage; later stages take them, and leave them, as their
operators do. Documents without an id are judged by their text, lose no lines or passages, are no near-duplicates of
anything, and are packed. Rows that repeat share their verdicts; near-duplicate rows of one id stay together. Every stage
takes an empty table. Columns beside doc_id, text, lang and source pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, line_dedup, minhash, packing, quality, substring
from weftline.llm.common import drop_folder, read, shared_folder


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their source's thresholds."""
    return quality.filter_documents(docs)


def _names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for results that no column of ``docs`` has."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return [prefix + w for w in wanted]


def _text_replaced(docs: DataFrame, cleaned: DataFrame, clean: str) -> DataFrame:
    return cleaned.withColumns({"text": F.col(clean), "n_chars": F.length(clean).cast("long")}).select(*docs.columns)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of a line leave the texts, alone or in a run; all documents stay."""
    clean, lines, removed = _names(docs, "clean", "lines", "removed")
    return _text_replaced(docs, line_dedup.remove(docs, window=1, clean=clean, lines=lines, removed=removed), clean)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_one(docs, percent=80)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word passages that stand in a document of smaller id leave the texts; all documents stay."""
    clean, total, removed = _names(docs, "clean", "total", "removed")
    return _text_replaced(docs, substring.remove(docs, width=50, clean=clean, total=total, removed=removed), clean)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.load_ranks(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, capacity=2048, added=bpe.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality_rules", _quality), ("line_dedup", _lines), ("minhash_near_dedup", _near_duplicates), ("substring_dedup", _substrings), ("best_fit_packing", _packing)]

#: Token ids, sketches and the packing plan are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each result lies in the shared folder before the next stage starts, and until that has ended."""
    docs, last = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop_folder(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
