"""A training-corpus pipeline of operators from ``ledgerloom.llm``.

documents -> quality -> line dedup -> near duplicates -> repeated strings -> packing.
Every stage works on all rows that the one before it kept, and the rules are the same in each:
every row is a document of its own, whether its id is null, repeated or unique; null and empty texts
count as empty; equal texts get equal scores, so ties go or stay together, but of a group of near
copies one row stays (that of the smallest id; rows whose id is null or repeated come before all
others, in the order of their texts' hashes); an empty table gives an empty table of the
stage's columns; further columns are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, table
from ledgerloom.llm.jaccard import similar_components
from ledgerloom.llm.lines import drop_common_lines
from ledgerloom.llm.packing import packed_documents
from ledgerloom.llm.quality import fit_quality, score_quality
from ledgerloom.llm.substrings import remove_repeats, with_keys

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below one half) go."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model, out="__score").filter(F.col("__score") >= 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go from all of them."""
    return _with_text(drop_common_lines(docs.select(*COLUMNS), out="kept"), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group with similar five-word shingles stays."""
    keyed, _ = with_keys(docs.select(*COLUMNS), "__key", unique=True)
    groups = similar_components(keyed, words=5, percent=80, doc_id="__key")
    others = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__other"))
    return keyed.join(others, F.col("__key") == F.col("__other"), "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier go."""
    keyed, _ = with_keys(docs.select(*COLUMNS), "__key", unique=True)
    kept = remove_repeats(keyed, 100, doc_id="__key", characters=True, keyed=True).filter("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("kept").alias("__kept"))
    full = keyed.join(kept, F.col("__key") == F.col("__id"), "left")
    return _with_text(full.withColumn("__text", F.coalesce("__kept", "text")), "__text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("packing", packing)]

#: SQL can't express the classifier or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
