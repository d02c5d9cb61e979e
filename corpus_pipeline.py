"""A corpus pipeline of five stages, each over all that its predecessor kept.

Quality rules, near-duplicates, repeated passages, benchmark decontamination, packing. Each stage takes (spark, docs, sf_dir)
and gives a DataFrame; all but the last give the columns of documents. Stages are meant to be written as Parquet
and read again in between; ``run`` does so in the shared folder.

Defined cases, by stage. Empty tables pass all stages and give no rows; extra columns, whatever their names, are kept by all stages but the last.
Quality rules: null and empty texts fail and go; repeated rows stay or go together. Near-duplicates: of rows that share an id one stays, rows
without an id stay. Repeated passages: null texts stay null, a text cut down to nothing stays, empty; a null id counts as the largest.
Decontamination: texts without words stay; rows that share an id are judged by their own texts. Packing: a null or empty text is one piece, the end
token; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import line_quality, packing, positional_index, simhash, suffix_dedup
from gleaner.llm.common import release, scratch, staged, table
from gleaner.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go."""
    return line_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out of texts; a document cut down to nothing stays, empty."""
    return suffix_dedup.remove(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark's windows go."""
    return positional_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, with their sequences and places."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints need XXH64, which DuckDB lacks; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = set(scratch())
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        # the stage's own tables go; its result, the newest, stays
        release([path for path in scratch()[:-1] if path not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
