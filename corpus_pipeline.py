"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. `run` writes each stage's rows as Parquet under the shared folder and reads them back as the
next stage's input, so that a lost executor never costs more than one stage.

Defined cases, of every stage: a null doc_id, text, lang or source is carried as it is; rows that repeat are separate
rows until a stage says otherwise; further columns stay, whatever their names; an empty table gives an empty one; very
long texts are read whole. What a stage adds to this is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontamination, mixing, quality_rules, simhash, token_files
from tallyforge.llm.common import cut, table
from tallyforge.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null, empty and short texts (under 50 words) go; a null or rare language is held against the references of all
    languages; repeated rows get the same verdict."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    A null doc_id counts as larger than any; of rows alike in doc_id the smallest fingerprint and digest stays, of rows
    alike in doc_id and text one; empty texts are one group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items.

    Null and empty texts hold none and stay; null, empty and wordless items are never found; each repeated row is judged
    by itself; items of any length are sought."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate says.

    A null source is a source of its own, in the last place; texts without words have size 0 and are drawn at their
    source's rate; a source without any words goes; rows alike in doc_id and text get the same number of copies."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; what is read back from them.

    One row for each copy, in ascending doc_id order with null first, ties in any fixed order; null and empty texts
    give the end id alone."""
    return token_files.token_files(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
    ("token output", tokens),
]

#: No SQL states fingerprints, BM25 retrieval or byte-pair encoding; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
