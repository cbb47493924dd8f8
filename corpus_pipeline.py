"""From raw documents to a mixed training corpus, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all documents
its predecessor kept; ``run`` writes every stage's result as Parquet in the
shared folder and reads it again as the next one's input, so a lost executor
never costs more than the running stage.

Stages: documents scored as toxic go; of equal texts the largest doc_id
stays; of near-duplicates the smallest; documents with a benchmark passage
go; the rest is mixed to the sources' target weights, a document appearing
once for each time that the mix takes it (``mix_pass``, from 0).

Null and empty texts are equal texts, of which one stays until the mix, which
takes no text without words.  Null doc_ids come before all others and their
rows are told apart.  Very long texts are read whole.  Rows that repeat are
copies.  Without labels nothing is toxic, without benchmark items nothing is
a leak; no documents give no rows.  Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logspark.llm import decontaminate, exact_dedup, fair_mix, near_dedup, toxicity
from logspark.llm.queries import table
from logspark.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.repeated(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: The learned toxicity score and the signatures have no SQL; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for nr, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{nr}-{name}")
        scratch.drop(*(f"{nr - 1}-{before}" for before, _ in STAGES[nr - 1:nr]))
    return docs
