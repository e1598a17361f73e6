"""A training corpus from documents, stage by stage; each stage's rows are written and read again by the next.

Quality classifier: rejected documents go. Line dedup: boilerplate lines of a source are dropped from its documents; a
document of such lines alone stays, empty. N-gram Jaccard join: of each group of near duplicates the smallest id stays.
Mixing: documents are taken as often as the weights of their sources ask. BPE: token ids of every document of the mix,
and what they decode to, as a digest.

Null and repeated rows are treated as each operator's module says; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import bpe, jaccard, lines, mixing, quality
from orderloom.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(docs.select(*COLUMNS), "source", "text", counts=("n_lines", "n_dropped"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("line dedup", without_boilerplate),
    ("near duplicates", one_of_near_copies),
    ("mixing", mixed),
    ("tokens", token_ids),
]

#: The classifier can't be said in SQL; run() is tested against a chain of brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
