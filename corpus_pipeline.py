"""A training corpus from `documents`, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of `documents`.

Defined results, for every stage: null, empty and very long texts, repeated
rows, null and repeated ids and empty tables are handled as the operators'
docstrings say.  Rows are dropped by id and text together, so an id on several
texts loses only those that are rejected; identical rows stay or go together,
except that near-duplicate removal keeps one of them.  Extra columns, of any
name, pass through the first four stages; the last returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import bpe_codec, decontaminate, near_copies, quality_rules, storage, toxicity
from stratalog.llm.queries import vocab_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak supervision: documents that the rules reject go."""
    return quality_rules.kept_rows(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Positive-unlabelled classifier, learned from the labels outside of the held-out fold: toxic documents go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights, bias = toxicity.learn(docs, labels, toxicity.fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, weights, bias)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash candidates of five-word shingles, verified at a similarity of 0.8: one document of each group stays."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spaced seeds: documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenization automaton: ids and decoded text of what is left, as digests."""
    return bpe_codec.encode_digests(docs, vocab_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: No SQL expresses the fitted models, the components or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
