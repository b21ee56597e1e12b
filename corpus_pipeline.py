"""A training corpus from raw documents: five stages, each an operator of gazetrail.llm.

Each stage gets what the one before kept, written and read again:

1. toxicity: documents that the positive-unlabelled model calls toxic go
2. near duplicates: one document of each group stays; a group is what chains of texts link whose sets of 5-word shingles have a
   Jaccard similarity of 0.8 or more, computed exactly among candidates that buckets and the trie join of SimHash fingerprints find
3. benchmark: documents that hold a benchmark passage within the edit budget go
4. secrets: what the forest calls a secret is replaced by [SECRET] where it stands; all documents stay
5. packing: the pieces of all documents, packed best-fit into sequences of 1024 tokens

SQL cannot express the trained stages, so there is no ORACLE_SQL.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazetrail.llm import decontaminate, packing, secrets, simhash, storage, toxicity
from gazetrail.llm.tokens import default_tokenizer

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scores(docs, model).filter("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.sample_findings(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.plan(docs, default_tokenizer(), room=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole `documents` table of `sf_dir`."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = storage.mark()
        last, rows = rows, storage.written(stage(spark, rows, sf_dir), f"pipeline-{name}")
        storage.free(since, rows)
        if name != STAGES[0][0]:
            storage.discard(spark, last)
    return rows
