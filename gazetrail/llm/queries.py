"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetrail.llm import decontaminate, language, licenses, media, packing, secrets, sharding, simhash, storage, token_files, toxicity
from gazetrail.llm.tokens import default_tokenizer


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back."""
    folder = storage.new_folder(spark, "token-files")
    index = token_files.write_token_files(_docs(spark, sf_dir), folder, default_tokenizer())
    return token_files.read_token_files(spark, folder, index)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model that has not seen the held-out fifth."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.scores(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence phrases and notices."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return licenses.scan(docs, licenses.idf(docs)).drop("text", "places")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in a tar shard: metadata columns from the headers, the rest from the stored bytes."""
    index = media.write_shards(_docs(spark, sf_dir), storage.new_folder(spark, "media"))
    return media.read_back(media.metadata(index)).withColumn("shard", F.element_at(F.split("shard", "/"), -1))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over 3-word shingles and its group at 3 bits."""
    found = simhash.groups(_docs(spark, sf_dir), shingle=3, budget=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the sequences of 1024 tokens they are packed into."""
    return packing.plan(_docs(spark, sf_dir), default_tokenizer(), room=1024, end_id=2)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, judged; values only as digests."""
    found = secrets.scan(_docs(spark, sf_dir), secrets.train(secrets.sample_findings(spark)))
    return found.select("doc_id", "rule", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document, within the edit budget."""
    return decontaminate.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SHARDS = [f"shard-{k:02d}" for k in range(16)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return sharding.place(_docs(spark, sf_dir), SHARDS).select("doc_id", "slot", "shard")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model that has not seen the held-out fifth."""
    docs = _docs(spark, sf_dir)
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~toxicity.held_out(F.col("doc_id"))))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


#: The table is filled by recursion, one claim a step.  SQL cannot express the other operators of this list.
SHARDING_SQL = """
WITH RECURSIVE number AS (
    SELECT k, ('0x' || substr(md5('offset shard-' || lpad(k::VARCHAR, 2, '0')), 1, 12))::BIGINT % 2039 AS first,
           ('0x' || substr(md5('step shard-' || lpad(k::VARCHAR, 2, '0')), 1, 12))::BIGINT % 2038 + 1 AS step
    FROM range(16) r(k)
), turns AS (
    SELECT 0::BIGINT AS n, -1::BIGINT AS slot, list_transform(range(2039), lambda x: false) AS taken
    UNION ALL
    SELECT n, slot, list_transform(taken, lambda x, i: x OR i = slot + 1)
    FROM (SELECT n + 1 AS n, taken, list_filter(list_transform(range(2039), lambda j: (first + j * step) % 2039), lambda s: NOT taken[s + 1])[1] AS slot
          FROM turns JOIN number ON k = n % 16 WHERE n < 2039)
), lookup AS (
    SELECT slot, 'shard-' || lpad(((n - 1) % 16)::VARCHAR, 2, '0') AS shard FROM turns WHERE n > 0
)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT % 2039, 0) AS slot FROM documents) JOIN lookup USING (slot)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_licenses, op4_media, op5_simhash_groups, op6_packing, op7_secrets, op8_decontaminate, op9_sharding, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op9_sharding": SHARDING_SQL}
