"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``. All but the last
return the columns of ``documents``.

* toxicity: documents that the classifier marks go; labels come from ``sf_dir``.
* near duplicates: of each group linked by five-word shingles, the document
  with the smallest id stays, of repeated rows of that id one; documents
  without an id stay.
* personal data: values are replaced by pseudonyms, ``n_chars`` follows.
* mixing: each document stands as often as the mix takes it.
* token ids: SentencePiece ids of each text and their decoding, as digests.

Null or empty texts, repeated rows, ties and empty tables are as each operator
defines them; rows that no stage rejects keep all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm import jaccard_join, mixing, pieces, pii, toxicity
from assaybook.llm.common import shared_dir, stored


#: Workers that earlier stages have filled leave less memory than a query of its own has: smaller blocks.
_CHUNKS_A_BLOCK = 1 << 19


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, into="__score").filter(F.col("__score") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs).filter("doc_id IS NOT NULL")
    found = stored(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("doc_id <> component_id OR rows > 1"), "pipeline-repeats")
    others = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id = component_id").select("doc_id")
    if repeated.isEmpty():
        return others
    # of several rows with the id that stays, that with the first text
    rows = docs.join(repeated, "doc_id").select(*docs.columns)
    return others.unionByName(rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("r")).select("r.*"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.with_digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source"], chunks_a_block=_CHUNKS_A_BLOCK))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
