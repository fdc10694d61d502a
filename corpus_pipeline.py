"""A corpus pipeline of five operators: language ID, n-gram join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake.llm.fm_decontam import decontaminate
from offsetlake.llm.langid import fit_languages, identify
from offsetlake.llm.mixing import mix
from offsetlake.llm.ngram_join import jaccard_components
from offsetlake.llm.scratch import materialise
from offsetlake.llm.sharding import interleave
from offsetlake.session import ship

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letter, or no language likely enough."""
    ship(spark)
    found = identify(docs, fit_languages(docs))
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links with 5-word Jaccard of 0.8 or more, the document with the smallest id stays (one row of it); rows without id stay."""
    ship(spark)
    found = jaccard_components(docs, percent=80, width=5).where("doc_id IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    marked = materialise(found.where("component_id <> doc_id OR rows > 1").select("doc_id", (F.col("component_id") != F.col("doc_id")).alias("gone")), "copies")
    once, several = docs.join(marked, "doc_id", "left_anti").select(*docs.columns), marked.where("NOT gone")
    if several.isEmpty():
        return once
    # Of the rows of one id, the one with the smallest hash (then the smallest columns) stays; only these rows are dealt out.
    least = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*docs.columns).alias("hash"), *docs.columns)).alias("least"))
    return once.unionByName(least.select(*[F.col(f"least.{c}").alias(c) for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts (n_chars follows); texts left without a word go if they had one."""
    found = decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_words, n_hit, _, _, clean = found.columns[-5:]
    left = found.where((F.col(n_hit) == 0) | (F.col(n_words) > F.col(n_hit)))
    cut = left.withColumns({"text": F.col(clean), "n_chars": F.when(F.col(n_hit) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))})
    return cut.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of op7 (97 % clean, 3 % low, no toxic tokens) at its full size: a document is repeated as often as its rate says, fractions by chance."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mix(docs, labels, {"clean": 0.97, "low": 0.03}, near=0.0)
    copies = mixed.columns[-1]
    return mixed.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the shards: where each document goes, every shard with the sources' mixture."""
    ship(spark)
    narrow = docs.select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("text_hash"))
    return interleave(narrow, SHARDS, text_col="text_hash")


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first and the fourth stage use trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
