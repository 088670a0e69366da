"""The corpus pipeline: five stages over ``documents``.

Bad documents go, exact copies go, of each group of near copies one stays, sources are mixed to target
weights, and what is left is encoded.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``docs`` with their values untouched.  Stages
tell rows apart by their place in storage, which every scan finds alike, so null and repeated ids are
handled: repeated rows are copies of which one stays.

A stage's result is to be stored before the next stage begins, which removes the scratch tables of those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import digests, encode_texts
from quillstone.llm.chosen_path import jaccard_join
from quillstone.llm.exact_dedup import exact_groups
from quillstone.llm.mixing import mix_sources
from quillstone.llm.quality import classify
from quillstone.llm.queries import vocabulary_of
from quillstone.llm.workspace import identified, release, write_table


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, text): keys order by id, null last, then by place."""
    return identified(docs, "_place").select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_place").alias("place")).alias("key"), "text")


def _only(docs: DataFrame, places: DataFrame) -> DataFrame:
    return identified(docs, "_place").join(places, "_place", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good reaches one half; the source is the host, the language the path."""
    release(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = docs.select("doc_id", "text", "source", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return classify(whole, labels, F.col("source"), F.col("lang"), keep=["_row"]).filter("good").select("_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    release(spark)
    kept = exact_groups(_keyed(docs), "key").filter("kept")
    return _only(docs, kept.select(F.col("key.place").alias("_place")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more on five-word shingles the row with the smallest id."""
    release(spark)
    groups = jaccard_join(_keyed(docs), id_col="key")
    return _only(docs, groups.filter(F.col("key") == F.col("class_id")).select(F.col("key.place").alias("_place")))


def fair_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.  The order follows ids and texts."""
    release(spark)
    placed = identified(docs, "_place")
    order = F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    taken = mix_sources(placed.select("_place", "text", "source", "doc_id"), id_col="_place", shuffle=order).filter("taken > 0")
    times = taken.select("_place", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).alias("_turn"))
    return placed.join(times, "_place").select([F.col(f"`{c}`") for c in docs.columns])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every text."""
    release(spark)
    vocabulary = vocabulary_of(spark)
    return encode_texts(docs, vocabulary, finish=digests(vocabulary, tokens=True))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("fair_mixing", fair_mixing),
    ("byte_bpe", byte_bpe),
]

#: A logistic fit, a similarity join and byte-pair merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        done = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
        if before is not None:
            before.drop()
        docs, before = done.df, done
    release(spark)
    return docs
