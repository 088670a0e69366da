"""The registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (action, host, path) of the URL rules that the registered query applies.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model learns from ids whose CRC-32 mod 7 is not 2 and holds out remainder 3."""
    from quillstone.llm.lm_scoring import HELD, TEST, TRAIN, score_texts

    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    kind = F.when(remainder == 2, TEST).when(remainder == 3, HELD).otherwise(TRAIN)
    out, model = score_texts(_table(spark, sf_dir, "documents"), kind)
    return out.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    from quillstone.llm.sharding import shard_rows

    out = shard_rows(_table(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    from quillstone.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    from quillstone.llm.url_filter import judge_urls

    names = ("action", "host", "path")
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in URL_RULES])))
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all documents; a document's source is its host, the language there its path."""
    from quillstone.llm.quality import classify

    out = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), keep=["doc_id"])
    return out.select("doc_id", "host", "path", "p_doc", "host_rate", "path_rate", "posterior", "good")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    from quillstone.llm.warc import read_archives, write_archives

    pages = _table(spark, sf_dir, "pages")
    records = read_archives(write_archives(pages), payloads=False)
    page = lambda c: F.expr(f"try_cast(url_decode(split({c}, ':')[2]) AS bigint)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents at a Jaccard similarity of 0.8 on five-word shingles."""
    from quillstone.llm.chosen_path import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their texts edited with the next document's beginning."""
    from quillstone.llm.fingerprints import add_fingerprint, likeness, to_hex, with_next

    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(add_fingerprint(docs, "text", "fp"), "doc_id", ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = add_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_hex(F.col("fp")).alias("fingerprint"),
        to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def vocabulary_of(spark: SparkSession):
    """The public multilingual vocabulary."""
    import public_tokenizers

    from quillstone.llm.bpe import Vocabulary

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts that they decode to, as digests."""
    from quillstone.llm.bpe import digests, encode_texts

    vocabulary = vocabulary_of(spark)
    return encode_texts(_table(spark, sf_dir, "documents"), vocabulary, finish=digests(vocabulary))


def op10_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each document."""
    from quillstone.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_deleted_interpolation, op2_kd_sharding, op3_block_naming, op4_url_filter, op5_quality, op6_warc, op7_chosen_path, op8_minhash, op9_byte_bpe, op10_fair_mixing)
}
