"""Page checkpoints as a stream: pages appear as their files do. An extension; batch reading is in ``sources.checkpoints``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.checkpoints import CHECKPOINT, NAME


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(book, chunk_start, page_index, pdf_page, text) of new checkpoint files below ``path``."""
    raw = (
        spark.readStream.schema(CHECKPOINT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "chunk_*.pdf.json")
        .option("maxFilesPerTrigger", files_per_batch).json(path)
    )
    file = F.input_file_name()
    rows = raw.select(
        F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("book"), F.regexp_extract(file, NAME, 1).try_cast("int").alias("chunk_start"), F.posexplode("result.layoutParsingResults").alias("page_index", "_p")
    )
    return rows.select("book", "chunk_start", "page_index", (F.col("chunk_start") + F.col("page_index") + 1).alias("pdf_page"), F.coalesce("_p.markdown.text", F.lit("")).alias("text"))


def stream_bigrams(pages: DataFrame, char_class: str) -> DataFrame:
    """(book, bigram, n) so far, pairs within pages; for output mode ``update`` or ``complete``."""
    from quillstone.operators.ngrams import bigram_model

    return bigram_model(pages, ["book"], char_class=char_class)
