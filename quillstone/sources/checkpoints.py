"""Sources and sinks of page checkpoints, JSON lines, tables of contents and reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = (
    "struct<markdown: struct<text: string, images: map<string, string>>, "
    "prunedResult: struct<parsing_res_list: array<struct<block_label: string, block_content: string, block_bbox: array<double>>>>>"
)
CHECKPOINT = f"result struct<layoutParsingResults: array<{PAGE}>>"
NAME = "chunk_([0-9]+)_([0-9]+)\\.pdf\\.json$"


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(book, chunk_start, chunk_end, page_index, pdf_page, seq_page, text, images, blocks) of ``chunk_<start>_<end>.pdf.json`` files.

    Chunks are in numeric order; ``pdf_page`` follows the chunk's start, ``seq_page`` counts the pages there are, both from 1.
    A book is the folder of its files; other files are passed over.  Missing parts are null or empty.
    """
    raw = spark.read.schema(CHECKPOINT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "chunk_*.pdf.json").json(path)
    file = F.input_file_name()
    rows = raw.select(
        F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("book"),
        F.regexp_extract(file, NAME, 1).try_cast("int").alias("chunk_start"),
        F.regexp_extract(file, NAME, 2).try_cast("int").alias("chunk_end"),
        F.posexplode("result.layoutParsingResults").alias("page_index", "_p"),
    ).filter("chunk_start IS NOT NULL")
    return number_pages(
        rows.select(
            "book", "chunk_start", "chunk_end", "page_index", (F.col("chunk_start") + F.col("page_index") + 1).alias("pdf_page"),
            F.coalesce("_p.markdown.text", F.lit("")).alias("text"), F.coalesce("_p.markdown.images", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("images"),
            F.coalesce("_p.prunedResult.parsing_res_list", F.array().cast("array<struct<block_label: string, block_content: string, block_bbox: array<double>>>")).alias("blocks"),
        )
    )


def number_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``seq_page``: chunks are counted first, so that only one row a chunk is put in order."""
    sizes = pages.groupBy("book", "chunk_start").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("book").orderBy("chunk_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return pages.join(starts, ["book", "chunk_start"]).withColumn("seq_page", (F.col("_before") + F.col("page_index") + 1).cast("int")).drop("_before")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


TOC = "array<struct<title: string, page: int, level: int, match: string, matches: array<string>, aliases: array<string>, page_start: boolean, at: string>>"


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """(ord, title, page, level, source, page_start, match) of a JSON list, or of the list ``headings`` in an object.

    ``source`` has a heading's title and every text it may be found by; ``match`` those that start it, which aliases don't.
    """
    text = spark.read.option("wholetext", True).text(path)
    listed = F.ltrim("value").startswith("[")
    both = F.when(listed, F.from_json("value", TOC)).otherwise(F.from_json("value", f"struct<headings: {TOC}>").getField("headings"))
    rows = text.select(F.posexplode(both).alias("ord", "h"))
    match = F.concat(F.array("h.title", "h.match"), F.coalesce("h.matches", F.array().cast("array<string>")))
    sources = F.array_distinct(F.array_compact(F.concat(match, F.coalesce("h.aliases", F.array().cast("array<string>")))))
    return rows.select("ord", "h.title", "h.page", "h.level", sources.alias("source"), (F.coalesce("h.page_start", F.lit(False)) | F.coalesce(F.col("h.at") == "page_start", F.lit(False))).alias("page_start"), F.array_distinct(F.array_compact(match)).alias("match"))


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def write_checkpoint(path: str, checkpoint: dict) -> None:
    """One checkpoint file on a local disk, replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(checkpoint, f, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
