"""Result archives of recognition services: Markdown files and pictures in ZIP files, as pages."""

from __future__ import annotations

import base64
import io
import os
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.operators import lines, noise

#: Pictures by extension, and the fewest characters of a page; shorter ones are page numbers or lone headers.
PICTURES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}
LEAST_TEXT = 80
FILES = "book string, file_no int, file string, text string, images map<string,string>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The Markdown files of all ``*.zip`` below ``path`` in order of name, as FILES; pictures are data URIs by member.

    Bad bytes of a text become replacement characters; an unreadable picture is left out, and so is a file that is no archive.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        images = []
                        for name in z.namelist():
                            kind = PICTURES.get(os.path.splitext(name)[1].lower())
                            try:
                                images += [(name, f"data:{kind};base64,{base64.b64encode(z.read(name)).decode()}")] if kind else []
                            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                                continue
                        for k, name in enumerate(sorted(x for x in z.namelist() if x.endswith(".md"))):
                            rows.append((book, k, name, z.read(name).decode("utf-8", "replace"), dict(images)))
                except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FILES.replace("map<string,string>", "map").split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(unzip, FILES)


def pages(files: DataFrame) -> DataFrame:
    """(book, page_no, text, images): the pages of each archive.

    A file is split at its running headers; without any it is one page.  Pages of fewer than LEAST_TEXT characters go, before
    captions are cleaned and after it.  Every page has all pictures of its archive.
    """
    docs = files.select(F.struct("book", "file_no").alias("_k"), "text", "images")
    rows = lines.explode_lines(docs, "_k")
    headers = lines.running_headers(rows, "_k")
    split = lines.trim_segments(lines.split_segments(rows, headers, "_k"), headers, "_k")
    marked = headers.select("_k").distinct()
    whole = docs.join(marked, "_k", "left_anti").select("_k", F.lit(0).cast("long").alias("segment"), "text")
    split = split.join(marked, "_k", "left_semi").select("_k", F.col("segment").cast("long").alias("segment"), "text")

    def long(text: Column) -> Column:
        return F.length(noise.strip(text)) >= LEAST_TEXT

    kept = union(split, whole).filter(long(F.col("text"))).withColumn("text", noise.clean_captions(F.col("text"))).filter(long(F.col("text")))
    order = Window.partitionBy("_k.book").orderBy("_k.file_no", "segment")
    numbered = kept.withColumn("page_no", F.row_number().over(order) - 1)
    return numbered.join(docs.select("_k", "images"), "_k").select("_k.book", "page_no", "text", "images")
