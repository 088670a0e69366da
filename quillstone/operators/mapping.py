"""Mapping spans of text to the pages they came from.

Containment is found by an equi-join on a span's first characters against the k-grams of the pages, then confirmed,
so that no pair of a span and a page without a common k-gram is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.shared import stored

#: Needles are broadcast up to this many rows and characters; more are shuffled.
MAX_BROADCAST_NEEDLES, MAX_BROADCAST_CHARS = 100_000, 16_000_000


def grams(text: Column, k: int) -> Column:
    """All stretches of ``k`` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % k), F.lit(1))


def contains_join(
    needles: DataFrame, pages: DataFrame, needle_col: str, text_col: str, keep: list[str], page_keep: list[str], k: int = 5, salts: int = 8
) -> DataFrame:
    """(keep…, needle, page_keep…) of every needle of at least ``k`` characters that a page contains, once; ``page_keep`` begins with the page's id.

    Needles that fit a broadcast meet each page's k-grams where the page is, and are confirmed there: only hits travel.
    Otherwise pages are reduced to those of their k-grams that begin some needle: the distinct beginnings are joined first.
    Needles that share a beginning are then spread over ``salts``.
    """
    page_id = page_keep[0]
    needles = needles.filter(F.length(needle_col) >= k).select(*keep, F.col(needle_col).alias("_needle"), F.substring(needle_col, 1, k).alias("_gram"))
    needles = stored(needles.distinct(), "needles")
    size = needles.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_needle")), F.lit(0)).alias("chars")).first()
    text = F.coalesce(F.col(text_col), F.lit(""))
    if size["n"] <= MAX_BROADCAST_NEEDLES and size["chars"] <= MAX_BROADCAST_CHARS:
        rows = pages.select(F.struct(*page_keep).alias("_page"), text.alias("_text"), F.explode(grams(text, k)).alias("_gram"))
        found = rows.join(F.broadcast(needles), "_gram").filter(F.col("_text").contains(F.col("_needle")))
        found = found.groupBy(*keep, "_needle", F.col(f"_page.{page_id}").alias("_id")).agg(F.first("_page").alias("_page"))
        return found.select(*keep, F.col("_needle").alias(needle_col), *[F.col("_page").getField(c).alias(c) for c in page_keep])
    wanted = needles.select("_gram").distinct()
    hits = pages.select(F.col(page_id).alias("_page"), F.explode(F.array_distinct(grams(text, k))).alias("_gram")).join(wanted, "_gram", "left_semi")
    salted = needles.withColumn("_salt", F.pmod(F.xxhash64("_needle"), F.lit(salts)))
    hits = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = salted.join(hits, ["_gram", "_salt"]).drop("_gram", "_salt")
    texts = pages.select(*page_keep, text.alias("_text"))
    found = found.join(texts, F.col("_page") == F.col(page_id)).filter(F.col("_text").contains(F.col("_needle")))
    return found.select(*keep, F.col("_needle").alias(needle_col), *page_keep)


def spans_to_pages(spans: DataFrame, pages: DataFrame, span_id: str, span_col: str, page_id: str, text_col: str, run: str = "[\\u3400-\\u9FFF]{6,}", k: int = 6) -> DataFrame:
    """(span_id, run, page_id): a span's page is where its longest run that stands on one page only stands; others have no row."""
    runs = spans.select(span_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(span_col), F.lit(f"({run})"), F.lit(1)))).alias("run"))
    found = contains_join(runs.select("run").distinct(), pages, "run", text_col, [], [page_id], k)
    one = found.groupBy("run").agg(F.count_distinct(page_id).alias("_n"), F.min(page_id).alias(page_id)).filter("_n = 1")
    w = Window.partitionBy(span_id).orderBy(F.length("run").desc(), "run")
    return runs.join(one, "run").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(span_id, "run", page_id)


def source_lookup(
    excerpts: DataFrame, pages: DataFrame, excerpt_id: str, excerpt_col: str, page_id: str, text_col: str, size: int = 5, most: int | None = 25,
    before: int = 40, after: int = 120,
) -> DataFrame:
    """(excerpt_id, page_id, key, context): the first page that has any of an excerpt's keys, its stretches of ``size`` characters at 0, ``size``, … below ``most``.

    Without ``most`` the keys go over the whole excerpt.
    """
    last = F.length(excerpt_col) - size + 1
    starts = F.sequence(F.lit(1), last if most is None else F.least(last, F.lit(most)), F.lit(size))
    keys = excerpts.filter(F.length(excerpt_col) >= size).select(
        excerpt_id, F.length(excerpt_col).alias("_len"), F.posexplode(F.transform(starts, lambda i: F.substring(F.col(excerpt_col), i, F.lit(size)))).alias("_k", "key")
    )
    found = contains_join(keys.select("key").distinct(), pages, "key", text_col, [], [page_id, text_col], size)
    w = Window.partitionBy(excerpt_id).orderBy(page_id, "_k")
    first = keys.join(found, "key").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    at = F.instr(F.col(text_col), F.col("key")) - 1
    start = F.greatest(F.lit(0), at - before)
    return first.select(excerpt_id, page_id, "key", F.trim(F.substring(F.col(text_col), start + 1, at + F.col("_len") + after - start)).alias("context"))
