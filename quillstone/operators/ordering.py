"""Page order from printed page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.unions import union


#: A number of up to three digits between, before or after dots.
PRINTED = ("[•.·]\\s*([0-9]{1,3})\\s*[•.·]", "\\b([0-9]{1,3})\\b\\s*[•.·]", "[•.·]\\s*([0-9]{1,3})\\b")


def printed_number(text: Column, patterns: tuple[str, ...] = PRINTED, head: int = 300, most: int = 500) -> Column:
    """The first number from 1 to ``most`` that a pattern's first group gives in the head of a page, patterns in order."""
    t = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, head), "\\s+", " ")
    found = [F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: x.cast("int")), lambda n: n.between(1, most)) for p in patterns]
    return F.coalesce(*[F.get(f, 0) for f in found])


def inversions(pages: DataFrame, by: str, order_col: str, number_col: str) -> DataFrame:
    """Rows whose number is one more than the next row's."""
    w = Window.partitionBy(by).orderBy(order_col)
    return pages.withColumn("next_number", F.lead(number_col).over(w)).filter(F.col(number_col) == F.col("next_number") + 1)


def systematic_swaps(pages: DataFrame, by: str, index_col: str, number_col: str) -> DataFrame:
    """(by, index) of swaps that a book's regular inversions imply.

    An inversion at an odd number of 3 or more votes for the index that number 3 would have.  With two votes that are three fifths of
    all, every second index from there up to the largest such number's is a swap.  Indices start at 0 without gaps.
    """
    inv = inversions(pages, by, index_col, number_col).filter((F.col(number_col) >= 3) & (F.col(number_col) % 2 == 1))
    votes = inv.withColumn("start", F.col(index_col) - (F.col(number_col) - 3)).filter("start >= 0")
    tally = votes.groupBy(by, "start").agg(F.count("*").alias("n"), F.max(number_col).alias("top"), F.min(index_col).alias("_first"))
    w = Window.partitionBy(by)
    best = tally.withColumn("_all", F.sum("n").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.col("n").desc(), "_first")))
    best = best.filter((F.col("_k") == 1) & (F.col("n") >= 2) & (F.col("n") >= 0.6 * F.col("_all")))
    ends = pages.groupBy(by).agg(F.count("*").alias("_pages"))
    last = F.least(F.col("_pages") - 2, F.col("start") + F.col("top") - 3)
    return best.join(ends, by).filter(last >= F.col("start")).select(by, F.explode(F.sequence(F.col("start"), last, F.lit(2))).alias(index_col))


def swaps(pages: DataFrame, by: str, index_col: str, number_col: str, systematic: bool = True) -> DataFrame:
    """(by, index) of pages to swap with the next: of each run of consecutive candidates every second, from its first."""
    found = inversions(pages, by, index_col, number_col).select(by, F.col(index_col).cast("long").alias(index_col))
    if systematic:
        found = union(found, systematic_swaps(pages, by, index_col, number_col).select(by, F.col(index_col).cast("long").alias(index_col))).distinct()
    w = Window.partitionBy(by).orderBy(index_col)
    island = found.withColumn("_island", F.col(index_col) - F.row_number().over(w))
    first = Window.partitionBy(by, "_island")
    offset = F.col(index_col) - F.min(index_col).over(first)
    return island.withColumn("_offset", offset).filter(F.col("_offset") % 2 == 0).select(by, index_col)


def apply_swaps(pages: DataFrame, chosen: DataFrame, by: str, index_col: str) -> DataFrame:
    """``pages`` with ``new_index``: swapped pages trade places."""
    here = chosen.select(by, F.col(index_col).alias("_i"))
    moves = here.select(by, F.col("_i").alias(index_col), (F.col("_i") + 1).alias("_to"))
    moves = union(moves, here.select(by, (F.col("_i") + 1).alias(index_col), F.col("_i").alias("_to")))
    return pages.join(moves, [by, index_col], "left").withColumn("new_index", F.coalesce("_to", index_col)).drop("_to")
