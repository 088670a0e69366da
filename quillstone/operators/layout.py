"""Text blocks of pages with coordinates, and sections of books.

A block table has (book, page, block_no, x0, y0, x1, y1, text, page_height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.operators.lines import clean_lines, join_pdf_lines

#: Shares of a page's height above which a block is a header, and below which it is a footer.
HEADER, FOOTER = 0.065, 0.732
COLUMN_X = 200.0
CAPTION = "(?i)\\b(?:Figure|Table)\\s+[0-9]+(?:\\.[0-9]+)?"


def is_header_or_footer(y0: Column, text: Column, height: Column) -> Column:
    return (F.size(clean_lines(text)) == 0) | (y0 < height * HEADER) | (y0 > height * FOOTER)


def page_blocks(blocks: DataFrame, two_columns_from: int | None = None, drop_headers: bool = True) -> DataFrame:
    """(book, page, ord, text): blocks in reading order, joined to one line each, empty ones left out.

    Order is from the top, then from the left; from page ``two_columns_from`` the left column comes first.
    """
    two = F.lit(False) if two_columns_from is None else F.col("page") >= two_columns_from
    kept = blocks.filter(~is_header_or_footer(F.col("y0"), F.col("text"), F.col("page_height"))) if drop_headers else blocks
    joined = kept.withColumn("text", join_pdf_lines(clean_lines(F.col("text")))).filter("text <> ''")
    column = F.when(two & (F.col("x0") >= COLUMN_X), 1).otherwise(0)
    first = F.when(two, F.col("y0")).otherwise(F.round("y0", 1))
    w = Window.partitionBy("book", "page").orderBy(column, first, F.when(two, F.col("x0")).otherwise(F.round("x0", 1)), "block_no")
    return joined.select("book", "page", F.row_number().over(w).alias("ord"), "text")


def parse_sections(specs: list[str], pages: int) -> list[tuple[str, int, int]]:
    """(title, first, last) of ``Title:first-last``; ValueError where malformed or out of bounds."""
    out = []
    for spec in specs:
        title, colon, span = spec.rpartition(":")
        first, dash, last = span.partition("-")
        if not colon or not dash or not first.strip().isdigit() or not last.strip().isdigit():
            raise ValueError(f"section {spec!r} is not 'Title:first-last'")
        if not 1 <= int(first) <= int(last) <= pages:
            raise ValueError(f"section {spec!r} is out of bounds")
        out.append((title.strip(), int(first), int(last)))
    return out


def default_sections(outline: DataFrame, books: DataFrame, size: int = 50) -> DataFrame:
    """(book, title, first, last): from each first-level outline entry to the next, or runs of ``size`` pages without any.

    ``outline`` has (book, ord, level, title, page), ``books`` (book, page_count).
    """
    top = outline.filter("level = 1").join(books, "book").filter(F.col("page").between(1, F.col("page_count")))
    w = Window.partitionBy("book").orderBy("ord")
    marked = top.withColumn("_next", F.lead("page").over(w)).select("book", "title", F.col("page").alias("first"), (F.coalesce("_next", F.col("page_count") + 1) - 1).alias("last"))
    bare = books.join(top.select("book").distinct(), "book", "left_anti").filter("page_count > 0")
    runs = bare.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"), F.lit(size))))
    last = F.least(F.col("first") + size - 1, F.col("page_count").cast("int"))
    return union(marked, runs.select("book", F.format_string("Pages %d-%d", F.col("first"), last).alias("title"), "first", last.alias("last")))


def section_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages with the sections that hold them, by a range join within each book."""
    s = sections.select(F.col("book").alias("_b"), F.col("title").alias("section"), "first", "last")
    return pages.join(s, (F.col("book") == F.col("_b")) & F.col("page").between(F.col("first"), F.col("last"))).drop("_b", "first", "last")


def paragraph_html(text: Column, first: Column, index_page: Column) -> Column:
    """A paragraph with its class: index entries, and openings, short ones and captions without indent."""
    escaped = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    plain = first | (F.length(text) < 90) | text.rlike("^(Table|Figure)\\s+[0-9]")
    kind = F.when(index_page, ' class="index-entry"').when(plain, ' class="noindent"').otherwise("")
    return F.concat(F.lit("<p"), kind, F.lit(">"), escaped, F.lit("</p>"))


def is_visual(page: Column, images: Column, drawings: Column, text: Column) -> Column:
    """Pages with images, five drawings, or captions; a cover of images is none."""
    found = (images > 0) | (drawings >= 5) | (text.rlike(CAPTION) & ((drawings > 0) | text.contains("Table ") | text.contains("Figure ")))
    return found & ~((page == 1) & (images > 0))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(book, missing, surplus): expected values that are not found, and the other way round."""
    a = expected.groupBy("book").agg(F.collect_set(key).alias("_a"))
    b = found.groupBy("book").agg(F.collect_set(key).alias("_b"))
    both = a.join(b, "book", "full")
    a, b = (F.coalesce(c, F.array().cast(both.schema[c].dataType)) for c in ("_a", "_b"))
    return both.select("book", F.sort_array(F.array_except(a, b)).alias("missing"), F.sort_array(F.array_except(b, a)).alias("surplus"))
