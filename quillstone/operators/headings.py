"""Heading candidates of pages and their adaptive filter; chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import ENTITIES, NUMERALS, chapter_number, no_space, visible_text
from quillstone.functions.unions import union

PLAIN_CHAPTER = f"^(第[{NUMERALS}]+[章編编篇部卷])(\\s+(.+))?$"
BARE_CHAPTER = f"^第[{NUMERALS}]+[章編编篇部卷]$"
NUMBER_ONLY = f"^第[{NUMERALS}]+章$"
#: First words that make a heading structural.
KEYWORDS = (
    "Chapter", "Part", "Lecture", "Preface", "Intro", "Appendix", "Prologue", "Epilogue", "Conclusion", "Acknowledgements", "Contents", "Abstract",
    "序", "前言", "导论", "目录", "附录", "后记",
)
#: Headings that split a book for which none are confirmed.
STRUCTURAL = (
    "^#{1,2}\\s+(?:Chapter|Part|Lecture|Preface|Intro|Appendix|Prologue|Epilogue|Conclusion|Book|Acknowledgements|Contents|Abstract"
    f"|序|前言|导论|目录|第[{NUMERALS}]+[篇章讲])"
)


def html_headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", entities: tuple[tuple[str, str], ...] = ENTITIES) -> DataFrame:
    """(id, heading_no, level, title) of h1 to h6 elements in order, with ``entities`` decoded in titles.

    The end of a tag's name is spelled out: by the version of Java ``\\b`` knows ASCII letters only or all letters.
    """
    whole = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit("(?is)(<h([1-6])(?![0-9A-Za-z_])[^>]*>.*?</h\\2>)"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(whole).alias("heading_no", "_h"))
    return rows.select(
        id_col, "heading_no", F.regexp_extract("_h", "(?i)^<h([1-6])", 1).cast("int").alias("level"), visible_text(F.col("_h"), "", entities).alias("title")
    )


def heading_candidates(pages: DataFrame, book_col: str = "book", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """(book, ord, page, level, title, md_line) of markdown pages.

    Lines of one or two ``#`` come first.  Pages without any, and with at most three lines 第X章, then give the first such line among
    their first three, which takes the next line along when bare.  A second-level 第X章 followed by a
    first-level title on the same or next page is one heading.
    """
    lines = pages.select(book_col, page_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line")).filter(~F.trim("line").rlike("^[0-9]+$"))
    title = F.trim(F.regexp_extract("line", "^#{1,2}\\s+(.+)$", 1))
    title = F.trim(F.regexp_replace(F.trim(F.regexp_replace(title, "\\$\\s*\\\\underline\\{(.+?)\\}\\s*\\$", "")), "^[0-9]+\\s+", ""))
    marked = lines.filter(F.col("line").rlike("^#{1,2}\\s+.+$")).select(
        book_col, page_col, "line_no", F.lit(0).alias("pass"), F.length(F.regexp_extract("line", "^(#{1,2})", 1)).alias("level"), title.alias("title"), F.col("line").alias("md_line")
    )
    order = Window.partitionBy(book_col, page_col).orderBy("line_no")
    whole = Window.partitionBy(book_col, page_col)
    plain = lines.join(marked.select(book_col, page_col).distinct(), [book_col, page_col], "left_anti").withColumn("line", F.trim("line")).filter("line != ''")
    hit = F.col("line").rlike(PLAIN_CHAPTER)
    plain = plain.withColumn("_n", F.count_if(hit).over(whole)).withColumn("_i", F.row_number().over(order)).withColumn("_next", F.lead("line").over(order))
    plain = plain.filter(hit & (F.col("_n") <= 3) & (F.col("_i") <= 3)).withColumn("_k", F.row_number().over(order)).filter("_k = 1")
    taken = F.when(F.col("line").rlike(BARE_CHAPTER) & F.col("_next").isNotNull(), F.concat_ws(" ", "line", "_next")).otherwise(F.col("line"))
    found = union(marked, plain.select(book_col, page_col, "line_no", F.lit(1).alias("pass"), F.lit(1).alias("level"), taken.alias("title"), F.col("line").alias("md_line")))
    seq = Window.partitionBy(book_col).orderBy("pass", page_col, "line_no")
    nxt = lambda c: F.lead(c).over(seq)
    merges = (F.col("level") == 2) & F.col("title").rlike(NUMBER_ONLY) & (nxt("level") == 1) & (nxt(page_col) - F.col(page_col)).between(0, 1)
    both = found.withColumn("_m", F.coalesce(merges, F.lit(False))).withColumn("_next_title", nxt("title")).withColumn("_next_line", nxt("md_line"))
    both = both.withColumn("_gone", F.coalesce(F.lag("_m").over(seq), F.lit(False))).withColumn("ord", F.row_number().over(seq)).filter("NOT _gone")
    return both.select(
        book_col, "ord", page_col, F.when(F.col("_m"), 1).otherwise(F.col("level")).alias("level"),
        F.when(F.col("_m"), F.concat_ws(" ", "title", "_next_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_m"), F.col("_next_line")).otherwise(F.col("md_line")).alias("md_line"),
    )


def prune_inline(headings: DataFrame, book_col: str, page_col: str, order_col: str) -> DataFrame:
    """Chapters of the main numbering, and everything after its last page; three headings or more are needed to prune."""
    w = Window.partitionBy(book_col).orderBy(page_col, order_col)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(book_col)
    t = headings.withColumn("_num", chapter_number(F.col("title"))).withColumn("_before", F.max("_num").over(so_far)).withColumn("_i", F.row_number().over(w))
    t = t.withColumn("_restart", F.min(F.when(F.col("_num") < F.col("_before"), F.col("_i"))).over(whole))
    in_main = F.col("_num").isNotNull() & (F.col("_restart").isNull() | (F.col("_i") < F.col("_restart")))
    t = t.withColumn("_last", F.max(F.when(in_main, F.col(page_col))).over(whole)).withColumn("_n", F.count("*").over(whole))
    keep = (F.col("_n") < 3) | F.col("_last").isNull() | (F.col("_num").isNotNull() & (F.col(page_col) <= F.col("_last"))) | (F.col(page_col) > F.col("_last"))
    return t.filter(keep).select(headings.columns)


def filter_headings(candidates: DataFrame, book_col: str = "book", page_col: str = "page", order_col: str = "ord") -> DataFrame:
    """First-level headings past page 2 when a book has four, else keyword headings when it has three, both pruned; else all."""
    whole = Window.partitionBy(book_col)
    keyword = F.col("title").rlike("(?i)^(?:" + "|".join(KEYWORDS) + f"|第[{NUMERALS}]+[篇章节讲])")
    t = candidates.withColumn("_h1", (F.col("level") == 1) & (F.col(page_col) > 2)).withColumn("_kw", keyword)
    t = t.withColumn("_way", F.when(F.count_if("_h1").over(whole) >= 4, 1).when(F.count_if("_kw").over(whole) >= 3, 2).otherwise(3))
    chosen = t.filter(((F.col("_way") == 1) & F.col("_h1")) | ((F.col("_way") == 2) & F.col("_kw"))).select(candidates.columns)
    return union(prune_inline(chosen, book_col, page_col, order_col), t.filter("_way = 3").select(candidates.columns))


def heading_key(title: Column) -> Column:
    """A title's key: no ``#``, underline math, leading number or brackets around 第X章, single spaces."""
    t = F.regexp_replace(F.trim(title), "^#+\\s*", "")
    t = F.regexp_replace(t, "\\$\\s*\\\\underline\\{(.+?)\\}\\s*\\$", "")
    t = F.regexp_replace(F.trim(t), "^[0-9]+\\s+", "")
    t = F.regexp_replace(t, f"^[（(〔【\\[]\\s*(第[{NUMERALS}]+[章節节编編篇部卷])\\s*[）)〕】\\]]", "$1 ")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def header_fingerprints(headings: DataFrame, book_col: str = "book", title_col: str = "title") -> DataFrame:
    """(book, fingerprint): titles without white space, their 第X章 and the rest after it."""
    t = no_space(F.col(title_col))
    number = F.regexp_extract(t, f"^(第[{NUMERALS}]+[章節编編篇卷])", 1)
    parts = F.array_distinct(F.filter(F.array(t, number, F.substring(t, F.length(number) + 1, F.length(t))), lambda x: F.length(x) >= 2))
    return headings.select(book_col, F.explode(parts).alias("fingerprint")).distinct()


def heading_keys(confirmed: DataFrame, book_col: str = "book", page_col: str = "page") -> DataFrame:
    """(book, page, key, title) of confirmed headings: the keys of ``title`` and of ``match`` (an array, if there), and their 第X章 alone.

    Of headings with the same key on a page the last by ``ord``, else by title, counts.
    """
    texts = F.array("title")
    if "match" in confirmed.columns:
        texts = F.concat(texts, F.coalesce(F.col("match"), F.array().cast("array<string>")))
    rank = F.col("ord") if "ord" in confirmed.columns else F.lit(0)
    rows = confirmed.filter(F.trim("title") != "").select(book_col, F.col(page_col).alias("page"), F.col("title"), rank.alias("_o"), F.explode(texts).alias("_t"))
    key = heading_key(F.col("_t"))
    rows = rows.withColumn("key", F.explode(F.array(key, F.regexp_extract(key, f"^(第[{NUMERALS}]+[章節节编編篇卷部])\\s", 1)))).filter("key != ''")
    last = Window.partitionBy(book_col, "page", "key").orderBy(F.col("_o").desc(), F.col("title").desc())
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select(book_col, "page", "key", "title")


def split_chapters(lines: DataFrame, confirmed: DataFrame | None, book_col: str = "book", page_col: str = "page", order_col: str = "line_no") -> DataFrame:
    """Lines with chapter_no, chapter_title and heading (whether the line is a heading that was met), split at confirmed headings.

    ``confirmed`` has (book, page, title), and may have match (array), ord and page_start; a line matches a heading of its own page,
    else of the page before, by key.  Plain lines match once a page, and never on a page that starts a chapter by ``page_start``;
    that chapter begins before the page's first line.  A title repeated by the next heading goes on.  Lines before the first heading
    are chapter 0.  Without ``confirmed`` the structural headings of one or two ``#`` split.
    """
    if confirmed is None:
        both = lines.withColumn("_hit", F.when(F.col("line").rlike(STRUCTURAL), F.trim(F.regexp_extract("line", "^#{1,2}\\s+(.+)$", 1)))).withColumn("_start", F.lit(False))
    else:
        marks = heading_keys(confirmed, book_col, page_col).select(book_col, F.col("page").alias("_p"), F.col("key").alias("_key"), F.col("title").alias("_title"))
        keyed = lines.withColumn("_key", heading_key(F.col("line")))
        here = keyed.join(marks.withColumnRenamed("_p", page_col).withColumnRenamed("_title", "_here"), [book_col, page_col, "_key"], "left")
        before = marks.withColumn(page_col, F.col("_p") + 1).drop("_p").withColumnRenamed("_title", "_before")
        both = here.join(before, [book_col, page_col, "_key"], "left").withColumn("_hit", F.coalesce("_here", "_before"))
        both = both.select(*lines.columns, "_hit", F.lit(False).alias("_start"))
        if "page_start" in confirmed.columns:
            rank = F.col("ord") if "ord" in confirmed.columns else F.lit(0)
            starts = confirmed.filter(F.col("page_start") & (F.trim("title") != "")).groupBy(book_col, F.col(page_col).cast(lines.schema[page_col].dataType).alias(page_col))
            starts = starts.agg(F.max_by("title", F.struct(rank, "title")).alias("_hit"))
            row = [F.col(c) if c in (book_col, page_col) else F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in lines.columns]
            both = union(both, starts.join(lines.select(book_col).distinct(), book_col, "left_semi").select(*row, "_hit", F.lit(True).alias("_start")))
        first = Window.partitionBy(book_col, page_col, "_hit").orderBy(F.col("_start").desc(), order_col)
        started = F.max("_start").over(Window.partitionBy(book_col, page_col))
        plain = (F.row_number().over(first) == 1) & ~started
        both = both.withColumn("_hit", F.when(F.col("_start") | F.col("line").startswith("#") | plain, F.col("_hit")))
    w = Window.partitionBy(book_col).orderBy(page_col, F.col("_start").desc(), order_col)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_prev", F.last("_hit", ignorenulls=True).over(so_far))
    new = F.col("_start") | (F.col("_hit").isNotNull() & ~F.col("_hit").eqNullSafe(F.col("_prev")))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("chapter_no", F.sum(new.cast("int")).over(upto))
        .withColumn("chapter_title", F.coalesce(F.last("_hit", ignorenulls=True).over(upto), F.lit("Content")))
        .filter(~F.col("_start"))
        .select(*lines.columns, "chapter_no", "chapter_title", F.col("_hit").isNotNull().alias("heading"))
    )
