"""Lines of documents: exploding, running headers, segments, paragraph reflow.

A line table has (id, line_no, line); ``line_no`` starts at 0 and gives the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import CHAPTER, CJK, NO_JOIN, TERMINAL, ends_with_any, is_page_number, looks_like_linewrap, no_space

#: Fixed value: a short title in brackets or quotes.
BRACKETED = '^(?:「[^」]{1,20}」|『[^』]{1,20}』|"[^"]{1,20}")$'
LOOSE_BRACKETED = '^[「『"][^」』"]{1,20}[」』"]$'
SPECIAL = "^(#{1,6}\\s|>|\\s*[-*]\\s|[0-9]+\\.)"


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line); a null text has no lines, an empty one has one empty line."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))


def repeated_lines(lines: DataFrame, id_col: str = "doc_id", least: int = 2) -> DataFrame:
    """(id, line, n) of trimmed lines that occur ``least`` times or more in a document."""
    trimmed = lines.select(id_col, F.trim("line").alias("line")).filter(F.col("line") != "")
    return trimmed.groupBy(id_col, "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def running_headers(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line, n, kind) of lines that look like running headers; kind is ``h1`` or ``plain``.

    A first-level heading counts when it is a number of up to four digits or repeated.  A plain line of three characters
    or more counts when it occurs three times and is chapter-like, bracketed or at most 15 characters long, or twice and
    is bracketed, at most 10 long, or chapter-like and at most 25 long.
    """
    counted = repeated_lines(lines, id_col, 1)
    s, n = F.col("line"), F.col("n")
    h1 = s.startswith("# ") & (F.substring(s, F.lit(3), F.length(s)).rlike("^[0-9]{1,4}$") | (n >= 2))
    chapter, bracket, size = s.rlike(CHAPTER), s.rlike(LOOSE_BRACKETED), F.length(s)
    plain = (
        ~s.startswith("#") & (size >= 3) & ~s.rlike("^[0-9]+$")
        & (((n >= 3) & (chapter | bracket | (size <= 15))) | ((n == 2) & (bracket | (size <= 10) | (chapter & (size <= 25)))))
    )
    return counted.select(id_col, "line", "n", F.when(h1, "h1").when(plain, "plain").alias("kind")).filter(F.col("kind").isNotNull())


def split_segments(lines: DataFrame, headers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines with ``segment``: 0 before the first header line, then one more at each.

    A document is split at its ``h1`` headers, or at the plain ones when it has no other.  Header lines keep their
    place and are marked ``is_header``.
    """
    both = headers.select(F.col(id_col).alias("_id"), F.col("line").alias("_line"), "kind")
    has = headers.groupBy(F.col(id_col).alias("_own")).agg(F.max(F.col("kind") == "h1").alias("_h1"))
    joined = (
        lines.join(both, (F.col(id_col) == F.col("_id")) & (F.trim("line") == F.col("_line")), "left")
        .join(has, F.col(id_col) == F.col("_own"), "left")
        .withColumn("is_header", F.coalesce(F.col("kind") == F.when(F.col("_h1"), "h1").otherwise("plain"), F.lit(False)))
    )
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(id_col, "line_no", "line", "is_header", F.sum(F.col("is_header").cast("int")).over(order).alias("segment"))


def trim_segments(segments: DataFrame, headers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, segment, text): segments without header lines at either end and without leading page numbers."""
    names = headers.select(F.col(id_col).alias("_id"), F.regexp_replace("line", "^# ", "").alias("_name")).distinct()
    body = segments.filter(~F.col("is_header")).withColumn("_t", F.trim("line"))
    body = body.join(names, (F.col(id_col) == F.col("_id")) & (F.col("_t") == F.col("_name")), "left")
    own = Window.partitionBy(id_col, "segment")
    real = F.when(F.col("_name").isNull() & (F.col("_t") != ""), F.col("line_no"))
    inner = body.withColumn("_a", F.min(real).over(own)).withColumn("_b", F.max(real).over(own)).filter(F.col("line_no").between(F.col("_a"), F.col("_b")))
    ahead = own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = inner.withColumn("_n", F.max(~F.col("_t").rlike("^[0-9]{1,4}$")).over(ahead)).filter("_n")
    return kept.groupBy(id_col, "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("text")
    )


def strip_page_headers(lines: DataFrame, fingerprints: DataFrame, id_col: str = "doc_id", preserved: str | None = None) -> DataFrame:
    """Lines without running headers and page numbers; (id, line_no, line).

    ``fingerprints`` has (id, fingerprint): titles without white space.  A line goes when it is a page number, a fingerprint,
    chapter-like with at most 25 characters and no ``#``, or a bracketed title at an end of the page or next to a page number;
    a page number after a header goes too.  Pages of one line and lines flagged in the column ``preserved`` stay.
    White-space lines go, empty ones stay.
    """
    own = Window.partitionBy(id_col)
    order = own.orderBy("line_no")
    s = F.trim("line")
    marks = fingerprints.select(F.col(id_col).alias("_id"), F.col("fingerprint").alias("_fp")).distinct()
    t = lines.join(marks, (F.col(id_col) == F.col("_id")) & (no_space(F.col("line")) == F.col("_fp")), "left")
    t = t.withColumn("_n", F.count("*").over(own)).withColumn("_num", is_page_number(F.col("line")))
    near = (
        (F.row_number().over(order) == 1) | (F.row_number().over(order) == F.col("_n"))
        | F.coalesce(F.lag("_num").over(order), F.lit(False)) | F.coalesce(F.lead("_num").over(order), F.lit(False))
    )
    header = (s != "") & ~F.col("_num") & (
        F.col("_fp").isNotNull() | (s.rlike(CHAPTER) & ~s.startswith("#") & (F.length(s) <= 25)) | (s.rlike(BRACKETED) & (F.length(s) <= 20) & near)
    )
    keep = F.col(preserved) if preserved else F.lit(False)
    t = t.withColumn("_header", header & ~keep).withColumn("_keep", keep)
    gone = (F.col("_n") >= 2) & ((F.col("_num") & ~F.col("_keep")) | F.col("_header") | (F.col("_num") & F.coalesce(F.lag("_header").over(order), F.lit(False))))
    out = t.withColumn("line", F.when(gone, F.lit("")).otherwise(F.col("line")))
    return out.filter((F.trim("line") != "") | (F.col("line") == "") | (F.col("_n") < 2)).select(id_col, "line_no", "line")


def is_special(line: Column, confirmed: Column | None = None) -> Column:
    """Headings, quotes, lists and short chapter lines, which stand alone."""
    found = line.rlike(SPECIAL) | (line.rlike(CHAPTER) & (F.length(line) <= 25))
    return found | confirmed if confirmed is not None else found


def reflow(text: Column, char_class: str = CJK, confirmed: Column | None = None) -> Column:
    """The paragraphs of a page as an array, from its lines.

    Lines are folded in order.  A special line stands alone, as do those in the array ``confirmed``.  After two or more blank lines a paragraph ends only if it ends
    terminally; after one it goes on across a wrapped line, ends if terminal, ends before a longer terminal line unless it
    has an open comma, and goes on otherwise; without blanks it ends if terminal or if its last mark joins nothing.
    Joins put one space.
    """
    start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("blank"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.rtrim(raw)
        cur = F.rtrim(acc.cur)
        ends = ends_with_any(cur, TERMINAL)
        done = F.when(acc.cur != "", F.array_append(acc.done, acc.cur)).otherwise(acc.done)
        after_one = ~looks_like_linewrap(cur, line, char_class=char_class) & (
            ends | ((F.length(line) > 20) & ends_with_any(line, TERMINAL) & ~cur.endswith("，"))
        )
        close = F.when(acc.blank >= 2, ends).when(acc.blank == 1, after_one).otherwise(ends | ends_with_any(cur, NO_JOIN))
        new = lambda c, b, d: F.struct(c.alias("cur"), b.alias("blank"), d.alias("done"))
        zero = F.lit(0)
        return (
            F.when(line == "", new(acc.cur, acc.blank + 1, acc.done))
            .when(is_special(line, None if confirmed is None else F.array_contains(confirmed, line)), new(F.lit(""), zero, F.array_append(done, line)))
            .when(acc.cur == "", new(line, zero, acc.done))
            .when(close, new(line, zero, F.array_append(acc.done, acc.cur)))
            .otherwise(new(F.concat(cur, F.lit(" "), line), zero, acc.done))
        )

    return F.aggregate(
        F.split(F.coalesce(text, F.lit("")), "\n", -1), start, step, lambda acc: F.when(acc.cur != "", F.array_append(acc.done, acc.cur)).otherwise(acc.done)
    )


def join_pages(pages: DataFrame, book_col: str, order_col: str, paragraphs_col: str, confirmed_col: str | None = None) -> DataFrame:
    """(book, order, paragraph_no, paragraph, continues): whether a page's first paragraph goes on from the page before.

    It does when the text before doesn't end terminally and the page doesn't begin with a special line, or with one of the array
    ``confirmed_col``; nor does text go on from such a line.  Pages without paragraphs are passed over.
    """
    w = Window.partitionBy(book_col).orderBy(order_col)
    real = pages.filter(F.size(paragraphs_col) > 0)
    tail = F.lag(F.element_at(paragraphs_col, -1)).over(w)
    alone = lambda i: F.array_contains(confirmed_col, F.element_at(paragraphs_col, i)) if confirmed_col else F.lit(False)
    open_tail = tail.isNotNull() & ~ends_with_any(F.rtrim(tail), TERMINAL) & ~is_special(tail) & ~F.lag(alone(-1)).over(w)
    goes_on = open_tail & ~is_special(F.element_at(paragraphs_col, 1)) & ~alone(1)
    return (
        real.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
        .select(book_col, order_col, "_on", F.posexplode(paragraphs_col).alias("paragraph_no", "paragraph"))
        .withColumn("continues", F.col("_on") & (F.col("paragraph_no") == 0))
        .drop("_on")
    )


def join_pdf_lines(lines: Column) -> Column:
    """Lines of a block as one text: a hyphen at a line's end goes, closing marks follow without a space, other seams get one."""
    joined = F.aggregate(
        lines,
        F.lit(None).cast("string"),
        lambda acc, x: F.when(acc.isNull(), x)
        .when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), x))
        .when(x.rlike("^[,.;:?!)]"), F.concat(acc, x))
        .otherwise(F.concat(acc, F.lit(" "), x)),
    )
    return F.trim(F.regexp_replace(F.coalesce(joined, F.lit("")), "\\s+", " "))


def clean_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
