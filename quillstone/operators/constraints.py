"""Integrity of packaged books and of tables: one row per violation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import compact, utf8
from quillstone.functions.unions import union
from quillstone.operators.mapping import grams
from quillstone.operators.toc import BOUNDARY

REQUIRED = ("mimetype", "META-INF/container.xml", "EPUB/content.opf", "EPUB/nav.xhtml", "EPUB/toc.ncx")


def dangling(rows: DataFrame, targets: DataFrame, key: str, label: str, keep: list[str]) -> DataFrame:
    """(keep…, issue) of rows whose key has no target."""
    return rows.join(targets.select(key).distinct(), key, "left_anti").select(*keep, F.lit(label).alias("issue"))


def duplicates(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, issue) of keys that occur more than once."""
    return rows.groupBy(key).count().filter("count > 1").select(key, F.lit(label).alias("issue"))


def package_issues(entries: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(book, severity, issue, detail) from the entries alone: corrupt members, ``mimetype`` not first, compressed or wrong, members missing."""
    row = lambda df, level, issue, detail: df.select("book", F.lit(level).alias("severity"), F.lit(issue).alias("issue"), detail.alias("detail"))
    w = Window.partitionBy("book").orderBy("ord")
    first = entries.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    mime = F.col("path") == "mimetype"
    books = entries.select("book").distinct()
    want = books.withColumn("path", F.explode(F.array(*map(F.lit, required))))
    return union(
        row(entries.filter("NOT crc_ok"), "error", "corrupt member", F.coalesce("path", F.lit(""))),
        row(first.filter(~F.coalesce(mime, F.lit(False))), "error", "mimetype is not the first entry", F.coalesce("path", F.lit(""))),
        row(first.filter(mime & (F.col("compress_type") != 0)), "error", "mimetype is compressed", F.lit("mimetype")),
        row(first.filter(mime & (utf8(F.col("payload")) != "application/epub+zip")), "error", "mimetype has other content", F.lit("mimetype")),
        row(want.join(entries.select("book", "path"), ["book", "path"], "left_anti"), "error", "missing member", F.col("path")),
    )


def structure_issues(structure: DataFrame, entries: DataFrame, elements: DataFrame) -> DataFrame:
    """(book, severity, issue, detail): spine without manifest, targets without member or id, nested nav, counts of nav, ncx and spine that differ."""
    row = lambda df, issue, detail: df.select("book", F.lit("error").alias("severity"), F.lit(issue).alias("issue"), detail.alias("detail"))
    kind = lambda k: structure.filter(F.col("kind") == k)
    members = entries.select("book", F.col("path").alias("member")).distinct()
    ids = elements.select("book", F.col("path").alias("member"), F.explode(F.array_compact(F.array("id", "name"))).alias("fragment")).distinct()
    nav = kind("nav").filter("member IS NOT NULL")
    content = kind("spine").filter(F.col("member").rlike("\\.xhtml$") & ~F.substring_index("member", "/", -1).isin("nav.xhtml", "cover.xhtml"))
    count = lambda df, name: df.groupBy("book").agg(F.count("*").alias(name))
    counts = entries.select("book").distinct().join(count(kind("nav"), "nav"), "book", "left").join(count(kind("ncx"), "ncx"), "book", "left").join(count(content, "spine"), "book", "left").na.fill(0)
    h1 = elements.filter("tag = 'h1'").groupBy("book", F.col("path").alias("member")).agg(F.count("*").alias("n"))
    tops = content.select("book", "member").join(h1, ["book", "member"], "left").na.fill(0, ["n"]).filter("n <> 1")
    return union(
        row(kind("spine").filter("member IS NULL"), "spine idref missing from manifest", F.col("label")),
        row(nav.join(members, ["book", "member"], "left_anti"), "nav target file missing", F.col("href")),
        row(nav.filter("fragment IS NULL"), "nav entry has no fragment", F.col("href")),
        row(nav.filter("fragment IS NOT NULL").join(members, ["book", "member"], "left_semi").join(ids, ["book", "member", "fragment"], "left_anti"), "nav target id missing", F.col("href")),
        row(kind("nav").filter("depth <> 1"), "nested nav entry", F.col("label")),
        row(kind("spine").filter("member IS NOT NULL").join(members, ["book", "member"], "left_anti"), "spine file missing", F.col("member")),
        row(counts.filter("nav <> ncx"), "ncx and nav counts differ", F.concat_ws("/", F.col("ncx").cast("string"), F.col("nav").cast("string"))),
        row(counts.filter("nav <> spine"), "spine and nav counts differ", F.concat_ws("/", F.col("spine").cast("string"), F.col("nav").cast("string"))),
        row(tops, "not exactly one h1", F.concat_ws(": ", "member", F.col("n").cast("string"))),
    )


def report(issues: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, ok, entry_count, errors, warnings), one row a book."""
    n = entries.groupBy("book").agg(F.count("*").alias("entry_count"))
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.concat_ws(": ", "issue", "detail"))))
    found = issues.groupBy("book").agg(pick("error").alias("errors"), pick("warning").alias("warnings"))
    none = F.array().cast("array<string>")
    out = n.join(found, "book", "left").withColumn("errors", F.coalesce("errors", none)).withColumn("warnings", F.coalesce("warnings", none))
    return out.select("book", (F.size("errors") == 0).alias("ok"), "entry_count", "errors", "warnings")


#: First words of structural headings and marks that end a sentence.
STRUCTURAL_HEADING = (
    "^(?:Chapter|Part|Lecture|Preface|Intro|Appendix|Prologue|Epilogue|Conclusion|Book|Acknowledgements|Contents|Abstract|序|前言|导论|目錄|目录|第[零一二三四五六七八九十百千0-9]+[篇章講讲節节編编部卷])"
)
SENTENCE_ENDS = (".", "!", "?", ":", ";", "。", "！", "？", "：", "；", "）", "】", "〉", "》", "」", "』")


def suspicious_headings(elements: DataFrame, spans: DataFrame, least: int = 10, overlap: int = 8) -> DataFrame:
    """(book, path, elem_no, text, reason) of headings that look like body text.

    Headings of ``least`` class characters that are not structural and end like a sentence, or share ``overlap`` characters in a row
    with a corrupted span of their member (``spans``: book, path, span); the shared stretches are joined as k-grams.
    """
    h = elements.filter(F.col("tag").rlike("^h[1-6]$") & ~F.col("text").rlike(STRUCTURAL_HEADING)).withColumn("_c", compact(F.col("text"))).filter(F.length("_c") >= least)
    ended = h.filter(F.right("text", F.lit(1)).isin(*SENTENCE_ENDS)).select("book", "path", "elem_no", "text", F.lit("ends like a sentence").alias("reason"))
    a = h.select("book", "path", "elem_no", "text", F.explode(grams(F.col("_c"), overlap)).alias("_g"))
    b = spans.select("book", "path", F.explode(grams(compact(F.col("span")), overlap)).alias("_g")).distinct()
    shared = a.join(b, ["book", "path", "_g"], "left_semi").select("book", "path", "elem_no", "text", F.lit("overlaps a corrupted span").alias("reason")).distinct()
    return union(ended, shared)


def reading_issues(structure: DataFrame, elements: DataFrame, front_matter: tuple[str, ...] = (), unwanted: tuple[str, ...] = ()) -> DataFrame:
    """(book, issue, detail): nav and ncx labels and first-level headings that are no reading boundary, or that are unwanted.

    Front matter and unwanted texts are lists of the book at hand.
    """
    labels = structure.filter(F.col("kind").isin("nav", "ncx")).select("book", F.col("kind").alias("where"), "label")
    tops = elements.filter("tag = 'h1'").select("book", F.col("path").alias("where"), F.col("text").alias("label"))
    rows = union(labels, tops)
    fold = lambda c: F.regexp_replace(F.translate(F.translate(c, "，–—闕内", ",--閥內"), "「」\u3000", ""), "\\s+", "")
    known = F.col("label").isin(*front_matter) if front_matter else F.lit(False)
    bad = F.lit(False)
    for text in unwanted:
        bad = bad | (fold(F.col("label")) == fold(F.lit(text)))
    detail = F.concat_ws(": ", "where", "label")
    return union(
        rows.filter(~known & ~F.col("label").rlike(BOUNDARY)).select("book", F.lit("not a reading boundary").alias("issue"), detail.alias("detail")),
        rows.filter(bad).select("book", F.lit("unwanted text remains").alias("issue"), detail.alias("detail")),
    )
