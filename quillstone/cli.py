"""Command line: scan, boundaries, verify, chapterize and rebuild.

    python -m quillstone.cli scan BOOKS [--limit N] [--min-score X] [--min-chars N] [--json OUT]
    python -m quillstone.cli boundaries CHECKPOINTS [--limit N] [--min-score X] [--books BOOKS] [--json OUT]
    python -m quillstone.cli verify BOOKS [--json OUT]            (exit code 1 when there are issues)
    python -m quillstone.cli chapterize BOOKS OUT [--front-matter TITLE ...] [--verify-only]
    python -m quillstone.cli repair BOOKS OUT [--strict]
    python -m quillstone.cli rebuild CHECKPOINTS OUT [--title T] [--author A] [--language L] [--cover FILE] [--toc FILE] [--strict]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.shared import stored
from quillstone.functions.unions import union
from quillstone.operators import boundaries, constraints, headings, lines, ngrams, noise, repair, rewrite, toc
from quillstone.sources import checkpoints, epub


def env_int(name: str, default: int, least: int | None = None) -> int:
    """An integer setting; the default where it is unset, malformed or below ``least``."""
    try:
        value = int(os.environ[name])
    except (KeyError, ValueError):
        return default
    return default if least is not None and value < least else value


def scan(spark: SparkSession, books: str, limit: int = 50, min_score: float = 0.70, min_chars: int = 10) -> DataFrame:
    """The most suspicious fragments of packaged books."""
    texts = epub.content_texts(epub.read_entries(spark, books)).withColumn("file", F.concat_ws("!", "book", "path"))
    found = ngrams.suspicious_spans(texts, ["book"], "file", min_score=min_score, min_chars=min_chars, limit=limit)
    return found.select("book", "file", "score", "n_chars", "excerpt")


def scan_boundaries(spark: SparkSession, folder: str, limit: int = 80, min_score: float = 0.70, books: str | None = None) -> DataFrame:
    """Page boundaries where text is probably missing; with packaged ``books``, whether the seam's text goes on in the book of the folder's name."""
    pages = checkpoints.read_checkpoints(spark, folder)
    model = ngrams.bigram_model(pages, ["book"], order_col="seq_page")
    found = boundaries.score_boundaries(pages, "book", "pdf_page", "text", model)
    found = found.filter(F.col("score") >= min_score).orderBy(F.col("score").desc(), "book", "pdf_page").limit(limit)
    if not books:
        return found
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), "\\.epub$", "")
    text = lambda c: pages.select("book", F.col("pdf_page").alias(c), F.col("text").alias(f"_{c}"))
    seams = found.join(text("pdf_page"), ["book", "pdf_page"]).join(text("next_order"), ["book", "next_order"]).withColumn("name", name(F.col("book")))
    parts = epub.content_texts(epub.read_entries(spark, books)).withColumn("name", name(F.col("book")))
    whole = parts.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book", "ord", "text"))), lambda x: x.text), "").alias("text"))
    return boundaries.continuity_in_books(seams, whole, "name", "_pdf_page", "_next_order").select(*found.columns, "status").orderBy(F.col("score").desc(), "book", "pdf_page")


def verify(spark: SparkSession, books: str) -> DataFrame:
    """One report a book."""
    entries = epub.read_entries(spark, books)
    good = entries.filter("path IS NOT NULL")
    issues = union(constraints.package_issues(entries), constraints.structure_issues(epub.structure(good), good, epub.text_elements(good)))
    return constraints.report(issues, entries)


def chapterize(spark: SparkSession, books: str, out: str, front_matter: tuple[str, ...] = ()) -> DataFrame:
    """Books of one member a reading unit, written to ``out``."""
    entries = epub.read_entries(spark, books)
    found = epub.structure(entries)
    spine = found.filter("kind = 'spine'").select("book", F.col("member").alias("path"), F.col("ord").alias("spine_no"))
    marks = toc.reading_boundaries(found.filter("kind = 'nav'"), front_matter)
    children = epub.body_children(entries)
    errors = toc.boundary_errors(children, marks)
    if bad := errors.limit(20).collect():  # a report of the first errors
        raise RuntimeError("; ".join(f"{r.book}: {r.issue} {r.detail}" for r in bad))
    return epub.write_books(rewrite.chapterize(toc.reading_segments(children, marks, spine), marks, entries), out)


def reading_report(spark: SparkSession, books: str) -> DataFrame:
    """One report a book of the rules that books of one member a reading unit keep."""
    entries = stored(epub.read_entries(spark, books), "entries")
    good = entries.filter("path IS NOT NULL")
    issues = constraints.reading_issues(epub.structure(good), epub.text_elements(good)).withColumn("severity", F.lit("error"))
    return constraints.report(issues, entries)


def publish(entries: DataFrame, out: str, strict: bool = False) -> DataFrame:
    """Entries whose targets start pages, written to ``out``; with ``strict`` nothing is written while artefacts are left in texts.

    A report of the first artefacts is printed, or raised.  Each book takes its name when its file is complete.
    """
    entries = stored(entries, "books")
    entries = rewrite.start_pages(entries, epub.structure(entries))
    left = noise.noise_tokens(epub.content_texts(entries), ["book", "path"], "xhtml").orderBy("book", "path", "token").limit(8).collect()
    if left:
        message = "artefacts are left: " + ", ".join(f"{r.book}!{r.path}: {r.token} x{r.n}" for r in left)
        if strict:
            raise RuntimeError(message)
        print(message)
    return epub.write_books(entries, out)


def repair_books(spark: SparkSession, books: str, out: str, strict: bool = False) -> DataFrame:
    """Books whose tables of contents point to their markers, written to ``out``."""
    return publish(repair.repair_toc(stored(epub.read_entries(spark, books).filter("path IS NOT NULL"), "entries")), out, strict)


def rebuild(
    spark: SparkSession, folder: str, out: str, title: str = "", toc_path: str | None = None, author: str = "", language: str = "zh-Hant", cover: bytes | None = None,
    strict: bool = False,
) -> DataFrame:
    """Books from page checkpoints, with the headings of a TOC file or those found, written to ``out``.

    A paragraph that a page breaks goes on with the next page's first one, within a chapter.
    """
    pages = checkpoints.read_checkpoints(spark, folder).withColumn("text", noise.clean_captions(noise.clean_ocr_noise(F.col("text"))))
    pages = pages.withColumn("page", F.col("seq_page"))
    if toc_path:
        marks = pages.select("book").distinct().crossJoin(F.broadcast(checkpoints.read_toc(spark, toc_path)))  # one row a heading of one file
    else:
        marks = headings.filter_headings(headings.heading_candidates(pages)).select("book", "page", "title")
    split = lines.explode_lines(pages.withColumn("_k", F.struct("book", "page")), "_k").select("_k", "line_no", "line")
    named = marks.withColumn("title", F.explode("source")) if toc_path else marks
    prints = headings.header_fingerprints(named).join(pages.select("book", "page"), "book").select(F.struct("book", "page").alias("_k"), "fingerprint")
    own = headings.heading_keys(marks).select(F.struct("book", "page").alias("_k"), F.col("key").alias("_h"))
    kept = split.withColumn("_h", headings.heading_key(F.col("line"))).join(own.withColumn("_own", F.lit(True)), ["_k", "_h"], "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    clean = lines.strip_page_headers(kept.select("_k", "line_no", "line", "_own"), prints, "_k", "_own")
    clean = clean.join(kept.filter("_own").select("_k", "line_no", F.rtrim("line").alias("_own")), ["_k", "line_no"], "left")
    text = clean.groupBy("_k").agg(F.collect_set("_own").alias("own"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("text"))
    flowed = text.select("_k.book", "_k.page", "own", lines.reflow(F.col("text"), confirmed=F.col("own")).alias("p"))
    paragraphs = lines.join_pages(flowed, "book", "page", "p", "own").select("book", "page", F.col("paragraph_no").alias("line_no"), F.col("paragraph").alias("line"), "continues")
    chapters = headings.split_chapters(paragraphs, marks)
    body = chapters.filter(~F.col("heading") & (headings.heading_key(F.col("line")) != headings.heading_key(F.col("chapter_title"))))
    order = Window.partitionBy("book", "chapter_no").orderBy("page", "line_no")
    first = F.col("continues") & (F.row_number().over(order) > 1)
    joined = body.withColumn("_new", (~first).cast("int")).withColumn("_p", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: F.trim(x.line))
    rows = joined.groupBy("book", "chapter_no", F.col("_p").alias("ord")).agg(F.first("chapter_title").alias("chapter_title"), F.array_join(pieces, " ").alias("paragraph"))
    return publish(rewrite.rebuild(rows, title, author, language, cover), out, strict)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("scan")
    a.add_argument("books"), a.add_argument("--limit", type=int, default=50), a.add_argument("--min-score", type=float, default=0.70)
    a.add_argument("--min-chars", type=int, default=10), a.add_argument("--json")
    b = sub.add_parser("boundaries")
    b.add_argument("folder"), b.add_argument("--limit", type=int, default=80), b.add_argument("--min-score", type=float, default=0.70), b.add_argument("--books"), b.add_argument("--json")
    v = sub.add_parser("verify")
    v.add_argument("books"), v.add_argument("--json")
    c = sub.add_parser("chapterize")
    c.add_argument("books"), c.add_argument("out", nargs="?"), c.add_argument("--front-matter", nargs="*", default=[]), c.add_argument("--verify-only", action="store_true")
    t = sub.add_parser("repair")
    t.add_argument("books"), t.add_argument("out"), t.add_argument("--strict", action="store_true")
    r = sub.add_parser("rebuild")
    r.add_argument("folder"), r.add_argument("out"), r.add_argument("--title", default=""), r.add_argument("--toc"), r.add_argument("--author", default="")
    r.add_argument("--language", default="zh-Hant"), r.add_argument("--cover"), r.add_argument("--strict", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    if args.command == "scan":
        found = scan(spark, args.books, args.limit, args.min_score, args.min_chars)
    elif args.command == "boundaries":
        found = scan_boundaries(spark, args.folder, args.limit, args.min_score, args.books)
    elif args.command == "verify":
        found = verify(spark, args.books)
    elif args.command == "chapterize" and args.verify_only:
        found = reading_report(spark, args.books)
    elif args.command == "chapterize":
        found = chapterize(spark, args.books, args.out, tuple(args.front_matter))
    elif args.command == "repair":
        found = repair_books(spark, args.books, args.out, args.strict)
    else:
        cover = None
        if args.cover:
            with open(args.cover, "rb") as f:
                cover = f.read()
        found = rebuild(spark, args.folder, args.out, args.title, args.toc, args.author, args.language, cover, args.strict)
    if getattr(args, "json", None):
        checkpoints.write_report(found, args.json)
    found.show(20, truncate=60)
    checks = args.command == "verify" or getattr(args, "verify_only", False)
    return int(checks and found.filter("NOT ok").limit(1).count() > 0)


if __name__ == "__main__":
    sys.exit(main())
