"""Queries over generated rows, for rules that the given tables have no cases of.  Each has SQL in ``fixture_oracles`` that works the answer out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import boundaries, footnotes, images, ngrams, noise, ordering, patching, repair

TAIL = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"
HEAD = "閏餘成歲律呂調陽雲騰致雨露結為霜金生麗水玉出崑岡劍號巨闕"


def repaired_order(spark, sf_dir) -> DataFrame:
    """300 books of 12 pages: all pairs swapped, swaps that only the book's regularity implies, and pages in order."""
    i, n = F.col("idx"), F.col("idx") - 1
    other = F.when(n % 2 == 0, n + 1).otherwise(n - 1)
    regular = F.when(n < 1, None).when(n == 1, 1).when((F.col("book") % 2 == 0) & i.isin(3, 4), None).otherwise(other)
    printed = F.when(F.col("book") % 3 == 0, 100 + i + 1 - 2 * (i % 2)).when(F.col("book") % 3 == 1, regular).otherwise(50 + i)
    p = spark.range(3600).select((F.col("id") / 12).cast("int").alias("book"), (F.col("id") % 12).cast("int").alias("idx")).withColumn("printed", printed.cast("int"))
    found = ordering.apply_swaps(p, ordering.swaps(p, "book", "idx", "printed"), "book", "idx")
    return found.select("book", "idx", F.col("new_index").cast("long").alias("new_index"))


def noise_tables(spark, sf_dir) -> DataFrame:
    """300 tables: grids of years, lists of dotted numbers, and plain ones, of many sizes."""
    k, size = F.col("table_id"), 8 + F.col("table_id") % 19
    first = 1880 + 40 * (F.col("table_id") % 9)
    row = lambda r: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), (first + r + c).cast("string"), F.lit("</td>")) for c in range(3)], F.lit("</tr>"))
    years = F.array_join(F.transform(F.sequence(F.lit(1), size), row), "")
    prefix = lambda c: F.when((k % 4 == 1) & (c % 2 == 0), "4.2.").otherwise("3.1.")
    dotted = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda c: F.concat(F.lit("<td>"), prefix(c), c.cast("string"), F.lit("</td>"))), "")
    plain = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda c: F.concat(F.lit("<tr><td>Revenue "), c.cast("string"), F.lit("</td></tr>"))), "")
    body = F.when(k % 3 == 0, years).when(k % 3 == 1, F.concat(F.lit("<tr>"), dotted, F.lit("</tr>"))).otherwise(plain)
    t = spark.range(300).select(F.col("id").cast("int").alias("table_id")).withColumn("html", F.concat(F.lit("<table>"), body, F.lit("</table>")))
    h = F.col("html")
    return t.select("table_id", noise.is_year_table(h).alias("years"), noise.is_outline_table(h).alias("outline"), (F.length(noise.drop_noise_tables(h)) > 0).alias("kept"))


def chinese_numerals(spark, sf_dir) -> DataFrame:
    """Chapters 1 to 999 in Chinese and in Arabic numerals, and sections, which have no chapter number."""
    n = F.col("n")
    digit = lambda x: F.element_at(F.array(*map(F.lit, "零一二三四五六七八九")), (x + 1).cast("int"))
    h, t, u = F.floor(n / 100), F.floor(n / 10) % 10, n % 10
    hundreds = F.when(h > 0, F.concat(digit(h), F.lit("百"))).otherwise("")
    tens = F.when(t > 0, F.concat(F.when((h == 0) & (t == 1), "").otherwise(digit(t)), F.lit("十"))).when((h > 0) & (u > 0), "零").otherwise("")
    numeral = F.concat(hundreds, tens, F.when(u > 0, digit(u)).otherwise(""))
    title = F.when(F.col("kind") == 0, F.concat(F.lit("第"), numeral, F.lit("章 題"))).when(F.col("kind") == 1, F.concat(F.lit("第"), n.cast("string"), F.lit("章")))
    title = title.otherwise(F.concat(F.lit("第"), numeral, F.lit("節")))
    rows = spark.range(999 * 3).select((F.col("id") / 3).cast("int").alias("n"), (F.col("id") % 3).cast("int").alias("kind")).withColumn("n", n + 1).withColumn("title", title)
    return rows.select("n", "kind", "title", T.chapter_number(F.col("title")).alias("number"), T.chapter_number(F.col("title"), fix_hundreds=False).alias("literal"))


def cjk_repeats(spark, sf_dir) -> DataFrame:
    """400 texts of two runs with other characters and marks in between."""
    k = F.col("doc_id")
    t = F.concat(F.repeat(F.lit("三"), k % 12), F.lit("，甲乙 "), F.repeat(F.lit("丁。"), (k * 7) % 11), F.lit("x"))
    return ngrams.repeat_runs(spark.range(400).select(F.col("id").cast("int").alias("doc_id")).withColumn("text", t))


def page_start_alignment(spark, sf_dir) -> DataFrame:
    """200 pages whose start stands after 0 to 28 more characters in a second reading, or that have no second reading."""
    k = F.col("id")
    second = F.when(k % 5 == 4, "").otherwise(F.concat(F.substring(F.lit(HEAD), F.lit(1), (k % 29).cast("int")), F.lit(TAIL)))
    p = spark.range(200).withColumn("head", F.lit(TAIL)).withColumn("second", second)
    return boundaries.align_page_starts(p, "head", "second").select("id", "offset", F.round("similarity", 3).alias("similarity"), "possible_omission")


def diff_patch(spark, sf_dir) -> DataFrame:
    """150 chunks of two pages, the second one garbled with a good second reading, the same in it, or without one."""
    bad, good = TAIL + "居之者忽音但一通乃一祔一筆八" + TAIL, TAIL + TAIL[:14] + TAIL
    k = F.col("chunk")
    text = F.when(F.col("page") == 1, TAIL * 3).when(k % 3 == 2, good).otherwise(bad)
    second = F.when(F.col("page") == 1, TAIL * 3).when(k % 3 == 0, good).when(k % 3 == 1, bad)
    rows = spark.range(300).select((F.col("id") / 2).cast("int").alias("chunk"), (F.col("id") % 2 + 1).cast("int").alias("page"))
    return patching.patch_pages(rows.withColumn("text", text).withColumn("second", second), "chunk", "page", "text", "second")


def kth_occurrence_link(spark, sf_dir) -> DataFrame:
    """300 pages of up to nine markers in cycles of three numbers, and up to seven numbered notes."""
    p = spark.range(300).select(F.col("id").cast("int").alias("page"))
    marks = lambda j: F.concat(F.lit("x$ ^{"), (1 + j % 3).cast("string"), F.lit("} $"))
    texts = p.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(0), F.col("page") % 9), marks), " "))
    notes = p.select("page", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("page") % 7), lambda j: F.concat((1 + (j * 2) % 3).cast("string"), F.lit(" note")))).alias("note_no", "note"))
    m = footnotes.inline_markers(texts, ["page"], "text")
    linked = footnotes.link_notes(footnotes.number_notes(notes, m, ["page"]), m, ["page"])
    return linked.select("page", "marker_no", "number", F.col("occurrence").cast("long").alias("occurrence"), "note_no")


def visual_fallbacks(spark, sf_dir) -> DataFrame:
    """400 pages of all kinds of text, pictures, ink and shape."""
    k = F.col("page")
    text = F.when(k % 3 == 0, "# 家系圖").when(k % 3 == 1, "").otherwise("text")
    pictures = F.when(k % 7 == 0, F.create_map(F.lit("imgs/x.png"), F.lit(""))).when(k % 7 == 1, F.create_map(F.lit("imgs/a.png"), F.lit(""))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    p = spark.range(400).select((F.col("id") + 1).cast("int").alias("page")).withColumns(
        {"text": text, "images": pictures, "assets": F.array(F.lit("imgs/a.png")), "ink": (k % 4) / 100.0, "width": F.lit(100.0), "height": 50.0 * (1 + k % 4)}
    )
    return images.fallback_images(p, "page", "text", "images", "assets", "ink", "width", "height").select("page", "fallback_path", "rotation")


CAPTION = "Close-up of a man standing in front of a house (no visible text or symbols)"


def caption_cleanup(spark, sf_dir) -> DataFrame:
    """500 texts: a label before a text, a generated alt text, a misplaced end, a caption that stays and one that goes; gaps of one to three line ends."""
    k, gap = F.col("id"), F.repeat(F.lit("\n"), (1 + F.col("id") % 3).cast("int"))
    kinds = [
        F.concat(F.lit("natural_image"), gap, F.lit("正文"), k), F.concat(F.lit("![photo](imgs/"), k, F.lit(".png)")), F.concat(F.lit("話！"), gap, F.lit("就在這時刻他說他要講幾句")),
        F.concat(F.lit("Figure 1. is kept "), k), F.lit(CAPTION),
    ]
    text = F.element_at(F.array(*kinds), (k % 5 + 1).cast("int"))
    return spark.range(500).select("id", noise.clean_captions(text).alias("text"))


OPF = '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
CONTAINER = '<container><rootfiles><rootfile full-path="E/content.opf"/></rootfiles></container>'


def toc_repairs(spark, sf_dir) -> DataFrame:
    """The members of 120 books after their tables of contents are repaired: targets after their marker, before none, and without fragment."""
    k = F.col("book")
    page = lambda *x: F.concat(F.lit("<html><body>"), *x, F.lit("</body></html>"))
    a = page(
        F.lit('<h1 id="t1">第一章 甲</h1><p>'), k, F.lit("</p>"), F.when(k % 2 == 0, "<h2>第二章</h2>").otherwise('<h2 id="m">第二章</h2>'), F.lit('<p id="t2">乙</p>'),
        F.when(k % 3 == 0, '<p id="t3-chapter">x</p>').otherwise(""), F.lit('<h3 id="t3">丙</h3>'),
    )
    b = page(F.lit("<h2>第四章</h2><p>丁"), k, F.lit('</p><p id="p">戊</p>'))
    links = [("第一章 甲", "a.xhtml#t1"), ("第二章 乙", "a.xhtml#t2"), ("第三章 丙", "a.xhtml#t3"), ("第四章 丁", "b.xhtml"), ("第二編 戊", "b.xhtml#p")]
    nav = page(F.lit("".join(f'<a href="{h}">{t}</a>' for t, h in links)))
    members = [("META-INF/container.xml", F.lit(CONTAINER)), ("E/content.opf", F.lit(OPF)), ("E/a.xhtml", a), ("E/b.xhtml", b), ("E/nav.xhtml", nav)]
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(p).alias("path"), F.lit(8).alias("compress_type"), x.cast("binary").alias("payload"), F.lit(True).alias("crc_ok")) for o, (p, x) in enumerate(members)])
    entries = spark.range(120).select(F.col("id").cast("string").alias("book")).select("book", F.inline(rows))
    done = repair.repair_toc(entries).filter(F.col("path").isin("E/a.xhtml", "E/b.xhtml", "E/nav.xhtml"))
    return done.select("book", "path", T.utf8(F.col("payload")).alias("text"))


FIXTURES = {
    f.__name__: f
    for f in (repaired_order, noise_tables, chinese_numerals, cjk_repeats, page_start_alignment, diff_patch, kth_occurrence_link, visual_fallbacks, toc_repairs, caption_cleanup)
}
