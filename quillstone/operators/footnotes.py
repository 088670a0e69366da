"""Footnotes of pages: extraction from layout blocks, numbering, links with inline markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import no_space
from quillstone.operators.noise import clean_ocr_noise

#: Labels of note blocks, the marker at a note's start and the inline marker.
LABELS = ("footnote", "vision_footnote")
MARKER = "(?s)^\\s*(?:\\$\\s*\\^\\{)?([0-9]{1,3})(?![0-9])(?:\\}\\s*\\$)?\\s*(.*)$"
INLINE = "\\$\\s*\\^\\{?([0-9]{1,3})\\}?\\s*\\$"


def page_footnotes(pages: DataFrame, keep: list[str], blocks_col: str, text_col: str) -> DataFrame:
    """(keep…, note_no, note) of labelled blocks (block_label, block_content) whose cleaned text isn't in the page already."""
    page = no_space(F.col(text_col))
    notes = F.filter(
        F.transform(F.filter(F.col(blocks_col), lambda b: b.block_label.isin(*LABELS)), lambda b: clean_ocr_noise(b.block_content)),
        lambda n: (n != "") & ~page.contains(no_space(n)),
    )
    return pages.select(*keep, F.posexplode(notes).alias("note_no", "note"))


def note_number(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, MARKER, 1), F.lit(""))


def note_body(note: Column) -> Column:
    return F.when(note_number(note).isNull(), F.trim(note)).otherwise(F.trim(F.regexp_extract(note, MARKER, 2)))


def is_caption(note: Column) -> Column:
    """Prose that is no note: opens with a year, credits a picture, or is long without a digit."""
    t = F.trim(note)
    return t.rlike("^[0-9]{4}年") | (t.contains("（") & t.contains("提供）")) | ((F.length(t) >= 40) & ~t.rlike("[0-9]"))


def inline_markers(pages: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(keep…, marker_no, number, occurrence) of inline markers; ``occurrence`` counts equal numbers of a page from 1."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(INLINE), F.lit(1))).alias("marker_no", "number"))
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keep, "number").orderBy("marker_no")))


def number_notes(notes: DataFrame, markers: DataFrame, keep: list[str]) -> DataFrame:
    """Notes with ``number`` and ``occurrence``: unnumbered ones that are no captions take, in order, the inline numbers without a note."""
    t = notes.withColumn("number", note_number(F.col("note")))
    explicit = t.filter("number IS NOT NULL").groupBy(*keep, "number").agg(F.count("*").alias("_own"))
    free = markers.join(explicit, [*keep, "number"], "left").filter(F.col("occurrence") > F.coalesce("_own", F.lit(0)))
    page = Window.partitionBy(*keep)
    free = free.select(*keep, F.col("number").alias("_free"), F.row_number().over(page.orderBy("marker_no")).alias("_k"))
    wants = F.col("number").isNull() & ~is_caption(F.col("note"))
    t = t.withColumn("_k", F.when(wants, F.sum(wants.cast("int")).over(page.orderBy("note_no").rowsBetween(Window.unboundedPreceding, 0))))
    t = t.join(free, [*keep, "_k"], "left").withColumn("number", F.coalesce("number", "_free")).drop("_free", "_k")
    same = Window.partitionBy(*keep, "number").orderBy("note_no")
    return t.withColumn("occurrence", F.when(F.col("number").isNotNull(), F.row_number().over(same)))


def link_notes(notes: DataFrame, markers: DataFrame, keep: list[str]) -> DataFrame:
    """Markers with the note they link to: the k-th marker of a number and the k-th note of it; ``note_no`` is null for extras."""
    n = notes.filter("number IS NOT NULL").select(*keep, "number", "occurrence", "note_no", "note")
    return markers.join(n, [*keep, "number", "occurrence"], "left")


def anchor(prefix: str, page: Column, number: Column, occurrence: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-p"), page.cast("string"), F.lit("-"), number, F.when(occurrence > 1, F.concat(F.lit("-"), occurrence.cast("string"))).otherwise(F.lit("")))


def notes_html(notes: DataFrame, keep: list[str], page_col: str) -> DataFrame:
    """(keep…, html): one section a page, notes in order, each with its anchor and a link back."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    note_id, ref_id = (anchor(p, F.col(page_col), F.col("number"), F.col("occurrence")) for p in ("fn", "fnref"))
    body = esc(note_body(F.col("note")))
    numbered = F.concat(F.lit('<p id="'), note_id, F.lit('"><a href="#'), ref_id, F.lit('">'), F.col("number"), F.lit("</a> "), body, F.lit("</p>"))
    rows = notes.withColumn("_p", F.when(F.col("number").isNull(), F.concat(F.lit("<p>"), body, F.lit("</p>"))).otherwise(numbered))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_no", "_p"))), lambda x: x["_p"]), "")
    return rows.groupBy(*keep).agg(F.concat(F.lit('<section class="footnotes">'), joined, F.lit("</section>")).alias("html"))
