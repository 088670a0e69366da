"""Tables of contents of packaged books: numbered targets, heading previews, reading segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import NUMERALS
from quillstone.functions.unions import union

#: A numbered marker with its kind, and the variant forms that are folded.
MARKER = f"^(第[{NUMERALS}〇兩]+([章節编編篇卷部]))"
BOUNDARY = f"^第[{NUMERALS}〇兩]+[編章]($|[^\\p{{L}}\\p{{N}}_])"
BACK = 8


def marker(label: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(label), MARKER, 1), F.lit(""))


def kind(label: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(label), MARKER, 2), F.lit(""))


def fold_marker(text: Column) -> Column:
    return F.translate(F.trim(text), "编", "編")


def fold_heading(text: Column) -> Column:
    """Letters, digits and CJK only, variants folded."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "编强", "編強"), "[^0-9A-Za-z\\u3400-\\u9FFF]+", "")


def numbered_targets(links: DataFrame, elements: DataFrame, spine: DataFrame) -> DataFrame:
    """(book, link_no, path, elem_no, score): the best element for each numbered link.

    ``links`` has (book, link_no, label, preferred), ``elements`` as ``sources.epub.text_elements``, ``spine`` (book, path, spine_no).  Candidates begin with
    the link's marker; 2 for the preferred member, 2 for a heading, 2 for exactly the marker, 6 when the rest of the label stands in
    the element and the two after it.  Equal scores go by preferred member, spine, then order.
    """
    w = Window.partitionBy("book", "path").orderBy("elem_no")
    e = elements.withColumn("_context", fold_heading(F.concat("text", F.coalesce(F.lead("text", 1).over(w), F.lit("")), F.coalesce(F.lead("text", 2).over(w), F.lit("")))))
    e = e.withColumn("_marker", fold_marker(marker(F.col("text")))).filter(F.col("_marker").isNotNull())
    t = links.withColumn("_marker", fold_marker(marker(F.col("label")))).filter(F.col("_marker").isNotNull())
    t = t.withColumn("_hint", fold_heading(F.regexp_replace("label", MARKER, "")))
    found = t.join(e, ["book", "_marker"]).join(spine.select("book", "path", "spine_no"), ["book", "path"], "left")
    here = F.coalesce(F.col("path") == F.col("preferred"), F.lit(False))
    score = (
        F.when(here, 2).otherwise(0) + F.when(F.col("tag").rlike("^h[1-6]$"), 2).otherwise(0) + F.when(F.trim("text") == marker(F.col("label")), 2).otherwise(0)
        + F.when((F.col("_hint") != "") & F.col("_context").contains(F.col("_hint")), 6).otherwise(0)
    )
    order = Window.partitionBy("book", "link_no").orderBy(score.desc(), here.desc(), F.col("spine_no").asc_nulls_last(), "path", "elem_no")
    return found.withColumn("score", score).withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("book", "link_no", "path", "elem_no", "id", "name", "score")


def retarget(links: DataFrame, elements: DataFrame) -> DataFrame:
    """(book, link_no, action, elem_no, fragment): what to do with links that have a fragment.

    ``keep`` when the target begins with the link's marker; ``look_back`` to the nearest of the eight elements before it that is the marker;
    else ``insert`` a marker before it for chapters and parts; ``missing`` when no element has the fragment.
    """
    w = Window.partitionBy("book", "path").orderBy("elem_no")
    back = elements.withColumn("_back", F.collect_list(F.struct("elem_no", fold_marker(F.col("text")).alias("text"), F.coalesce("id", "name").alias("id"))).over(w.rowsBetween(-BACK, -1)))
    own = F.array(F.coalesce("id", F.lit("")), F.coalesce("name", F.lit("")))
    t = links.alias("l").join(
        back.withColumn("_own", own).alias("e"), (F.col("l.book") == F.col("e.book")) & (F.col("l.path") == F.col("e.path")) & F.array_contains(F.col("e._own"), F.col("l.fragment")), "left"
    )
    first = Window.partitionBy("l.book", "l.link_no").orderBy("e.elem_no")
    t = t.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    m = fold_marker(marker(F.col("l.label")))
    hit = F.try_element_at(F.filter("_back", lambda x: x.text == m), F.lit(-1))
    starts = F.coalesce(fold_marker(F.col("e.text")).startswith(m), F.lit(False))
    action = F.when(F.col("e.elem_no").isNull(), "missing").when(starts, "keep").when(hit.isNotNull(), "look_back").otherwise("insert")
    return t.select(
        F.col("l.book").alias("book"), F.col("l.link_no").alias("link_no"), action.alias("action"),
        F.when(action == "look_back", hit.elem_no).otherwise(F.col("e.elem_no")).alias("elem_no"),
        F.when(action == "look_back", hit.id).when(action == "insert", F.concat(F.col("l.fragment"), F.when(kind(F.col("l.label")) == "章", "-chapter").otherwise("-part"))).otherwise(F.col("l.fragment")).alias("fragment"),
    )


def trailing_previews(elements: DataFrame, spine: DataFrame, most: int = 8) -> DataFrame:
    """(book, path, first_elem): where the last elements of a document repeat the next document's heading.

    The longest tail of up to ``most`` elements that stands, folded, in the first eight elements of the next spine document goes.
    """
    w = Window.partitionBy("book", "path")
    e = elements.withColumn("_fold", fold_heading(F.col("text"))).withColumn("_from_end", F.row_number().over(w.orderBy(F.col("elem_no").desc())))
    tails = e.filter(F.col("_from_end") <= most)
    up = w.orderBy("elem_no").rowsBetween(0, Window.unboundedFollowing)
    tails = tails.withColumn("_tail", F.array_join(F.collect_list("_fold").over(up), "")).filter("_tail <> ''")
    heads = e.filter(F.col("elem_no") < 8).groupBy("book", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("elem_no", "_fold"))), lambda x: x["_fold"]), "").alias("_head"))
    nxt = spine.withColumn("_next", F.lead("path").over(Window.partitionBy("book").orderBy("spine_no")))
    both = tails.join(nxt.select("book", "path", "_next"), ["book", "path"]).join(heads.withColumnRenamed("path", "_next"), ["book", "_next"])
    return both.filter(F.col("_head").contains(F.col("_tail"))).groupBy("book", "path").agg(F.min("elem_no").alias("first_elem"))


def is_boundary(title: Column, front_matter: tuple[str, ...] = ()) -> Column:
    return F.col("label").isin(*front_matter) | title.rlike(BOUNDARY) if front_matter else title.rlike(BOUNDARY)


def reading_boundaries(nav: DataFrame, front_matter: tuple[str, ...] = ()) -> DataFrame:
    """(book, boundary_no, title, path, fragment) of nav rows that begin a reading unit, the first of each target."""
    rows = nav.filter(is_boundary(F.col("label"), front_matter) & F.col("fragment").isNotNull())
    w = Window.partitionBy("book", "member", "fragment").orderBy("ord")
    first = rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return first.select("book", F.row_number().over(Window.partitionBy("book").orderBy("ord")).alias("boundary_no"), F.col("label").alias("title"), F.col("member").alias("path"), "fragment")


def reading_segments(children: DataFrame, boundaries: DataFrame, spine: DataFrame) -> DataFrame:
    """Body children with ``boundary_no``, the last boundary at or before them in spine order; leading ones go to the first.

    ``starts`` marks a boundary's own child and ``repeats`` up to four children right after it whose short text stands in the title.
    """
    at = boundaries.alias("b").join(children.alias("c"), (F.col("b.book") == F.col("c.book")) & (F.col("b.path") == F.col("c.path")) & F.array_contains(F.col("c.ids"), F.col("b.fragment")))
    at = at.groupBy(F.col("b.book").alias("book"), F.col("b.path").alias("path"), F.col("b.boundary_no").alias("_b"), F.col("b.title").alias("_title")).agg(F.min("c.child_no").alias("child_no"))
    t = children.join(spine.select("book", "path", "spine_no"), ["book", "path"]).join(at, ["book", "path", "child_no"], "left")
    order = Window.partitionBy("book").orderBy("spine_no", "child_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("boundary_no", F.coalesce(F.last("_b", ignorenulls=True).over(upto), F.lit(1))).withColumn("_t", F.last("_title", ignorenulls=True).over(upto))
    t = t.withColumn("starts", F.col("_b").isNotNull())
    own = Window.partitionBy("book", "boundary_no").orderBy("spine_no", "child_no")
    short = ~F.col("starts") & (F.length("text") <= 48) & (fold_heading(F.col("text")) != "") & fold_heading(F.col("_t")).contains(fold_heading(F.col("text")))
    after = F.row_number().over(own) - 1
    t = t.withColumn("_short", short).withColumn("_after", after)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("repeats", F.col("_short") & (F.col("_after").between(1, 4)) & (F.sum(F.col("_short").cast("int")).over(so_far) == F.col("_after")))
    return t.select("book", "boundary_no", "spine_no", "path", "child_no", "text", "xml", "starts", "repeats")


def boundary_errors(children: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(book, issue, detail): boundaries without an element, and elements with two boundaries."""
    hit = boundaries.alias("b").join(children.alias("c"), (F.col("b.book") == F.col("c.book")) & (F.col("b.path") == F.col("c.path")) & F.array_contains(F.col("c.ids"), F.col("b.fragment")), "left")
    per = hit.groupBy(F.col("b.book").alias("book"), F.col("b.path").alias("path"), F.col("b.fragment").alias("fragment")).agg(F.min("c.child_no").alias("child_no"))
    missing = per.filter("child_no IS NULL").select("book", F.lit("boundary id not found").alias("issue"), F.concat_ws("#", "path", "fragment").alias("detail"))
    twice = per.filter("child_no IS NOT NULL").groupBy("book", "path", "child_no").count().filter("count > 1")
    return union(missing, twice.select("book", F.lit("several boundaries in one element").alias("issue"), F.concat_ws("#", "path", F.col("child_no").cast("string")).alias("detail")))


def is_chapter_number(text: Column) -> Column:
    """Exactly 第X章."""
    return F.coalesce((kind(text) == "章") & (F.trim(text) == marker(text)), F.lit(False))


def known_headings(elements: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(book, path, elem_no, label): first elements that are one of the ``known`` corrupted headings, and the chapter label that takes their place.

    The label is the marker of the next element and the text of the one after it, unless that begins with a marker too.
    Labels of a table of contents that are among the known ones are replaced by their member's.
    """
    w = Window.partitionBy("book", "path").orderBy("elem_no")
    nxt, after = F.lead("text", 1).over(w), F.lead("text", 2).over(w)
    rest = F.when((F.trim("_after") != "") & marker(F.col("_after")).isNull(), F.trim("_after"))
    t = elements.withColumn("_next", nxt).withColumn("_after", after).filter((F.col("elem_no") == 0) & F.trim("text").isin(*known))
    return t.filter(kind(F.col("_next")) == "章").select("book", "path", "elem_no", F.concat_ws(" ", marker(F.col("_next")), rest).alias("label"))


def stale_bibliography_titles(elements: DataFrame, note_class: str = "footnote") -> DataFrame:
    """(book, path, elem_no): chapter headings left over from the chapter before: they follow notes, and a bare 第X章 comes within seven elements.

    A note is recognised by its id or name among the eight elements before.
    """
    w = Window.partitionBy("book", "path").orderBy("elem_no")
    bare = F.max(is_chapter_number(F.col("text")).cast("int")).over(w.rowsBetween(1, 7))
    noted = F.coalesce("id", F.lit("")).contains(note_class) | F.coalesce("name", F.lit("")).contains(note_class) | F.coalesce("id", F.lit("")).startswith("fn-")
    before = F.max(noted.cast("int")).over(w.rowsBetween(-BACK, -1))
    t = elements.withColumn("_bare", bare).withColumn("_noted", before)
    heading = F.col("tag").rlike("^h[1-6]$") & (kind(F.col("text")) == "章") & (F.trim("text") != marker(F.col("text")))
    return t.filter(heading & (F.col("_bare") == 1) & (F.col("_noted") == 1)).select("book", "path", "elem_no")


def part_moves(elements: DataFrame, targets: DataFrame) -> DataFrame:
    """(book, path, elem_no, last_elem): part blocks that stand after the bare marker of their first chapter and are to go before it.

    ``targets`` has (book, path, elem_no) of parts.  The block takes along up to three plain paragraphs without id or marker.
    """
    w = Window.partitionBy("book", "path").orderBy("elem_no")
    plain = (F.col("tag") == "p") & F.col("id").isNull() & F.col("name").isNull() & marker(F.col("text")).isNull()
    t = elements.withColumn("_plain", plain.cast("int")).withColumn("_prev", F.lag("text").over(w))
    along = [F.coalesce(F.lead("_plain", k).over(w), F.lit(0)) for k in (1, 2, 3)]
    t = t.withColumn("_n", along[0] + along[0] * along[1] + along[0] * along[1] * along[2])
    return t.join(targets.select("book", "path", "elem_no"), ["book", "path", "elem_no"]).filter(is_chapter_number(F.col("_prev"))).select(
        "book", "path", "elem_no", (F.col("elem_no") + F.col("_n")).alias("last_elem")
    )
