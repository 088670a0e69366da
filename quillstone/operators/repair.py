"""Repairs of packaged books, as edits of their members.

An edit (book, path, start, stop, text) puts ``text`` in place of the characters from ``start`` to ``stop`` of a member.  Rules give
edits as tables; ``apply_edits`` makes the new entries in one pass, so that rules can be joined before anything is written.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions.html import relative_href, resolve_member
from quillstone.functions.text import utf8
from quillstone.functions.unions import union
from quillstone.operators import toc
from quillstone.sources import epub

#: Kinds of division above chapters.
PARTS = ("編", "编", "篇", "部", "卷")
NAV_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*([\"'])(?P<href>.*?)\1[^>]*>(?P<label>.*?)</a>", re.I | re.S)
NCX_LINK = re.compile(r"<text\b[^>]*>(?P<label>.*?)</text>\s*</navLabel>\s*<content\b[^>]*?\bsrc\s*=\s*([\"'])(?P<href>.*?)\2", re.I | re.S)
LINKS = "book string, source string, k int, label string, href string, start int, stop int, member string, fragment string"


def toc_links(entries: DataFrame) -> DataFrame:
    """Links of the tables of contents as LINKS; ``start`` and ``stop`` are where the href stands in its member."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, path, data in zip(batch["book"], batch["path"], batch["payload"], strict=True):
                pattern = NCX_LINK if path.lower().endswith(".ncx") else NAV_LINK
                for k, m in enumerate(pattern.finditer((data or b"").decode("utf-8", "ignore"))):
                    label = " ".join(html.unescape(re.sub(r"<[^>]+>", "", m["label"])).split())
                    href = html.unescape(m["href"])
                    rows.append((book, path, k, label, href, m.start("href"), m.end("href"), *resolve_member(path, href)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LINKS.split(", ")])

    base = F.lower(F.substring_index("path", "/", -1))
    return entries.filter(base.isin("nav.xhtml", "nav.html", "toc.ncx")).select("book", "path", "payload").mapInPandas(find, LINKS)


def apply_edits(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """``entries`` with the edits made; of edits that overlap the first counts, and repeated ones count once."""
    one = F.struct("start", "stop", "text")
    per_member = edits.groupBy("book", "path").agg(F.sort_array(F.collect_set(one)).alias("_edits"))
    columns = ["book", "ord", "path", "compress_type", "payload", "crc_ok"]

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = []
            for data, own in zip(batch["payload"], batch["_edits"], strict=True):
                if own is not None and data is not None:
                    text, at, parts = data.decode("utf-8", "ignore"), 0, []
                    for e in own:
                        if e["start"] >= at:
                            parts += [text[at : e["start"]], e["text"]]
                            at = e["stop"]
                    data = "".join([*parts, text[at:]]).encode()
                new.append(data)
            yield batch.assign(payload=new)[columns]

    return entries.join(per_member, ["book", "path"], "left").select(*columns, "_edits").mapInPandas(rewrite, epub.ENTRY)


def free_ids(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """``wanted`` (book, path, elem_no, name) with ``new_id``: the name, or the first of name-2, name-3, … that its member lacks; no two alike."""
    text = utf8(F.col("payload"))
    taken = entries.select("book", "path", F.regexp_extract_all(text, F.lit("\\b(?:id|name)\\s*=\\s*[\"']([^\"']+)"), F.lit(1)).alias("_taken"))
    turn = F.row_number().over(Window.partitionBy("book", "path", "name").orderBy("elem_no"))
    rows = wanted.withColumn("_turn", turn).join(taken, ["book", "path"])
    names = F.transform(F.sequence(F.lit(1), F.size("_taken") + F.col("_turn")), lambda k: F.when(k == 1, F.col("name")).otherwise(F.concat_ws("-", "name", k.cast("string"))))
    free = F.filter(names, lambda x: ~F.array_contains("_taken", x))
    return rows.withColumn("new_id", F.element_at(free, F.col("_turn"))).drop("_turn", "_taken")


@F.pandas_udf(StringType())
def with_fragment(href: pd.Series, fragment: pd.Series) -> pd.Series:
    return pd.Series([f"{h.partition('#')[0]}#{quote(f, safe=':')}" for h, f in zip(href, fragment, strict=True)])


def _escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def retarget_edits(entries: DataFrame) -> DataFrame:
    """Edits after which every numbered link of the tables of contents points to its own marker.

    A link with a fragment whose element begins with the link's marker stays; a part's block after the bare marker of its first chapter moves
    before that.  Otherwise the nearest of the eight elements before that is the marker takes the link, with a new id if it
    has none; else a marker is put before the element, for chapters and parts.  A link without a fragment goes to the best element of the book.
    """
    elements = epub.text_elements(entries)
    found = epub.structure(entries).filter("kind = 'spine' AND member IS NOT NULL")
    spine = found.groupBy("book", F.col("member").alias("path")).agg(F.min("ord").alias("spine_no"))
    links = toc_links(entries).filter(toc.marker(F.col("label")).isNotNull()).withColumn("link_no", F.struct("source", "k"))
    there = entries.select("book", F.col("path").alias("member")).distinct()
    pointed = links.filter("fragment IS NOT NULL").join(there, ["book", "member"], "left_semi")
    place = ["book", "path", "elem_no"]
    where = elements.select(*place, "start", "stop", "tag", F.coalesce("id", "name").alias("own_id"))
    own = links.select("book", "link_no", "label", "href", "source", F.col("start").alias("href_start"), F.col("stop").alias("href_stop"), F.col("fragment").alias("old"), F.col("member").alias("old_member"))

    ruled = toc.retarget(pointed.select("book", "link_no", "label", F.col("member").alias("path"), "fragment"), elements).select("book", "link_no", "action", "elem_no")
    ruled = ruled.join(own, ["book", "link_no"]).withColumn("path", F.col("old_member")).join(where, place)
    kind = toc.kind(F.col("label"))
    ruled = ruled.filter(~((F.col("action") == "insert") & (kind != "章") & ~kind.isin(*PARTS)))
    loose = toc.numbered_targets(links.filter("fragment IS NULL").select("book", "link_no", "label", F.col("member").alias("preferred")), elements, spine)
    loose = loose.select(*place, "link_no", F.lit("find").alias("action")).join(own, ["book", "link_no"]).join(where, place)
    columns = ["book", "link_no", "path", "elem_no", "action", "label", "href", "source", "href_start", "href_stop", "old", "start", "stop", "tag", "own_id"]
    todo = union(ruled.select(columns), loose.select(columns))

    # New ids: one for each element that needs one, whichever links ask for it.
    suffix = F.when(F.col("action") != "insert", "start").when(kind == "章", "chapter").otherwise("part")
    name = F.concat_ws("-", F.when(F.col("action") == "find", "toc-auto").otherwise(F.col("old")), suffix)
    fresh = todo.filter((F.col("action") == "insert") | F.col("action").isin("look_back", "find") & F.col("own_id").isNull()).withColumn("name", name)
    asked = fresh.groupBy(*place, "action", "name").agg(F.min_by("label", "link_no").alias("label"), F.first("start").alias("start"), F.first("tag").alias("tag"))
    ids = free_ids(asked, entries)
    marker = toc.marker(F.col("label"))
    rest = F.regexp_replace(F.substring(F.col("label"), F.length(marker) + 1, F.length("label")), "^[\\s:：,，、]+", "")
    tag = F.when(kind != "章", "p").when(F.col("tag").rlike("^h[1-6]$"), F.col("tag")).otherwise("h2")
    more = F.when((kind != "章") & (rest != ""), F.concat(F.lit("<p>"), _escaped(rest), F.lit("</p>"))).otherwise("")
    put = F.concat(F.lit("<"), tag, F.lit(' id="'), _escaped(F.col("new_id")), F.lit('">'), _escaped(marker), F.lit("</"), tag, F.lit(">"), more)
    inserted = ids.filter("action = 'insert'").select("book", "path", "start", F.col("start").alias("stop"), put.alias("text"))
    inside = F.col("start") + 1 + F.length("tag")
    named = ids.filter("action <> 'insert'").select("book", "path", inside.alias("start"), inside.alias("stop"), F.concat(F.lit(' id="'), _escaped(F.col("new_id")), F.lit('"')).alias("text"))

    # Hrefs: the new fragment, in another member perhaps.
    aimed = todo.join(ids.select(*place, "action", "name", "new_id"), [*place, "action"], "left").filter(F.col("name").isNull() | (F.col("name") == name))
    fragment = F.when(F.col("action") == "insert", F.col("new_id")).otherwise(F.coalesce("own_id", "new_id"))
    aimed = aimed.filter("action <> 'keep'").withColumn("fragment", fragment)
    href = F.when(F.col("action") == "find", relative_href("source", "path", "fragment")).otherwise(with_fragment("href", "fragment"))
    hrefs = aimed.select("book", F.col("source").alias("path"), F.col("href_start").alias("start"), F.col("href_stop").alias("stop"), _escaped(href).alias("text"))

    # Parts that come after the bare marker of their first chapter: the block goes before the marker.
    parts = todo.filter((F.col("action") == "keep") & kind.isin(*PARTS)).select(*place).distinct()
    moves = toc.part_moves(elements, parts)
    block = moves.join(where.select(*place, F.col("start").alias("a")), place).join(
        where.select("book", "path", F.col("elem_no").alias("last_elem"), F.col("stop").alias("b")), ["book", "path", "last_elem"]
    ).join(where.select("book", "path", (F.col("elem_no") + 1).alias("elem_no"), F.col("start").alias("to")), place)
    block = block.join(entries.select("book", "path", utf8(F.col("payload")).alias("_text")), ["book", "path"])
    moved = F.substring(F.col("_text"), F.col("a") + 1, F.col("b") - F.col("a"))
    gone = block.select("book", "path", F.col("a").alias("start"), F.col("b").alias("stop"), F.lit("").alias("text"))
    come = block.select("book", "path", F.col("to").alias("start"), F.col("to").alias("stop"), moved.alias("text"))
    return union(inserted, named, hrefs, gone, come)


def preview_edits(entries: DataFrame) -> DataFrame:
    """Edits that delete previews of the next document's numbered heading from the end of a document, where only closing tags follow."""
    elements = epub.text_elements(entries)
    found = epub.structure(entries).filter("kind = 'spine' AND member IS NOT NULL")
    spine = found.groupBy("book", F.col("member").alias("path")).agg(F.min("ord").alias("spine_no"))
    tails = toc.trailing_previews(elements, spine)
    own = elements.join(tails, ["book", "path"]).filter(F.col("elem_no") >= F.col("first_elem"))
    spans = own.groupBy("book", "path").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(toc.marker(F.col("text")).isNotNull()).alias("numbered")).filter("numbered")
    texts = entries.select("book", "path", utf8(F.col("payload")).alias("_text"))
    after = F.substring(F.col("_text"), F.col("stop") + 1, F.length("_text"))
    return spans.join(texts, ["book", "path"]).filter(after.rlike("(?s)^(\\s|</[^>]*>)*$")).select("book", "path", "start", "stop", F.lit("").alias("text"))


def heading_edits(entries: DataFrame, known: tuple[str, ...] = (), note_class: str = "footnote") -> DataFrame:
    """Edits that put a chapter's label in place of a ``known`` corrupted heading and delete chapter headings left over from the chapter before."""
    elements = epub.text_elements(entries)
    where = elements.select("book", "path", "elem_no", "start", "stop")
    texts = entries.select("book", "path", utf8(F.col("payload")).alias("_text"))
    stale = toc.stale_bibliography_titles(elements, note_class).join(where, ["book", "path", "elem_no"]).select("book", "path", "start", "stop", F.lit("").alias("text"))
    if not known:
        return stale
    named = toc.known_headings(elements, known).join(where, ["book", "path", "elem_no"]).join(texts, ["book", "path"])
    old = F.substring(F.col("_text"), F.col("start") + 1, F.col("stop") - F.col("start"))
    new = F.concat(F.regexp_extract(old, "^(<[^>]*>)", 1), _escaped(F.col("label")), F.regexp_extract(old, "(</[^>]*>)$", 1))
    return union(stale, named.select("book", "path", "start", "stop", new.alias("text")))


def repair_toc(entries: DataFrame) -> DataFrame:
    """Entries whose tables of contents point to their markers and whose documents don't end in the next one's heading."""
    return apply_edits(entries, union(retarget_edits(entries), preview_edits(entries)))
