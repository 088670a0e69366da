"""Rewriting members of packaged books: anchors, page-start classes, books made of reading segments."""

from __future__ import annotations

import html
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.html import resolve_member
from quillstone.functions.unions import union
from quillstone.sources import epub

#: The class of elements that begin a page, and its style rules.
PAGE_START = "toc-page-start"
PAGE_START_CSS = f"""
.{PAGE_START} {{
    break-before: page;
    page-break-before: always;
    margin-top: 0 !important;
    padding-top: 0 !important;
}}
body > .{PAGE_START}:first-child {{
    break-before: auto;
    page-break-before: auto;
}}
p.{PAGE_START} + p + h1.{PAGE_START},
p.{PAGE_START} + p + h2.{PAGE_START} {{
    break-before: auto;
    page-break-before: auto;
}}
"""
TAG = re.compile(r"<[A-Za-z][^<>]*>")
ATTRIBUTE = re.compile(r"\s+(?P<name>[\w:.-]+)\s*=\s*(?P<quote>[\"'])(?P<value>.*?)(?P=quote)", re.S)


def unique_id(text: str, base: str, suffix: str) -> str:
    """``base-suffix``, with a number when the text has that id or name already."""
    taken = set(re.findall(r"\b(?:id|name)\s*=\s*[\"']([^\"']+)", text))
    name, k = f"{base}-{suffix}", 2
    while name in taken:
        name, k = f"{base}-{suffix}-{k}", k + 1
    return name


def add_id(text: str, start: int, name: str) -> str:
    """The element whose start tag begins at ``start`` with an id."""
    m = re.compile(r"<[\w:.-]+").match(text, start)
    return text if not m else f'{text[: m.end()]} id="{html.escape(name)}"{text[m.end() :]}'


def insert_marker(text: str, start: int, tag: str, name: str, marker: str, rest: str = "") -> str:
    """A marker element, and a paragraph for the rest of a part's title, before the element at ``start``."""
    more = f"<p>{html.escape(rest)}</p>" if rest else ""
    return f'{text[:start]}<{tag} id="{html.escape(name)}">{html.escape(marker)}</{tag}>{more}{text[start:]}'


def replace_fragment(href: str, fragment: str) -> str:
    return f"{href.partition('#')[0]}#{fragment}"


def page_starts(text: str, ids: list[str]) -> str:
    """The page-start class on the first element with each id or name and on no other; all else stays, other classes included."""
    left = set(ids)

    def settle(m: re.Match) -> str:
        tag = m[0]
        fields = {a["name"].lower(): a for a in ATTRIBUTE.finditer(tag)}
        mine = {html.unescape(fields[n]["value"]) for n in ("id", "name") if n in fields} & left
        left.difference_update(mine)
        classes = fields["class"]["value"].split() if "class" in fields else []
        if (PAGE_START in classes) == bool(mine):
            return tag
        now = [c for c in classes if c != PAGE_START] + [PAGE_START] * bool(mine)
        written = f' class="{" ".join(now)}"' if now else ""
        first, last = fields["class"].span() if "class" in fields else [len(tag) - len(re.search(r"\s*/?>$", tag)[0])] * 2
        return tag[:first] + written + tag[last:]

    return TAG.sub(settle, text)


def styled(css: str) -> str:
    """A style sheet with the rules of page starts, once."""
    return css if PAGE_START in css else "\n".join([css.rstrip(), PAGE_START_CSS])


def start_pages(entries: DataFrame, structure: DataFrame) -> DataFrame:
    """Entries in which every target of the table of contents starts a page: classes in members, the rule in style sheets."""
    targets = structure.filter("kind IN ('nav', 'ncx') AND fragment IS NOT NULL").groupBy("book", F.col("member").alias("path")).agg(F.collect_set("fragment").alias("ids"))
    rows = entries.join(targets, ["book", "path"], "left")

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = []
            for path, data, ids in zip(batch["path"], batch["payload"], batch["ids"], strict=True):
                if isinstance(path, str) and path.endswith((".xhtml", ".html")) and data is not None:
                    data = page_starts(data.decode("utf-8", "ignore"), list(ids) if ids is not None else []).encode()
                elif isinstance(path, str) and path.endswith(".css") and data is not None:
                    data = styled(data.decode("utf-8", "ignore")).encode()
                new.append(data)
            yield batch.assign(payload=new)[["book", "ord", "path", "compress_type", "payload", "crc_ok"]]

    return rows.select("book", "ord", "path", "compress_type", "payload", "crc_ok", "ids").mapInPandas(rewrite, epub.ENTRY)


def _content(path) -> Column:
    """Members that hold the text of a book; a cover page doesn't."""
    base = F.lower(F.substring_index(path, "/", -1))
    return F.lower(path).rlike("\\.x?html?$") & ~base.isin(*epub.STRUCTURAL, "cover.xhtml")


def relocate(xml: str, source: str, folder: str) -> str:
    """Markup of member ``source`` for a member in ``folder``: relative links lead to the same files."""

    def move(m: re.Match) -> str:
        member, fragment = resolve_member(source, html.unescape(m["value"]))
        if member is None or m["value"].startswith("#"):
            return m[0]
        target = posixpath.relpath(member, folder or ".") + (f"#{quote(fragment)}" if fragment else "")
        return f"{m['name']}{html.escape(target)}{m['quote']}"

    return re.sub(r"(?P<name>\b(?:src|href)\s*=\s*(?P<quote>[\"']))(?P<value>.*?)(?P=quote)", move, xml)


def chapterize(segments: DataFrame, boundaries: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of the books with one member a reading segment, from ``toc.reading_segments`` and ``reading_boundaries``.

    A member begins with its title as the only first-level heading; the boundary's own element and repeated titles are left out.  The
    package keeps its metadata, pictures, style sheets and cover; manifest, spine, nav and ncx are those of the new members.
    A task holds one book's text.
    """
    keep = segments.filter(~F.col("starts") & ~F.col("repeats"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("spine_no", "child_no", "path", "xml"))), lambda x: F.struct(x["path"].alias("path"), x["xml"].alias("xml")))
    body = keep.groupBy("book", "boundary_no").agg(pieces.alias("pieces"))
    rows = boundaries.join(body, ["book", "boundary_no"], "left").select("book", "boundary_no", "title", "pieces")
    base = F.lower(F.substring_index("path", "/", -1))
    package = base.endswith(".opf") | (base == "container.xml")
    contents = base.isin(*epub.STRUCTURAL) & ~package
    untouched = entries.filter(~_content(F.col("path")) & ~base.endswith(".opf") & ~contents)
    plain = lambda x: re.sub(r"<(/?)(?:\w+:)?h1\b", r"<\1h2", re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", re.sub(r"(</?)\w+:", r"\1", x or "")))

    def build(own: pd.DataFrame, chapters: pd.DataFrame) -> pd.DataFrame:
        files = {p: d for p, d in zip(own["path"], own["payload"], strict=True) if isinstance(p, str)}
        if not len(chapters) or not files:
            return pd.DataFrame([], columns=[x.split()[0] for x in epub.ENTRY.split(", ")])
        opf = epub.package_file(files)
        folder = posixpath.dirname(opf)
        g = chapters.sort_values("boundary_no")
        made = [(t, "".join(plain(relocate(x["xml"], x["path"], folder)) for x in (ps if ps is not None else []))) for t, ps in zip(g["title"], g["pieces"], strict=True)]
        new = epub.repackage(files[opf], opf, made)
        rows = [(g["book"].iloc[0], 1_000_000 + k, p, zipfile.ZIP_DEFLATED, d, True) for k, (p, d) in enumerate(new)]
        return pd.DataFrame(rows, columns=["book", "ord", "path", "compress_type", "payload", "crc_ok"])

    fresh = entries.filter(package).select("book", "path", "payload").groupBy("book").cogroup(rows.groupBy("book")).applyInPandas(build, epub.ENTRY)
    return union(untouched.select(fresh.columns), fresh)


def rebuild(pages: DataFrame, title: str, author: str = "", language: str = "zh-Hant", cover: bytes | None = None) -> DataFrame:
    """Entries of a book from page lines split into chapters (chapter_no, chapter_title, paragraph, ord); paragraphs become ``p`` elements."""
    chapters = pages.groupBy("book", "chapter_no").agg(
        F.first("chapter_title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "paragraph"))), lambda x: x.paragraph).alias("paragraphs")
    )

    def build(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("chapter_no")
        body = lambda ps: "".join(f"<p>{html.escape(p)}</p>" for p in ps)
        made = epub.build_book(title, [(t, body(ps)) for t, ps in zip(g["title"], g["paragraphs"], strict=True)], language=language, author=author, cover=cover)
        return pd.DataFrame([(g["book"].iloc[0], k, p, c, d, True) for k, p, c, d in made], columns=["book", "ord", "path", "compress_type", "payload", "crc_ok"])

    return chapters.groupBy("book").applyInPandas(build, epub.ENTRY)
