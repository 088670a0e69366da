"""Packaged books: entries, spine, navigation and text elements as tables, and a sink.

An entry table has (book, ord, path, compress_type, payload); ``ord`` is the order in the archive.
"""

from __future__ import annotations

import html
import io
import os
import re
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.html import resolve_member
from quillstone.functions.text import squeeze, utf8

ENTRY = "book string, ord int, path string, compress_type int, payload binary, crc_ok boolean"
#: Members that hold no text of the book.
STRUCTURAL = ("content.opf", "toc.ncx", "nav.xhtml", "nav.html")
ELEMENT = re.compile(r"<(h[1-6]|p|div|span)\b([^>]*)>(.*?)</\1\s*>", re.I | re.S)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives below ``path``, as ENTRY; a file that is no archive gives one row with a null path."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for book, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for k, info in enumerate(z.infolist()):
                            try:
                                data, ok = z.read(info), True
                            except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):  # damaged, encrypted, or packed in another way
                                data, ok = None, False
                            rows.append((book, k, info.filename, info.compress_type, data, ok))
                except zipfile.BadZipFile:
                    rows.append((book, 0, None, None, None, False))
                yield pd.DataFrame(rows, columns=["book", "ord", "path", "compress_type", "payload", "crc_ok"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(unzip, ENTRY)


def content_texts(entries: DataFrame) -> DataFrame:
    """(book, ord, path, xhtml, text) of content members in archive order."""
    base = F.lower(F.substring_index("path", "/", -1))
    rows = entries.filter(F.lower("path").rlike("\\.x?html$") & ~base.isin(*STRUCTURAL))
    xhtml = utf8(F.col("payload"))
    from quillstone.functions.html import html_unescape

    return rows.select("book", "ord", "path", xhtml.alias("xhtml"), squeeze(html_unescape(F.regexp_replace(xhtml, "(?is)<[^>]+>", " "))).alias("text"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parse(data: bytes | None):
    try:
        return ElementTree.fromstring(data) if data else None
    except ElementTree.ParseError:
        return None


def package_file(files: dict[str, bytes]) -> str | None:
    """The member that is a book's package file."""
    root = _parse(files.get("META-INF/container.xml"))
    found = [x.get("full-path", "").strip() for x in root.iter() if _local(x.tag) == "rootfile"] if root is not None else []
    named = [p for p in files if os.path.basename(p).lower() == "content.opf"]
    return next(iter([p for p in found if p] + named), None)


def _nav_rows(files: dict[str, bytes], member: str) -> list[tuple]:
    root, rows = _parse(files.get(member)), []

    def walk(node, depth: int) -> None:
        for child in node:
            if _local(child.tag) == "ol":
                walk(child, depth + 1)
            elif _local(child.tag) == "li":
                for x in child:
                    if _local(x.tag) in ("a", "span"):
                        target = resolve_member(member, x.get("href"))
                        rows.append(("nav", depth, " ".join("".join(x.itertext()).split()), x.get("href"), *target))
                        break
                walk(child, depth)
            else:
                walk(child, depth)

    if root is not None:
        walk(root, 0)
    return rows


def _ncx_rows(files: dict[str, bytes], member: str) -> list[tuple]:
    root, rows = _parse(files.get(member)), []

    def walk(node, depth: int) -> None:
        for child in node:
            if _local(child.tag) == "navPoint":
                label = next((" ".join("".join(x.itertext()).split()) for x in child if _local(x.tag) == "navLabel"), "")
                src = next((x.get("src") for x in child if _local(x.tag) == "content"), None)
                rows.append(("ncx", depth + 1, label, src, *resolve_member(member, src)))
                walk(child, depth + 1)
            else:
                walk(child, depth)

    if root is not None:
        walk(root, 0)
    return rows


STRUCTURE = "book string, kind string, ord int, depth int, label string, href string, member string, fragment string"


def structure(entries: DataFrame) -> DataFrame:
    """Manifest, spine, nav and ncx rows of each book as STRUCTURE.

    Spine rows have the idref as label, and a null member where the manifest lacks it; manifest rows have the id as label.
    A book's package files are small, and one group holds those of one book.
    """

    def read(group: pd.DataFrame) -> pd.DataFrame:
        files = {p: d for p, d in zip(group["path"], group["payload"], strict=True) if isinstance(p, str)}
        book, rows, opf = group["book"].iloc[0], [], None
        opf = package_file(files)
        root = _parse(files.get(opf)) if opf else None
        ids: dict[str, str] = {}
        navs, ncxs = [p for p in files if os.path.basename(p) in ("nav.xhtml", "nav.html")], [p for p in files if p.endswith(".ncx")]
        if opf:
            rows.append(("opf", 0, "", opf, opf if opf in files else None, None))
        for x in root.iter() if root is not None else ():
            if _local(x.tag) == "item" and x.get("href"):
                member = resolve_member(opf, x.get("href"))[0]
                ids[x.get("id", "")] = member
                rows.append(("manifest", 0, x.get("id", ""), x.get("href"), member, x.get("properties")))
            elif _local(x.tag) == "itemref":
                rows.append(("spine", 0, x.get("idref", ""), None, ids.get(x.get("idref", "")), None))
        rows += [r for m in navs[:1] for r in _nav_rows(files, m)] + [r for m in ncxs[:1] for r in _ncx_rows(files, m)]
        out = pd.DataFrame(rows, columns=["kind", "depth", "label", "href", "member", "fragment"])
        out.insert(0, "book", book)
        out.insert(2, "ord", range(len(out)))
        return out

    base = F.lower(F.substring_index("path", "/", -1))
    small = entries.filter(base.isin(*STRUCTURAL, "container.xml") | base.endswith(".opf") | base.endswith(".ncx"))
    return small.select("book", "path", "payload").groupBy("book").applyInPandas(read, STRUCTURE)


ELEMENTS = "book string, path string, elem_no int, start int, stop int, tag string, text string, id string, name string"


def text_elements(entries: DataFrame) -> DataFrame:
    """Headings, paragraphs, divisions and spans of content members in order, as ELEMENTS; offsets are of characters."""

    def attribute(tag: str, name: str) -> str | None:
        m = re.search(rf"\b{name}\s*=\s*([\"'])(.*?)\1", tag, re.S)
        return html.unescape(m[2]) if m else None

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, path, data in zip(batch["book"], batch["path"], batch["payload"], strict=True):
                for k, m in enumerate(ELEMENT.finditer((data or b"").decode("utf-8", "ignore"))):
                    text = " ".join(html.unescape(re.sub(r"<[^>]+>", "", m[3])).split())
                    rows.append((book, path, k, m.start(), m.end(), m[1].lower(), text, attribute(m[2], "id"), attribute(m[2], "name")))
            yield pd.DataFrame(rows, columns=["book", "path", "elem_no", "start", "stop", "tag", "text", "id", "name"])

    base = F.lower(F.substring_index("path", "/", -1))
    rows = entries.filter(F.lower("path").rlike("\\.x?html?$") & ~base.isin(*STRUCTURAL))
    return rows.select("book", "path", "payload").mapInPandas(split, ELEMENTS)


BODY = "book string, path string, child_no int, tag string, text string, ids array<string>, xml string"


def body_children(entries: DataFrame) -> DataFrame:
    """The children of each content member's body in order, with all ids inside them, as BODY; malformed members have none."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, path, data in zip(batch["book"], batch["path"], batch["payload"], strict=True):
                root = _parse(data)
                body = next((x for x in root.iter() if _local(x.tag) == "body"), None) if root is not None else None
                for k, child in enumerate(body if body is not None else ()):
                    ids = [x.get("id") for x in child.iter() if x.get("id")]
                    text = " ".join("".join(child.itertext()).split())
                    rows.append((book, path, k, _local(child.tag), text, ids, ElementTree.tostring(child, encoding="unicode")))
            yield pd.DataFrame(rows, columns=["book", "path", "child_no", "tag", "text", "ids", "xml"])

    base = F.lower(F.substring_index("path", "/", -1))
    rows = entries.filter(F.lower("path").rlike("\\.x?html?$") & ~base.isin(*STRUCTURAL))
    return rows.select("book", "path", "payload").mapInPandas(split, BODY)


def write_books(entries: DataFrame, folder: str) -> DataFrame:
    """Write each book's entries as an archive in ``folder``; (book, path, entries).

    ``mimetype`` comes first and is stored; the others keep their order and way of compression.  A book is written to a temporary
    file that takes its name when complete.  ``folder`` is a path that all executors share; a task holds one book.
    """

    def write(group: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        book = group["book"].iloc[0]
        target = os.path.join(folder, os.path.basename(book) if book.endswith(".epub") else f"{os.path.basename(book)}.epub")
        rows = group.sort_values("ord", kind="stable")
        rows = pd.concat([rows[rows["path"] == "mimetype"], rows[rows["path"] != "mimetype"]])
        handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
        os.close(handle)
        try:
            with zipfile.ZipFile(temporary, "w") as z:
                for path, kind, data in zip(rows["path"], rows["compress_type"], rows["payload"], strict=True):
                    info = zipfile.ZipInfo(path, date_time=(1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else int(kind)
                    z.writestr(info, data or b"")
            os.replace(temporary, target)
        except BaseException:
            os.unlink(temporary)
            raise
        return pd.DataFrame({"book": [book], "path": [target], "entries": [len(rows)]})

    return entries.select("book", "ord", "path", "compress_type", "payload").groupBy("book").applyInPandas(write, "book string, path string, entries int")


def _page(title: str, body: str, sheets: list[str] = []) -> str:  # noqa: B006 (read only)
    e = html.escape
    links = "".join(f'<link rel="stylesheet" type="text/css" href="{e(x)}"/>' for x in sheets)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{e(title)}</title>{links}</head><body>{body}</body></html>'


def _contents(title: str, uid: str, files: list[str], titles: list[str]) -> tuple[str, str]:
    """nav and ncx of members that begin at ``#start``."""
    e = html.escape
    nav = "".join(f'<li><a href="{f}#start">{e(t)}</a></li>' for f, t in zip(files, titles, strict=True))
    points = "".join(
        f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{e(t)}</text></navLabel><content src="{f}#start"/></navPoint>'
        for k, (f, t) in enumerate(zip(files, titles, strict=True), 1)
    )
    head = f'<head><meta name="dtb:uid" content="{e(uid)}"/></head><docTitle><text>{e(title)}</text></docTitle>'
    ncx = f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">{head}<navMap>{points}</navMap></ncx>'
    return _page(title, f"<nav><ol>{nav}</ol></nav>"), ncx


#: Namespaces of package files.
COVER = '<meta name="cover" content="cover-image"/>'
OPF_SPACE, DC_SPACE = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/"


def repackage(opf: bytes, opf_path: str, chapters: list[tuple[str, str]]) -> list[tuple[str, bytes]]:
    """(path, payload) of a package file, nav, ncx and members for new chapters (title, XHTML body).

    Metadata and all items but the old text members stay; nav stays in the spine if it was there.  New members use the style sheets.
    """
    for prefix, space in (("", OPF_SPACE), ("dc", DC_SPACE), ("dcterms", "http://purl.org/dc/terms/")):
        ElementTree.register_namespace(prefix, space)
    root, folder = ElementTree.fromstring(opf), os.path.dirname(opf_path)
    part = lambda name: next((x for x in root.iter() if _local(x.tag) == name), None)
    manifest, spine = part("manifest"), part("spine")
    if manifest is None or spine is None:
        raise ValueError(f"{opf_path} has no manifest or no spine")
    title = " ".join("".join(part("title").itertext()).split()) if part("title") is not None else ""
    named = [x for x in root.iter() if _local(x.tag) == "identifier"]
    uid = next(((x.text or "").strip() for x in [*(x for x in named if x.get("id") == root.get("unique-identifier")), *named]), title)
    nav_id, ncx_id, sheets = None, None, []
    nav, ncx = "nav.xhtml", "toc.ncx"
    for item in list(manifest):
        kind, href, base = item.get("media-type", ""), item.get("href", ""), os.path.basename(item.get("href", ""))
        if "nav" in item.get("properties", "").split() or base in ("nav.xhtml", "nav.html"):
            nav_id, nav = item.get("id"), href
        elif kind == "application/x-dtbncx+xml":
            ncx_id, ncx = item.get("id"), href
        elif kind == "text/css":
            sheets.append(href)
        elif kind == "application/xhtml+xml" and base != "cover.xhtml":
            manifest.remove(item)
    space = root.tag[: root.tag.find("}") + 1]
    for name, kind, found in (("nav", "application/xhtml+xml", nav_id), ("ncx", "application/x-dtbncx+xml", ncx_id)):
        if found is None:
            more = {"properties": "nav"} if name == "nav" else {}
            ElementTree.SubElement(manifest, f"{space}item", {"id": name, "href": nav if name == "nav" else ncx, "media-type": kind, **more})
    shown = nav_id is not None and any(x.get("idref") == nav_id for x in spine)
    for x in list(spine):
        spine.remove(x)
    spine.set("toc", ncx_id or "ncx")
    files = [f"reading_{k:03d}.xhtml" for k in range(1, len(chapters) + 1)]
    if shown:
        ElementTree.SubElement(spine, f"{space}itemref", {"idref": nav_id})
    for k, f in enumerate(files, 1):
        ElementTree.SubElement(manifest, f"{space}item", {"id": f"reading_{k:03d}", "href": f, "media-type": "application/xhtml+xml"})
        ElementTree.SubElement(spine, f"{space}itemref", {"idref": f"reading_{k:03d}"})
    nav_page, ncx_page = _contents(title, uid, files, [t for t, _ in chapters])
    place = lambda href: os.path.normpath(os.path.join(folder, href))
    out = [(opf_path, ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)), (place(nav), nav_page.encode()), (place(ncx), ncx_page.encode())]
    return out + [(place(f), _page(t, f'<h1 id="start">{html.escape(t)}</h1>{body}', sheets).encode()) for f, (t, body) in zip(files, chapters, strict=True)]


def build_book(
    title: str, chapters: list[tuple[str, str]], uid: str = "urn:uuid:0", language: str = "zh-Hant", author: str = "", cover: bytes | None = None
) -> list[tuple[int, str, int, bytes]]:
    """Entries (ord, path, compress_type, payload) of a book of (title, XHTML body) chapters, with nav and ncx, and a cover picture if given."""
    e, page = html.escape, _page
    files = [f"chapter_{k:03d}.xhtml" for k in range(1, len(chapters) + 1)]
    nav, ncx = _contents(title, uid, files, [t for t, _ in chapters])
    picture, kind = ("cover.png", "image/png") if (cover or b"").startswith(b"\x89PNG") else ("cover.jpg", "image/jpeg")
    items = "".join(f'<item id="c{k}" href="{f}" media-type="application/xhtml+xml"/>' for k, f in enumerate(files, 1))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(files) + 1))
    items += f'<item id="cover-image" href="{picture}" media-type="{kind}" properties="cover-image"/>' if cover else ""
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?><package xmlns="{OPF_SPACE}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{DC_SPACE}">'
        f'<dc:identifier id="id">{e(uid)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:creator>{e(author)}</dc:creator><dc:language>{e(language)}</dc:language>'
        f"{COVER if cover else ''}</metadata><manifest>"
        f'<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{refs}</spine></package>'
    )
    members = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container), ("EPUB/content.opf", opf), ("EPUB/nav.xhtml", nav), ("EPUB/toc.ncx", ncx)]
    members += [(f"EPUB/{f}", page(t, f'<h1 id="start">{e(t)}</h1>{body}')) for f, (t, body) in zip(files, chapters, strict=True)]
    members += [(f"EPUB/{picture}", cover)] if cover else []
    return [(k, p, zipfile.ZIP_STORED if p == "mimetype" else zipfile.ZIP_DEFLATED, d if isinstance(d, bytes) else d.encode()) for k, (p, d) in enumerate(members)]
