"""Image references of pages, and pages to be shown as pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKDOWN_IMAGE = "!\\[[^\\]]*\\]\\(([^)\\s]+)[^)]*\\)"
HTML_IMAGE = "(?i)<img\\b[^>]*?\\bsrc=[\"']([^\"']+)[\"']"
VISUAL_TITLE = "(家\\s*系\\s*[圖图]|家\\s*[譜谱]|系\\s*[圖图]|地\\s*[圖图]|示\\s*意\\s*[圖图]|關\\s*係\\s*[圖图]|关\\s*系\\s*[图圖])"
FAMILY_TITLE = "家\\s*系\\s*[圖图]|家\\s*[譜谱]|系\\s*[圖图]"
LEAST_INK = 0.005


def is_local(path: Column) -> Column:
    return ~path.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")


def image_references(text: Column) -> Column:
    """Paths of markdown images, then of HTML images, each once, in order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(MARKDOWN_IMAGE), F.lit(1)), F.regexp_extract_all(t, F.lit(HTML_IMAGE), F.lit(1))))


def missing_assets(pages: DataFrame, assets: DataFrame, keep: list[str], text_col: str, asset_col: str = "path") -> DataFrame:
    """(keep…, path) of local images that no asset holds."""
    refs = pages.select(*keep, F.explode(F.filter(image_references(F.col(text_col)), is_local)).alias("path"))
    return refs.join(assets.select(F.col(asset_col).alias("path")).distinct(), "path", "left_anti")


def _literal(path: Column) -> Column:
    return F.concat(F.lit("\\Q"), path, F.lit("\\E"))


def strip_images(text: Column, missing: Column) -> Column:
    """Text without references to the paths in an array, and without containers that this leaves empty."""
    gone = F.aggregate(
        missing, text,
        lambda acc, p: F.regexp_replace(
            F.regexp_replace(acc, F.concat(F.lit("!\\[[^\\]]*\\]\\("), _literal(p), F.lit("[^)]*\\)")), F.lit("")),
            F.concat(F.lit("(?i)<img\\b[^>]*?\\bsrc=[\"']"), _literal(p), F.lit("[\"'][^>]*>")), F.lit(""),
        ),
    )
    return F.regexp_replace(gone, "(?i)<div[^>]*>\\s*</div>", "")


def rewrite_single(text: Column, packaged: Column) -> Column:
    """The one dangling local reference renamed to the one unused asset; otherwise the text as it is."""
    refs = F.filter(image_references(text), is_local)
    dangling, unused = F.array_except(refs, packaged), F.array_except(packaged, refs)
    return F.when((F.size(dangling) == 1) & (F.size(unused) == 1), F.replace(text, F.get(dangling, 0), F.get(unused, 0))).otherwise(text)


def plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<[^>]+>|[#\\s]", "")


def needs_fallback(text: Column, image_paths: Column, assets: Column, ink: Column) -> Column:
    """A sparse page with a visual title, an empty page with ink on it, or a page with an asset missing."""
    none = F.size(image_paths) == 0
    sparse = none & F.length(plain(text)).between(1, 40) & F.coalesce(text, F.lit("")).rlike(VISUAL_TITLE)
    empty = none & (plain(text) == "") & (ink >= LEAST_INK)
    lacking = F.exists(image_paths, lambda p: ~p.startswith("imgs/page_fallback_") & ~F.array_contains(assets, p))
    return sparse | empty | lacking


def fallback_images(pages: DataFrame, page_col: str, text_col: str, images_col: str, assets_col: str, ink_col: str, width_col: str, height_col: str) -> DataFrame:
    """``pages`` with fallback_path (null where none is needed), rotation, and the reference added to text and images."""
    path = F.format_string("imgs/page_fallback_%04d.png", F.col(page_col))
    need = needs_fallback(F.col(text_col), F.map_keys(images_col), F.col(assets_col), F.col(ink_col))
    turned = plain(F.col(text_col)).rlike(FAMILY_TITLE) & (F.col(height_col) > F.col(width_col))
    return (
        pages.withColumn("fallback_path", F.when(need, path))
        .withColumn("rotation", F.when(turned, 90).otherwise(0))
        .withColumn(images_col, F.when(need, F.map_concat(F.map_filter(images_col, lambda k, v: k != path), F.create_map(path, F.lit("")))).otherwise(F.col(images_col)))
        .withColumn(text_col, F.when(need, F.concat(F.coalesce(text_col, F.lit("")), F.lit("\n\n!["), F.lit("]("), path, F.lit(")"))).otherwise(F.col(text_col)))
    )


def blank_data_uris(images: Column) -> Column:
    """A map of images with embedded data dropped."""
    return F.transform_values(images, lambda k, v: F.when(v.startswith("data:"), F.lit("")).otherwise(v))
