"""Small Arrow functions for what Spark's string functions cannot do: entities, normal forms, member paths."""

from __future__ import annotations

import html
import posixpath
import re
import unicodedata
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_TARGET = StructType().add("member", StringType()).add("fragment", StringType())


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """All named and numeric entities."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_pdf_text(text: pd.Series) -> pd.Series:
    """Soft hyphens dropped, ligatures spelled out, NFC."""
    ligatures = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "­": ""}
    table = str.maketrans(ligatures)
    return text.map(lambda x: unicodedata.normalize("NFC", x.translate(table)), na_action="ignore")


def resolve_member(base: str | None, href: str | None) -> tuple[str | None, str | None]:
    """(member, fragment) that an href in member ``base`` points to; (None, None) outside the package."""
    if not href or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", href):
        return None, None
    path, _, fragment = href.partition("#")
    if not path:
        return base, unquote(fragment) or None
    member = posixpath.normpath(posixpath.join(posixpath.dirname(base or ""), unquote(path)))
    return member, unquote(fragment) or None


@F.pandas_udf(_TARGET)
def resolve_href(base: pd.Series, href: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([resolve_member(b, h) for b, h in zip(base, href, strict=True)], columns=["member", "fragment"])


@F.pandas_udf(StringType())
def relative_href(source: pd.Series, target: pd.Series, fragment: pd.Series) -> pd.Series:
    """The href from one member to another, with a quoted fragment if any."""
    return pd.Series(
        [
            posixpath.relpath(t, posixpath.dirname(s) or ".") + (f"#{quote(f)}" if isinstance(f, str) and f else "")
            for s, t, f in zip(source, target, fragment, strict=True)
        ]
    )
