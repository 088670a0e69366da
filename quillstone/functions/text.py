"""Column functions over lines and characters.

Character classes are parameters everywhere: Java regular-expression classes such as ``CJK``
(the default) or ``LETTER``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u3400-\\u9FFF]"
CJK_BASIC = "[\\u4E00-\\u9FFF]"
LETTER = "\\p{L}"

#: Numerals, kinds of division and terminal marks that the rules name.
NUMERALS = "零一二三四五六七八九十百千0-9"
CHAPTER = f"^第[{NUMERALS}]+[章節编編篇卷]"
TERMINAL = (".", "!", "?", '"', "'", ")", "]", "}", ":", ";", "。", "！", "？", "：", "；", "」", "』", "）", "】", "〉", "》")
NO_JOIN = (":", ";", ",", "-", "：", "；", "，")


def chars_of(text: Column, char_class: str = CJK) -> Column:
    """The characters of a class, in order, as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({char_class})"), F.lit(1))


def compact(text: Column, char_class: str = CJK) -> Column:
    """Only the characters of a class."""
    return F.array_join(chars_of(text, char_class), "")


def utf8(data: Column) -> Column:
    """Bytes as text; those that are no UTF-8 are left out."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def count_class(text: Column, char_class: str = CJK) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(char_class))


def bigrams_of(chars: Column) -> Column:
    """Adjacent pairs of an array of characters; empty below two."""
    n = F.size(chars)
    return F.when(
        n > 1, F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
    ).otherwise(F.array().cast("array<string>"))


def pairs_of(text: Column, char_class: str = CJK) -> Column:
    """Adjacent pairs of a text's class characters, whatever stands between them, in one pass; empty below two."""
    return F.regexp_extract_all(class_text(text, char_class), F.lit("(?s)(?=(..))"), F.lit(1))


def class_text(text: Column, char_class: str = CJK) -> Column:
    """Only the characters of a class, by leaving out all others."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?s)(?:(?!{char_class}).)+", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def no_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")


def strip_tags(html: Column, gap: str = " ") -> Column:
    """Tags as ``gap``: a space for scanning, the empty string for labels."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<[^>]+>", gap)


#: Entities that markup must escape, and the one of the no-break space.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(text: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """The common named entities, in turn; ``html_unescape`` in ``functions.html`` does all of them."""
    for name, value in entities:
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def visible_text(html: Column, gap: str = " ", entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    return squeeze(unescape(strip_tags(html, gap), entities))


def is_page_number(line: Column) -> Column:
    """Digits only, or up to three Chinese numerals."""
    s = F.trim(line)
    return s.rlike("^[0-9]+$") | s.rlike("^[零一二三四五六七八九十百千]{1,3}$")


def ends_with_any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.right(text, F.lit(1)).isin(*marks)


def looks_like_linewrap(before: Column, after: Column, most: int = 30, char_class: str = CJK) -> Column:
    """A short next line with class characters on both sides of the seam."""
    return (F.length(after) <= most) & F.rtrim(before).rlike(f"{char_class}$") & F.ltrim(after).rlike(f"^{char_class}")


def chapter_number(title: Column, fix_hundreds: bool = True) -> Column:
    """The number of a heading 第X章, Arabic or Chinese; null for other headings.

    Numerals are summed group by group: a unit multiplies the digit before it.  With ``fix_hundreds=False`` a
    unit multiplies everything before it instead, which misreads numbers such as 一百二十三; that is the
    literal rule some corpora were numbered by.
    """
    s = F.regexp_extract(title, f"^第([{NUMERALS}]+)章", 1)
    value = F.create_map(*[F.lit(x) for k, v in zip("零一二三四五六七八九十百千", (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 100, 1000)) for x in (k, v)])
    digits = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(value, c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("digit"))

    def grouped(acc: Column, v: Column) -> Column:
        return F.when(
            v >= 10,
            F.struct((acc.total + F.greatest(acc.digit, F.when((acc.total == 0) & (acc.digit == 0), 1).otherwise(acc.digit)) * v).alias("total"), F.lit(0).alias("digit")),
        ).otherwise(F.struct(acc.total.alias("total"), v.alias("digit")))

    right = F.aggregate(digits, start, grouped, lambda acc: acc.total + acc.digit)
    literal = F.aggregate(digits, F.lit(0), lambda acc, v: F.when(v >= 10, F.when(acc == 0, F.lit(1)).otherwise(acc) * v).otherwise(acc + v))
    # A leading ten counts before the rest in the literal rule.
    ten = F.aggregate(F.slice(digits, F.lit(2), F.greatest(F.size(digits) - 1, F.lit(0))), F.lit(10), lambda acc, v: F.when(v >= 10, acc * v).otherwise(acc + v))
    chinese = right if fix_hundreds else F.when(s.startswith("十"), ten).otherwise(literal)
    return F.when(s == "", F.lit(None).cast("int")).when(s.rlike("^[0-9]+$"), F.try_to_number(s, F.lit("999999999")).cast("int")).otherwise(chinese)


def safe_file_name(title: Column, number: Column) -> Column:
    """Letters and digits of a title and its number."""
    return F.concat(F.regexp_replace(title, "[^\\p{L}\\p{N}]+", ""), F.lit("_"), number.cast("string"), F.lit(".xhtml"))
