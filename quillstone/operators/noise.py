"""Text noise: recognition artefacts, tables of numbers, captions made by vision models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import unescape

#: Patterns of artefacts and the words of labels and descriptions.
TABLE = "(?is)(<table\\b.*?</table>)"
DOTTED = "(?<![0-9.])([0-9]+(?:\\.[0-9]+){2,})(?![0-9.])"
IMAGE_LABELS = (
    "natural_image", "natural image", "text_image", "text image", "photo", "photograph", "figure", "illustration", "drawing", "painting", "portrait",
    "landscape", "screenshot", "diagram", "chart", "graph", "logo", "icon", "symbol", "sign", "badge", "emblem", "map", "poster", "banner",
)
DESCRIBED_LABELS = ("natural_image", "natural image", "photo", "photograph", "figure")
NOTE = (
    "(?i)\\((no\\s+visible|without|with|text)\\s(visible\\s+)?"
    "(text|symbols?|people|person|background|logo|writing|lettering|signage|branding|face|body)"
)
DESCRIPTION = (
    "(?i)^(Full.body|Close.up|Aerial|Overhead|Side.view|Front.view|Back.view|Top.view|Bottom.view|Wide.angle|Extreme\\s+close.up|Medium\\s+shot|"
    "Long\\s+shot|Cropped|Blurred|A\\s+(photo|picture|shot|view|close.up|portrait)\\s+of\\b)"
)
STARTERS = "第這那如但可因爲所在其此該本而若則又並且或雖然何當從對與以一二三四五六七八九十"
CJK_MARKS = "，。！？、：；」「『』（）【】《》…—"
CLOSERS = ("。", "！", "？", ".", "!", "?", "」", "』")


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))


def is_year_table(table: Column) -> Column:
    """Twelve rows, thirty numbers and nothing else, four fifths of them years 1900 to 2200 that differ and span widely."""
    text = unescape(F.regexp_replace(table, "(?is)<[^>]+>", " "))
    numbers = _numbers(text)
    years = F.filter(numbers, lambda x: x.between(1900, 2200))
    rest = F.regexp_replace(text, "[0-9\\s.,;:|+\\-–—/\\\\年月]+", "")
    return (
        (F.regexp_count(table, F.lit("(?i)<tr\\b")) >= 12) & (F.size(numbers) >= 30) & (F.trim(rest) == "") & (F.size(years) >= 0.8 * F.size(numbers))
        & (F.size(F.array_distinct(years)) >= 12) & (F.array_max(years) - F.array_min(years) >= 12)
    )


def is_outline_table(table: Column) -> Column:
    """Sixteen cells mostly of dotted numbers 1.2.3 that share a prefix, with tails that differ and span widely."""
    text = unescape(F.regexp_replace(table, "(?is)<[^>]+>", " "))
    tokens = F.regexp_extract_all(text, F.lit(DOTTED), F.lit(1))
    prefixes = F.transform(tokens, lambda t: F.regexp_replace(t, "\\.[0-9]+$", ""))
    tails = F.transform(tokens, lambda t: F.substring_index(t, ".", -1).cast("decimal(38,0)"))
    shared = F.array_max(F.transform(F.array_distinct(prefixes), lambda p: F.size(F.filter(prefixes, lambda q: q == p))))
    cells = F.regexp_count(table, F.lit("(?i)<t[dh]\\b"))
    rest = F.regexp_replace(F.regexp_replace(text, DOTTED, " "), "[0-9\\s.,;:|+\\-–—/\\\\年月·•、。．]+", "")
    return (
        (cells >= 16) & (F.size(tokens) >= 16) & (F.size(tokens) >= 0.75 * cells) & (shared >= 0.8 * F.size(tokens)) & (F.size(F.array_distinct(tails)) >= 12)
        & (F.array_max(tails) - F.array_min(tails) >= 12) & (F.length(F.trim(rest)) <= 12)
    )


def is_noise_table(table: Column) -> Column:
    return is_year_table(table) | is_outline_table(table)


def drop_noise_tables(text: Column) -> Column:
    """Text without its noise tables; others stay as they are."""
    tables = F.array_distinct(F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)))
    return F.aggregate(F.filter(tables, is_noise_table), text, lambda acc, t: F.replace(acc, t, F.lit("")))


def clean_ocr_noise(text: Column, char_class: str = "[\\u3400-\\u9FFF]") -> Column:
    """Line ends made LF, noise tables gone, false math unwrapped, runs of blank lines at most one, ends trimmed; null gives the empty string."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\r\\n?", "\n")
    t = drop_noise_tables(t)
    t = F.regexp_replace(t, "\\$\\s*\\\\underset\\{\\\\cdot\\}\\{([^{}]+)\\}\\s*\\$", "$1")
    t = F.regexp_replace(t, "20\\s*\\$\\s*\\\\frac\\{1\\}\\{2\\}\\s*\\$\\s*7年", "2017年")
    t = F.regexp_replace(t, f"({char_class})\\s*\\$\\s*\\\\downarrow\\s*\\$\\s*({char_class})", "$1、$2")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def noise_tokens(entries: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(keep…, token, n): artefacts that are left in texts."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    counts = F.array(
        F.struct(F.lit("underset").alias("token"), F.regexp_count(t, F.lit("\\\\underset\\{\\\\cdot\\}")).alias("n")),
        F.struct(F.lit("downarrow").alias("token"), F.regexp_count(t, F.lit("[\\u3400-\\u9FFF]\\s*\\$\\s*\\\\downarrow\\s*\\$\\s*[\\u3400-\\u9FFF]")).alias("n")),
        F.struct(F.lit("frac").alias("token"), F.regexp_count(t, F.lit("20\\s*\\$\\s*\\\\frac\\{1\\}\\{2\\}\\s*\\$\\s*7年")).alias("n")),
        F.struct(F.lit("noise table").alias("token"), F.size(F.filter(F.regexp_extract_all(t, F.lit(TABLE), F.lit(1)), is_noise_table)).alias("n")),
    )
    return entries.select(*keep, F.explode(counts).alias("c")).select(*keep, "c.token", "c.n").filter("n > 0")


def ascii_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\\x00-\\x7F]")) / F.greatest(F.length(text), F.lit(1))


def is_caption_line(line: Column) -> Column:
    """A label alone, a label with a long ASCII description, or a long mostly ASCII line with a description's cues."""
    s = F.trim(line)
    low = F.lower(s)
    described = F.lit(False)
    for label in DESCRIBED_LABELS:
        rest = F.regexp_replace(F.substring(low, F.lit(len(label) + 1), F.length(low)), "^[:：\\s]+", "")
        described = described | (
            low.rlike(f"^{label}[:：]") & (F.length(low) > len(label) + 15) & (F.length(rest) > 20) & (ascii_share(rest) >= 0.85)
        )
    cued = (F.length(s) > 40) & (ascii_share(s) >= 0.80) & (s.rlike(NOTE) | s.rlike(DESCRIPTION))
    return low.isin(*IMAGE_LABELS) | described | cued


def clean_alt_text(text: Column, keep_image: bool = True) -> Column:
    """Image references without generated alt texts: labels, or more than 50 characters mostly ASCII.

    ``keep_image=False`` turns such an image into an empty link, as some older corpora have it.
    """
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit("(!\\[[^\\]]+\\]\\([^)]+\\))"), F.lit(1)))
    alt = lambda r: F.regexp_extract(r, "^!\\[([^\\]]*)\\]", 1)
    made = F.filter(refs, lambda r: F.lower(F.trim(alt(r))).isin(*IMAGE_LABELS) | ((F.length(alt(r)) > 50) & (ascii_share(alt(r)) >= 0.85)))
    mark = "![](" if keep_image else "[]("
    return F.aggregate(made, text, lambda acc, r: F.replace(acc, r, F.concat(F.lit(mark), F.trim(F.regexp_extract(r, "\\]\\(([^)]+)\\)$", 1)), F.lit(")"))))


def _last(s: Column) -> Column:
    return F.right(s, F.lit(1))


def strip(s: Column) -> Column:
    """Text without white space at its ends, that of other scripts included."""
    return F.regexp_replace(s, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def _merge_pairs(lines: Column, joins, merged, leaves_first: bool) -> Column:
    """Lines in which a text line and the next one, blank lines apart, are one where ``joins`` says so; every line keeps its place.

    The merged text stands in the first line's place, or else the second's, and the other is left blank.  A line is used once, and
    the last two lines begin no pair.
    """
    last = F.size(lines) - 2
    none = F.array().cast("array<string>")
    # done: lines that are settled; held: a text line that may begin a pair; gap: the blank lines after it.
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("held"), none.alias("gap"))
    state = lambda done, held, gap: F.struct(done.alias("done"), held.alias("held"), gap.alias("gap"))
    nothing = F.lit(None).cast("string")
    settled = lambda acc: F.when(acc.held.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.held), acc.gap))

    def step(acc: Column, x: Column) -> Column:
        line, at = x.line, x.at
        a, b = strip(acc.held), strip(line)
        whole = merged(a, b)
        pair = F.array(whole) if leaves_first else F.array(F.lit(""))
        rest = F.array(F.lit("")) if leaves_first else F.array(whole)
        hold = F.when(at < last, line)
        return (
            F.when((b == "") & acc.held.isNotNull(), state(acc.done, acc.held, F.array_append(acc.gap, line)))
            .when(b == "", state(F.array_append(acc.done, line), nothing, none))
            .when(acc.held.isNotNull() & joins(a, b), state(F.concat(acc.done, pair, acc.gap, rest), nothing, none))
            .otherwise(state(F.when(hold.isNull(), F.array_append(settled(acc), line)).otherwise(settled(acc)), hold, none))
        )

    rows = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return F.aggregate(rows, start, step, settled)


def repair_lines(lines: Column) -> Column:
    """Lines with misplaced ends put back and cut sentences joined; every line keeps its place, and what moved leaves a blank one.

    A fragment of at most five characters that ends terminally before an open longer line moves to that line's end.  Then a line
    of more than 15 characters without a closing mark takes in a next line that doesn't look like a sentence's start.
    """
    moved = _merge_pairs(
        lines,
        lambda a, b: (F.length(a) <= 5) & _last(a).isin(*CLOSERS) & (F.length(b) > 10) & ~_last(b).isin(*CLOSERS),
        lambda a, b: F.concat(b, a),
        False,
    )
    plain = lambda s: ~s.rlike("^[#!]")
    open_end = lambda a: (F.length(a) > 15) & ~_last(a).isin(*CLOSERS) & ~_last(a).isin(*CJK_MARKS)
    goes_on = lambda b: (F.length(b) > 5) & ~F.substring(b, 1, 1).isin(*STARTERS) & ~F.substring(b, 1, 1).isin(*CJK_MARKS) & ~b.rlike("^[\\p{Nd}\\x00-\\x7F]")
    return _merge_pairs(moved, lambda a, b: plain(a) & plain(b) & open_end(a) & goes_on(b), lambda a, b: F.concat(a, b), True)


def clean_captions(text: Column, keep_image: bool = True) -> Column:
    """Detail blocks, caption lines and generated alt texts gone, lines repaired; the other line ends stay as they are."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "(?s)<details>\\s*<summary>[^<]*</summary>.*?</details>", "")
    t = clean_alt_text(t, keep_image)
    kept = F.filter(F.split(t, "\n", -1), lambda x: ~is_caption_line(x))
    return F.array_join(repair_lines(kept), "\n")
