"""One-permutation MinHash fingerprints, by DataFrame functions only.

The five-word shingles of a text are hashed once.  The top bits of a hash are its
bin, a bin's minimum is its value; empty bins borrow from another bin by optimal
densification (each empty bin probes bins in a pseudo-random order of its own until it
meets a full one).  Of each bin the low-order bits are kept, eight bins to a 64-bit word.
The likeness of two fingerprints is their share of equal bins, corrected for equality by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.llm.workspace import identified

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Low-order bits kept of each bin; the packing below is for bytes.
KEPT_BITS = 8
#: Random probes of an empty bin before it takes the full bin that is first in its own order.
PROBES = 40
#: Rows of a stretch of ids, the most stretches, and the keys that they are cut by.
STRETCH_ROWS, MOST_STRETCHES, STRETCH_SAMPLE = 2000, 4096, 16384

_LOW = (1 << (64 - BIN_BITS)) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def add_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: array<bigint> of BINS / 8 packed words; empty for a text without words.

    Words are runs of anything but ASCII white space; a text of one to four words has them as its one shingle.
    A null text is the empty one.  A text of any length is read whole.
    """
    own = [f"_{out_col}_{k}" for k in ("words", "sorted", "bins", "dense")]
    words, ordered, bins, dense = own
    w = F.col(words)
    shingles = (
        F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    # The largest hash of each bin closes the bin: sorted, a bin's first entry is its minimum, or this if it is empty.
    ends = F.array(*[F.lit(_signed(b << (64 - BIN_BITS) | _LOW)) for b in range(BINS)])
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    s, v = F.col(ordered), F.col(bins)
    first = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    full = F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_LOW)) != F.lit(_LOW), x))
    here = lambda j, a: F.pmod(F.xxhash64(j, F.lit(a)), F.lit(BINS)).cast("int")
    rest = lambda j: F.array_min(
        F.filter(F.transform(v, lambda x, i: F.when(x.isNotNull(), F.struct(F.xxhash64(j, i).alias("o"), x.alias("x")))), lambda e: e.isNotNull())
    ).getField("x")
    probed = F.transform(v, lambda x, j: F.coalesce(x, *[F.get(v, here(j, a)) for a in range(PROBES)], rest(j)))
    d = F.col(dense)
    # Bound by an outer function, so that the optimizer cannot inline the bins into the loop over the words.
    pack = lambda e: F.transform(
        F.sequence(F.lit(0), F.lit(BINS // 8 - 1)),
        lambda g: F.aggregate(
            F.slice(e, g * 8 + 1, F.lit(8)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 8).bitwiseOR(x.bitwiseAND(F.lit(255)))
        ),
    )
    packed = F.get(F.transform(F.array(d), pack), 0)
    texts = F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+")
    return (
        df.withColumn(words, F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.xxhash64(x)))
        .withColumn(ordered, F.sort_array(F.concat(shingles, ends)))
        .withColumn(bins, full)
        .withColumn(dense, F.when(F.size(w) > 0, probed))
        .withColumn(out_col, F.when(F.size(w) > 0, packed).otherwise(F.array().cast("array<bigint>")))
        .drop(*own)
    )


def to_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; two empty ones are alike, one empty is like no other."""
    lanes, carry = F.lit(0x00FF00FF00FF00FF), F.lit(0x0100010001000100)

    def equal_bytes(x: Column, y: Column) -> Column:
        # A byte that differs carries out of its lane; every second byte at a time, so that sums stay positive.
        z = x.bitwiseXOR(y)
        differ = lambda half: F.bit_count((half.bitwiseAND(lanes) + lanes).bitwiseAND(carry))
        return F.lit(8) - differ(z) - differ(F.shiftrightunsigned(z, 8))

    same = F.aggregate(F.zip_with(a, b, equal_bytes), F.lit(0), lambda acc, x: acc + x)
    chance = 2.0**-KEPT_BITS
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))
    )


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<c>`` of the next row in descending ``id_col``; the last row's next is the first.

    Ids of any ordered type; null ids come last, and rows of one id go by their place in storage.  An empty table gives an empty result.

    Rows are dealt by stretches of that order.  A stretch begins at one of the rows that cut a bounded sample of the keys (the
    STRETCH_SAMPLE with the smallest hashes) into equal parts, so it has about STRETCH_ROWS rows, or a MOST_STRETCHES-th of the
    table; the sample bears on balance only.  Each stretch also gets the first row of the one below.
    """
    found = identified(df, "_place")
    keyed = found.withColumn("_key", F.struct(F.col(id_col).isNotNull().alias("there"), F.col(id_col).alias("id"), F.col("_place").alias("place"))).drop("_place")
    keys = keyed.select("_key")
    parts = min(MOST_STRETCHES, max(1, keys.count() // STRETCH_ROWS))
    sample = keys.orderBy(F.xxhash64("_key"), "_key").limit(STRETCH_SAMPLE)
    whole = Window.partitionBy()
    place = (F.row_number().over(Window.orderBy(F.col("_key").desc())) - 1) * parts
    cuts = sample.select("_key", F.floor(place / F.count("*").over(whole)).alias("i")).groupBy("i").agg(F.max("_key").alias("_key")).filter("i > 0").select("_key")
    heads = union(keys.agg(F.max("_key").alias("_key")), cuts).agg(F.sort_array(F.collect_set("_key"), asc=False))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MOST_STRETCHES.bit_length()))])
    at_least = lambda i: F.coalesce(F.get("_heads", i) >= F.col("_key"), F.lit(False))
    part = F.aggregate(steps, F.lit(0), lambda i, step: F.when(at_least(i + step), i + step).otherwise(i))
    above = F.when(F.col("_part") > 0, F.col("_part") - 1).otherwise(F.size("_heads") - 1)
    entry = lambda p, copy: F.struct(p.alias("part"), F.lit(copy).alias("copy"))
    own = F.array(entry(F.col("_part"), False))
    both = F.array(entry(F.col("_part"), False), entry(above, True))
    dealt = (
        keyed.withColumn("_heads", heads.scalar())
        .withColumn("_part", part)
        .withColumn("_at", F.when(F.get("_heads", F.col("_part")) == F.col("_key"), both).otherwise(own))
        .drop("_heads", "_part")
        .withColumn("_at", F.explode("_at"))
    )
    order = Window.partitionBy("_at.part").orderBy("_at.copy", F.col("_key").desc())
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter(~F.col("_at.copy")).drop("_at", "_key")
