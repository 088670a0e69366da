"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes.  The distinct blocks are
sorted into integer names; then, level by level, the distinct pairs of adjacent
names get integer names in turn, until each document has one name.  Two documents
of as many levels have one name exactly when their bytes are equal.

Blocks are sorted by their digests, and a name is the place in that order over the whole corpus, so names
depend on the texts only.  Occurrences of blocks travel as digests; should two different blocks ever share a
digest, the occurrences of that digest are matched by content instead, so the
names never rest on the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.llm.workspace import Table, identified, join_keys, ranked, write_table

BLOCK_BYTES = 4096


def normalized(text: Column) -> Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _md5(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    raw = F.col("_norm").cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("_norm") - 1).cast("int")), F.lit(block_bytes))
    blocks = F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(block_bytes)))
    return docs.withColumn("text_sha256", F.sha2("_norm", 256)).select("_uid", "text_sha256", F.posexplode(blocks).alias("j", "block"))


def _done(level: DataFrame, depth: int) -> DataFrame:
    """The documents that a level gives one name."""
    last = level.groupBy("_uid").agg(F.max("j").alias("last"), F.max("name").alias("name")).filter("last = 0")
    return last.select("_uid", F.lit(depth).alias("levels"), "name")


def name_texts(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Callable[[Column], Column] = _md5
) -> Table:
    """A table (_uid, levels, name, text_sha256) for ``docs`` (_uid, _norm): equal names at equal levels mean equal texts.

    ``_uid`` must be the same in every scan.
    """
    # One scan gives the narrow occurrences, another the contents, of which a map task sends each distinct block once.
    cut = _cut(docs, block_bytes)
    occurrences = write_table(
        cut.select("_uid", "j", digest(F.col("block")).alias("d"), F.when(F.col("j") == 0, F.col("text_sha256")).alias("text_sha256")),
        "blocks",
    )
    blocks = cut.groupBy("block").agg(F.count("*").alias("uses")).select(digest(F.col("block")).alias("d"), "uses")
    kinds = blocks.groupBy("d").agg(F.sum("uses").alias("uses"), F.count("*").alias("kinds"))
    total = occurrences.df.count()
    names, sums = ranked(kinds, ["d"], "block-names", sums=("uses", "kinds"), rows=total)
    first = join_keys(occurrences.df, names.df, ["d"], "uses", total).select("_uid", "j", "name", "kinds")
    spent = [names]
    if (sums["kinds"] or 0) > sums["rows"]:
        clash = names.df.filter("kinds > 1").select("d")
        shared = cut.withColumn("d", digest(F.col("block"))).join(clash, "d", "left_semi").select("_uid", "j", "d", "block")
        own, _ = ranked(shared.groupBy("d", "block").agg(F.count("*").alias("uses")), ["d", "block"], "clash-names", rows=total)
        spent.append(own)
        # Names below -1, which stands for no neighbour, are apart from all others.
        by_content = join_keys(shared, own.df, ["d", "block"], "uses", total).select("_uid", "j", (-2 - F.col("name")).alias("name"))
        first = union(first.filter("kinds = 1").select("_uid", "j", "name"), by_content)
    level = write_table(first.select("_uid", "j", "name"), "level-0", rows=total)
    spent.append(level)
    done, depth = [_done(level.df, 0)], 0
    while True:
        # Documents of one name are done; the rest go up one level.
        width = level.df.groupBy("_uid").agg(F.max("j").alias("last"))
        pairs = (
            level.df.join(width.filter("last > 0"), "_uid")
            .groupBy("_uid", F.floor(F.col("j") / 2).cast("int").alias("k"))
            .agg(
                F.max(F.when(F.col("j") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("j") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = write_table(pairs, f"pairs-{depth}", rows=total)
        depth += 1
        above, sums = ranked(pairs.df.groupBy("a", "b").agg(F.count("*").alias("uses")), ["a", "b"], f"pair-names-{depth}", sums=("uses",), rows=total)
        spent += [pairs, above]
        if not sums["rows"]:
            break
        level = write_table(join_keys(pairs.df, above.df, ["a", "b"], "uses", sums["uses"]).select("_uid", F.col("k").alias("j"), "name"), f"level-{depth}", rows=total)
        spent.append(level)
        done.append(_done(level.df, depth))
    named = write_table(union(*done).join(occurrences.df.filter("j = 0").select("_uid", "text_sha256"), "_uid"), "exact-names", rows=total)
    for t in [occurrences, *spent]:
        t.drop()
    return named


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column], Column] = _md5,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of ASCII white space is one
    space; a null text counts as empty.  Of equal texts the row with the smallest
    id stays (a null id only when no other is there).  Rows repeated with one id are members of one
    group; one of them stays.  An empty table gives an empty result; only
    the id and text columns are read.

    Groups of any size are counted by partial sums, and a large group's name is broadcast, so its rows
    stay where they are.  A row's normalised text may have up to 2 GB, as a cell of a table.
    """
    base = identified(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_place")
    # The place is part of the uid only to tell repeated ids apart.
    base = base.select(normalized(F.col("_text")).alias("_norm"), F.struct("_id", "_place").alias("_uid"))
    names = name_texts(base, block_bytes, digest)
    groups = names.df.groupBy("levels", "name").agg(
        F.min(F.struct(F.col("_uid._id").isNull().alias("z"), F.col("_uid").alias("u"))).alias("keep"),
        F.count("*").alias("group_size"),
    )
    n = names.df.count()
    groups = write_table(groups, "exact-groups", rows=n)
    return join_keys(names.df, groups.df, ["levels", "name"], "group_size", n).select(
        F.col("_uid._id").alias(id_col),
        F.col("keep.u._id").alias("keep_id"),
        "group_size",
        (F.col("_uid") == F.col("keep.u")).alias("kept"),
        "text_sha256",
    )
