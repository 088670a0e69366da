"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and queued twice (two
passes over the source at most).  A queued copy's virtual finish time is its
source's cumulative words divided by the source's target; the copies are put in
global order of finish time and the order is cut at the total budget.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.unions import union
from quillstone.llm.workspace import materialize

#: Words as runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one source (or of one stretch of finish times) that one window group holds on average.
GROUP_ROWS = 2000
#: Equal rows that one row is unfolded into at a time.
CHUNK = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _literal(value, kind: T.DataType) -> Column:
    """A value of any type that ids have, structs of such included."""
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Targets of sources by water-filling.

    ``sources`` has one row a source (source, source_size); the windows below see
    one row a source only.  Sorted by cap over weight, the level at which all
    remaining sources could share rises while caps bind and falls afterwards, so
    its maximum is the level that the repeated resharing of excess ends at.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(n)) + 1).cast("int"))
    )
    total = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    return (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
        )
        .withColumn("level", F.max("level").over(total))
        .withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
        .select("source", "source_size", "rank", "weight", "budget", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shuffle: Column | None = None,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken.

    A document's size is its number of words (null text: 0).  Sources, in code
    point order with null last as a source of its own, take the ``weights`` in
    turn and share ``share`` times all words; a target is at most ``most`` times its
    source.  ``taken`` is what the mix takes of a document: 0 up to ``most`` times its size.
    Order within a source follows the MD5 of ``shuffle`` (the id), then id and size, so reruns agree;
    repeated rows are queued one after the other, and empty documents take 0.
    An empty table gives an empty result.

    A source may hold any part of the rows: cumulative words are summed within
    hash ranges of about ``GROUP_ROWS`` rows, plus the totals of the ranges before.  Rows alike in source, id and size,
    as those without ids may be, are one row with a count until they are queued, so an id may have any part of the rows too.
    The cut is found from sums over stretches of finish time, then exactly
    within the one stretch where the budget ends.
    """
    shuffle = F.col(id_col) if shuffle is None else shuffle
    h = F.conv(F.substring(F.md5(F.coalesce(shuffle.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"))
    rows = materialize(rows.groupBy("source", "h", "id", "size").agg(F.count("*").alias("k")), "mix-rows")
    n = rows.agg(F.sum("k")).first()[0] or 0
    ranges = max(1, math.ceil(n / GROUP_ROWS))
    rows = rows.withColumn("r", (F.col("h") / F.lit(float(16**15)) * ranges).cast("long"))

    sums = rows.groupBy("source", "r").agg(F.sum(F.col("size") * F.col("k")).alias("range_size"))
    sums = materialize(sums, "mix-sums", n)
    targets = materialize(
        source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most),
        "mix-targets",
        n,
    )
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    running = Window.partitionBy("source", "r").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    queued = (
        rows.alias("a")
        .join(starts.alias("b"), same("a", "b", "source", "r"))
        .select("a.*", "b.start")
        .withColumn("upto", F.col("start") + F.sum(F.col("size") * F.col("k")).over(running))
        .alias("a")
        .join(targets.alias("b"), same("a", "b", "source"))
        .select("id", "size", "k", "h", "upto", "a.source", "source_size", "target", "rank", "budget")
    )
    cum = (F.col("upto") - (F.col("k") - F.col("copy")) * F.col("size")).alias("cum")
    columns = ["id", "size", "h", cum, "source", "source_size", "target", "rank", "budget"]
    unfold = lambda df, first, last: df.withColumn("copy", F.explode(F.sequence(first, last))).select(columns)
    one = F.lit(1).cast("long")
    few = unfold(queued.filter(F.col("k") <= CHUNK), one, F.col("k"))
    chunk = F.col("chunk") * CHUNK
    many = queued.filter(F.col("k") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / CHUNK)))).repartition("h", "size", "chunk")
    queued = materialize(union(few, unfold(many, chunk + 1, F.least(F.col("k"), chunk + CHUNK))), "mix-queue", n)

    copies = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn(
        "finish", F.when(F.col("target") > 0, (F.col("cum") + F.col("turn") * F.col("source_size")) / F.col("target"))
    ).filter(F.col("finish").isNotNull())
    stretch = F.floor(F.col("finish") * F.lit(float(ranges)))
    by_stretch = copies.groupBy(stretch.alias("q")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    order = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        by_stretch.withColumn("upto", F.sum("words").over(order))
        .filter(F.col("upto") > F.col("budget"))
        .orderBy("q")
        .select("q", (F.col("upto") - F.col("words")).alias("before"))
        .first()
    )
    key = F.struct("finish", "rank", "h", "id", "size", "turn")
    if crossing is None:
        cut = None
    else:
        inside = Window.orderBy("finish", "rank", "h", "id", "size", "turn").rowsBetween(Window.unboundedPreceding, 0)
        cut = (
            copies.filter(stretch == crossing["q"])
            .withColumn("upto", F.lit(crossing["before"]) + F.sum("size").over(inside))
            .filter(F.col("upto") <= F.col("budget"))
            .agg(F.max(key).alias("cut"))
            .first()["cut"]
        )
    taken = F.lit(0).cast("long")
    for turn in range(most):
        finish = (F.col("cum") + F.lit(turn) * F.col("source_size")) / F.col("target")
        if crossing is None:
            fits = F.lit(True)
        elif cut is None:
            fits = F.floor(finish * F.lit(float(ranges))) < F.lit(crossing["q"])
        else:
            here = F.struct(
                finish.alias("finish"), F.col("rank"), F.col("h"), F.col("id"), F.col("size"), F.lit(turn).alias("turn")
            )
            there = F.struct(
                F.lit(cut["finish"]).alias("finish"),
                F.lit(cut["rank"]).alias("rank"),
                F.lit(cut["h"]).cast("long").alias("h"),
                _literal(cut["id"], queued.schema["id"].dataType).alias("id"),
                F.lit(cut["size"]).cast("long").alias("size"),
                F.lit(cut["turn"]).alias("turn"),
            )
            fits = here <= there
        taken = taken + F.when((F.col("target") > 0) & fits, F.col("size")).otherwise(F.lit(0))
    return queued.select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken")
    )
