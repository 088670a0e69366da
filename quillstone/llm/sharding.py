"""K-d tree partitioning of rows into shards of near equal bytes.

A node that holds ``k`` shards is split for ``floor(k/2)`` and the rest along the
metadata dimension in which its rows are widest, at the weighted quantile that
gives each side its share of bytes.  Quantiles are found for all nodes of a
level at once from distributed histograms, which are refined around the quantile;
rows with one coordinate are split by a hash of their identity.  The coordinate of a
string is its rank among the distinct values of its column.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.unions import union
from quillstone.llm.workspace import join_keys, materialize, ranked

#: Bins of a histogram of one node; the bin that a quantile falls in is found where they are, and one row a node comes to the driver.
BINS = 8192
#: Parameters of nodes are broadcast up to this many (under 64 bytes a node); more are shuffled.
MAX_BROADCAST_NODES = 200_000
#: A split may miss its share by this part of the node's bytes, or by one row.
TOLERANCE = 1e-4
#: Rows that one window group numbers on average.
SLOT_ROWS = 2000
#: Levels after which the node of each row is written rather than computed anew.
LEVELS_A_TABLE = 4


def coordinate(column: Column, kind: T.DataType) -> Column:
    """An order-preserving number of a number, date or time; null lowest."""
    number = column.cast("timestamp").cast("double") if isinstance(kind, (T.DateType, T.TimestampType)) else column.cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(-1.7e308))


def _rank_strings(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """``rows`` with each column of ``names`` as the rank of its value, -1 for null."""
    for c in names:
        known = rows.filter(F.col(c).isNotNull())
        values, _ = ranked(known.groupBy(c).agg(F.count("*").alias("uses")), [c], "shard-values", "rank")
        there = join_keys(known, values.df, [c], "uses", n).drop("uses")
        rows = union(there, rows.filter(F.col(c).isNull()).withColumn("rank", F.lit(-1).cast("long")))
        rows = materialize(rows.withColumn(c, F.col("rank").cast("double")).drop("rank"), "shard-ranks")
    return rows


def _told(rows: DataFrame, params: list[tuple], schema: str) -> DataFrame:
    """``rows`` with the parameters of their nodes."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array([p[i] for p in params], kinds[kind]) for i, (_, kind) in enumerate(fields)]
    told = rows.sparkSession.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))
    return rows.join(F.broadcast(told) if len(params) <= MAX_BROADCAST_NODES else told, "node")


class _Node:
    def __init__(self, node: int, first: int, shards: int) -> None:
        self.node, self.first, self.shards = node, first, shards


def _quantiles(rows: DataFrame, value: str, want: dict[int, tuple[float, float]], span: dict[int, tuple[float, float]]):
    """For each node the boundary of ``value`` nearest to its wanted weight.

    ``rows``: node, size and ``value``; want: node -> (weight that goes left, tolerance);
    span: node -> (low, high).  Returns node -> (cut, left, tied, more): rows up to ``cut`` weigh ``left``;
    ``tied`` is the one value that the quantile falls in (or None), whose rows weigh ``more``.
    """
    active = {n: (lo, hi, 0.0) for n, (lo, hi) in span.items()}
    out: dict[int, tuple[float, float, float | None, float]] = {}
    v, lo, hi = F.col(value), F.col("lo"), F.col("hi")
    upto = F.col("base") + F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    hit = F.struct("bin", "w", "a", "b", "before")
    while active:
        params = [(n, float(x), float(y), float(base), float(want[n][0])) for n, (x, y, base) in active.items()]
        found = (
            _told(rows, params, "node long, lo double, hi double, base double, goal double")
            .filter((v >= lo) & (v <= hi))
            .withColumn("bin", F.coalesce(F.least(F.lit(BINS - 1), F.floor((v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)) * BINS)), F.lit(0)))
            .groupBy("node", "bin", "base", "goal")
            .agg(F.sum("size").alias("w"), F.min(value).alias("a"), F.max(value).alias("b"))
            .withColumn("upto", upto)
            .withColumn("before", F.col("upto") - F.col("w"))
            .groupBy("node")
            .agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("goal"), hit)), F.max(hit)).alias("r"))
            .select("node", "r.*")
            .collect()
        )
        for r in found:
            n, base = r["node"], r["before"]
            goal, slack = want[n]
            del active[n]
            if r["a"] == r["b"]:
                out[n] = (math.nextafter(r["a"], -math.inf), base, r["a"], r["w"])
            elif r["w"] <= slack:
                up = base + r["w"] - goal < goal - base
                out[n] = (r["b"], base + r["w"], None, 0.0) if up else (math.nextafter(r["a"], -math.inf), base, None, 0.0)
            else:
                active[n] = (r["a"], r["b"], base)
    return out


def shard_rows(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dims: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot.

    Give ``shards``, or ``target_bytes`` for as many shards as the bytes need.  A row's
    size is the UTF-8 bytes of its text plus 8; a null text has none and the CRC-32 of the empty text.
    Shards differ by about one row's bytes a level or ``TOLERANCE`` of them.  Slots number a
    shard's rows without gaps from 0.  Rows repeated in every column count as one place of the tree and
    go to one shard.  With fewer rows than shards some shards are empty; an empty table gives an empty result.

    The driver holds the tree: a few numbers a shard.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    text = F.coalesce(F.col(text_col), F.lit(""))
    strings = [i for i, c in enumerate(dims) if isinstance(kinds[c], T.StringType)]
    at = [F.col(c) if i in strings else coordinate(F.col(c), kinds[c]) for i, c in enumerate(dims)]
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[c.alias(f"at{i}") for i, c in enumerate(at)],
    ).withColumn("tie", (F.xxhash64("id", "crc", "size") / F.lit(2.0**63)))
    rows = materialize(rows, "shard-rows")
    rows = _rank_strings(rows, [f"at{i}" for i in strings], rows.count())
    rows = rows.select("id", "size", "crc", "tie", F.array(*[f"at{i}" for i in range(len(dims))]).alias("at"), F.lit(1).cast("long").alias("node"))
    k = range(len(dims))
    stats = lambda df: df.groupBy("node").agg(
        F.sum("size").alias("w"),
        *[f(F.col("at")[i]).alias(f"{n}{i}") for i in k for n, f in (("lo", F.min), ("hi", F.max))],
    ).collect()
    top = stats(rows)
    if shards is None:
        shards = max(1, math.ceil((top[0]["w"] if top else 0) / target_bytes))
    leaves: list[_Node] = []
    level = [_Node(1, 0, shards)]
    whole = {i: (top[0][f"hi{i}"] / 2 - top[0][f"lo{i}"] / 2) or 1.0 for i in k} if top else {}
    depth, counts = 0, top
    while level and counts:
        by = {r["node"]: r for r in counts}
        leaves += [x for x in level if x.shards == 1 or x.node not in by]
        level = [x for x in level if x.shards > 1 and x.node in by]
        if not level:
            break
        dim, want, span = {}, {}, {}
        for x in level:
            r = by[x.node]
            dim[x.node] = max(k, key=lambda i: ((r[f"hi{i}"] / 2 - r[f"lo{i}"] / 2) / whole[i], -i))
            want[x.node] = (r["w"] * (x.shards // 2) / x.shards, r["w"] * TOLERANCE)
            span[x.node] = (r[f"lo{dim[x.node]}"], r[f"hi{dim[x.node]}"])
        valued = _told(rows, [(n, d + 1) for n, d in dim.items()], "node long, dim int")
        valued = valued.select("node", "size", "tie", F.element_at("at", F.col("dim")).alias("v"))
        cuts = _quantiles(valued, "v", want, span)
        tied = {n: c for n, c in cuts.items() if c[2] is not None}
        ties: dict[int, float] = {}
        if tied:
            within = _told(valued, [(n, c[2]) for n, c in tied.items()], "node long, tied double").filter(F.col("v") == F.col("tied"))
            found = _quantiles(
                within.drop("tied"), "tie", {n: (want[n][0] - c[1], want[n][1]) for n, c in tied.items()}, {n: (-1.0, 1.0) for n in tied}
            )
            for n, (cut, left, one, more) in found.items():
                # The one row (or its repeats) in which the quantile falls goes left when that is nearer.
                goal = want[n][0] - tied[n][1]
                ties[n] = one if one is not None and left + more - goal < goal - left else cut
        # Nodes that are done pass through with no dimension.
        params = [(x.node, dim[x.node] + 1, float(cuts[x.node][0]), cuts[x.node][2], ties.get(x.node)) for x in level]
        params += [(x.node, None, None, None, None) for x in leaves if x.node in by]
        v = F.element_at("at", F.col("dim"))
        left = (v <= F.col("cut")) | F.coalesce((v == F.col("tied")) & (F.col("tie") <= F.col("tie_cut")), F.lit(False))
        rows = (
            _told(rows, params, "node long, dim int, cut double, tied double, tie_cut double")
            .withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(left, 0).otherwise(1)))
            .drop("dim", "cut", "tied", "tie_cut")
        )
        level = [
            y
            for x in level
            for y in (_Node(x.node * 2, x.first, x.shards // 2), _Node(x.node * 2 + 1, x.first + x.shards // 2, x.shards - x.shards // 2))
        ]
        depth += 1
        if depth % LEVELS_A_TABLE == 0:
            rows = materialize(rows, "shard-level")
        counts = stats(rows)
    leaves += level
    n = rows.count()
    groups = max(1, math.ceil(n / SLOT_ROWS / max(1, shards)))
    placed = _told(rows, [(x.node, x.first) for x in leaves], "node long, shard int").withColumn("part", F.floor((F.col("tie") + 1) / 2 * groups).cast("long"))
    placed = materialize(placed.select("id", "size", "crc", "tie", "shard", "part"), "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("shard", "part").orderBy("tie", "id", "size", "crc")
    return placed.join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("start") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )
