"""N-gram Jaccard join by chosen paths.

A set of five-word shingles is embedded as MinHash values at a number of positions.  A run
splits the sets on the values at a few sampled positions: sets that agree there share a
path, as two sets do with their Jaccard similarity at each.  Paths with many sets are
split again on positions sampled for the path; small ones are compared in full,
and so are those that splitting hardly takes apart.  Runs are repeated until a pair at the threshold is
met with the target probability.  Pairs that meet are verified on their whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.unions import union
from quillstone.llm.components import connected_components
from quillstone.llm.packed import cut_blocks, mix64
from quillstone.llm.shingles import shingle_sets
from quillstone.llm.workspace import join_keys, small_batches, write_table

#: Positions of a sketch; there are more (a power of two) when the runs sample more.
POSITIONS = 128
#: Sampled positions of a run at the root, and at every path that is split.
BRANCHES, DEEPER = 2, 3
#: A path with at most so many sets is compared in full.  Larger paths that are compared are dealt in chunks of this size, pair by pair.
LEAF = 1024
#: A path is compared as a whole when splitting it leaves more than this part of its sets together, or when it lies this deep.
STUCK, DEPTH = 0.5, 6
#: Standard deviations that the estimate of a pair at the threshold may fall below it.
SLACK = 5.5
#: Digests of texts to verify are broadcast up to this many (under 10 MB); more are shuffled.
MAX_BROADCAST_IDS = 100_000
#: Columns of a block of the incidence matrix.
COLUMNS = 1024

_PROBES: dict[int, list[np.ndarray]] = {}


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at ``threshold`` has met with probability ``recall``, however deep its paths are split."""
    met = threshold * (1 - (1 - threshold) ** DEEPER) ** (DEPTH - 1)
    return max(1, math.ceil(math.log(1 - recall) / (BRANCHES * math.log(1 - met))))


def positions_for(runs: int) -> int:
    """Positions of a sketch from which the runs can sample different ones at the root."""
    return max(POSITIONS, 1 << (runs * BRANCHES - 1).bit_length())


def _probe(k: int, positions: int) -> np.ndarray:
    """The k-th bin that each empty bin tries."""
    found = _PROBES.setdefault(positions, [])
    while len(found) <= k:
        seed = np.arange(positions, dtype=np.uint64) + np.uint64(len(found) * positions + 1)
        found.append((mix64(seed) % np.uint64(positions)).astype(np.int64))
    return found[k]


def embed(hashes: np.ndarray, offsets: np.ndarray, positions: int) -> np.ndarray:
    """MinHash values (texts x positions, 32 bits) by one permutation with optimal densification."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    place = owner * positions + (hashes >> np.uint64(65 - positions.bit_length())).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # ascending within a text, so that a bin's first is its minimum
    values = np.zeros(n * positions, np.uint32)
    full = np.zeros(n * positions, bool)
    values[place[first]] = hashes[first].astype(np.uint32)
    full[place[first]] = True
    values, full = values.reshape(n, positions), full.reshape(n, positions)
    row, bin_ = np.nonzero(~full & (np.diff(offsets) > 0)[:, None])
    out, k = values.copy(), 0
    while len(row):
        tried = _probe(k, positions)[bin_]
        hit = full[row, tried]
        out[row[hit], bin_[hit]] = values[row[hit], tried[hit]]
        row, bin_, k = row[~hit], bin_[~hit], k + 1
    return out


def _sketch(positions: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cut_blocks(batches, "text"):
            texts = table["text"].combine_chunks()
            hashes, offsets = shingle_sets(texts)
            values = embed(hashes, offsets, positions)
            n = table.num_rows
            data = memoryview(hashes).cast("B")
            digests = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            names = [hashlib.sha256(x.as_buffer()).digest() if x.is_valid else None for x in texts]
            low = (values & np.uint32(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks(), pa.array(names, pa.binary()), pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * positions), pa.array(values.view(np.int32).ravel())),
                    pa.array([low[i * positions : (i + 1) * positions] for i in range(n)], pa.binary()),
                ],
                names=["id", "sha", "n", "digest", "sketch", "low"],
            )

    return sketch


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups (rows sorted by path, lo, hi), with the groups' starts and ends."""
    held: pa.Table | None = None

    def keys(t: pa.Table) -> np.ndarray:
        return np.column_stack([t[c].to_numpy().astype(np.int64) for c in ("path", "lo", "hi")])

    def cut(t: pa.Table):
        k = keys(t)
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        return starts, np.concatenate((starts[1:], [len(k)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        starts, ends = cut(held)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1], ends[:-1]
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, *cut(held)


def _pairs(path: np.ndarray, chunk: np.ndarray, lo: np.ndarray, hi: np.ndarray, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups, some ten thousand at a time; groups of two chunks give pairs across them only."""
    size = ends - starts
    small = size <= 48
    owner = np.repeat(np.arange(len(starts)), size)
    index = np.flatnonzero(small[owner]) if len(owner) else np.zeros(0, np.int64)
    for d in range(1, int(size[small].max(initial=0))):
        i = index[: len(index) - d] if d < len(index) else index[:0]
        j = i + d
        ok = j < len(owner)
        i, j = i[ok], j[ok]
        same = owner[i] == owner[j]
        i, j = i[same], j[same]
        cross = (lo[i] == hi[i]) | (chunk[i] != chunk[j])
        i, j = i[cross], j[cross]
        for a in range(0, len(i), 20_000):
            yield i[a : a + 20_000], j[a : a + 20_000]
    for s, e in zip(starts[~small], ends[~small], strict=True):
        rows = np.arange(s, e)
        step = max(1, 20_000 // len(rows))
        for a in range(0, len(rows), step):
            i, j = np.meshgrid(rows[a : a + step], rows, indexing="ij")
            i, j = i.ravel(), j.ravel()
            ok = (i < j) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j]))
            yield i[ok], j[ok]


def _met_before(lists: np.ndarray, path: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two sets share a path smaller than the one at hand, where the pair counts instead."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 5_000):
        x, y = lists[i[a : a + 5_000]], lists[j[a : a + 5_000]]
        both = (x[:, :, None] == y[:, None, :]) & (x < path[i[a : a + 5_000]][:, None])[:, :, None]
        out[a : a + 5_000] = both.any(axis=(1, 2))
    return out


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of paths as a matrix; the padding is larger than any path at hand, so that it never counts."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.iinfo(np.int64).max)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _meet(threshold: float, positions: int):
    schema = pa.schema([("path", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("rid", pa.int64())])

    def meet(batches):
        for t, starts, ends in _groups(batches):
            path, lo, hi, chunk, n = (t[c].to_numpy().astype(np.int64) for c in ("path", "lo", "hi", "chunk", "n"))
            lists = _padded(t["paths"])
            low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(-1, positions)
            chosen = np.zeros(len(path), bool)
            for i, j in _pairs(path, chunk, lo, hi, starts, ends):
                smaller, larger = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                near = smaller >= threshold * larger - 1e-9
                i, j, smaller = i[near], j[near], smaller[near]
                least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(smaller, positions))
                near = (low[i] == low[j]).sum(axis=1) >= least * positions
                i, j = i[near], j[near]
                new = ~_met_before(lists, path, i, j)
                chosen[i[new]] = True
                chosen[j[new]] = True
            if chosen.any():
                rows = t.filter(pa.array(chosen))
                yield pa.RecordBatch.from_arrays([rows[c].combine_chunks().cast(schema.field(c).type) for c in schema.names], schema=schema)

    return meet, "path long, lo int, hi int, rid long"


def _intersections(hashes: np.ndarray, offsets: np.ndarray, s: int, e: int) -> np.ndarray:
    """Sizes of the intersections of all sets s..e, from blocks of the incidence matrix."""
    part = hashes[offsets[s] : offsets[e]]
    owner = np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1]))
    _, code, counts = np.unique(part, return_inverse=True, return_counts=True)
    shared = counts[code] > 1
    code, owner = code[shared], owner[shared]
    kinds, code = np.unique(code, return_inverse=True)
    out = np.zeros((e - s, e - s), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, len(kinds), COLUMNS):
        b, c = np.searchsorted(code, [a, a + COLUMNS])
        block = np.zeros((e - s, COLUMNS), np.float32)
        block[owner[b:c], code[b:c] - a] = 1
        out += block @ block.T
    return out


def _verify(threshold: float):
    schema = pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("others", pa.int64())])

    def verify(batches):
        for t, starts, ends in _groups(batches):
            path, lo, hi, chunk, copies, rid = (t[c].to_numpy().astype(np.int64) for c in ("path", "lo", "hi", "chunk", "copies", "rid"))
            lists = _padded(t["paths"])
            hashes, offsets = shingle_sets(t["text"].combine_chunks())
            size = np.diff(offsets)
            links, others = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
            root = rid.copy()
            for s, e in zip(starts, ends, strict=True):
                if e - s <= 48:
                    i, j = np.triu_indices(e - s, 1)
                    i, j = i + s, j + s
                    ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
                    i, j = i[ok], j[ok]
                    common = np.array(
                        [len(np.intersect1d(hashes[offsets[a] : offsets[a + 1]], hashes[offsets[b] : offsets[b + 1]], assume_unique=True)) for a, b in zip(i, j, strict=True)],
                        np.int64,
                    )
                else:
                    inter = _intersections(hashes, offsets, s, e).astype(np.int32)
                    union = size[s:e, None].astype(np.int32) + size[None, s:e].astype(np.int32) - inter
                    i, j = np.nonzero(np.triu(inter >= threshold * union - 1e-9, 1))
                    common = inter[i, j].astype(np.int64)
                    i, j = i + s, j + s
                    del inter, union
                ok = (common >= threshold * (size[i] + size[j] - common) - 1e-9) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j]))
                i, j = i[ok], j[ok]
                new = ~_met_before(lists, path, i, j)
                i, j = i[new], j[new]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                np.add.at(others, i, 1)
                np.add.at(others, j, 1)
                while len(i):
                    least = np.minimum(root[i], root[j])
                    if (root[i] == least).all() and (root[j] == least).all():
                        break
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
            has = others > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (rid, root, links, others)], schema=schema)

    return verify, "rid long, root long, links long, others long"


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    recall: float = 0.999999,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, copy_id, n_links, n_texts.

    Two rows are linked when their sets of five-word shingles have a Jaccard similarity of ``threshold`` or more.
    ``class_id`` is the smallest id of the rows that links connect, ``copy_id`` the smallest of the
    rows with the same set, ``n_links`` the number of other rows linked to this one, copies included,
    and ``n_texts`` the number of other sets linked to its set.  A row without links is a class of its own.

    Words are runs of anything but ASCII white space.  Rows without words are copies of each other and linked to no
    others.  A text of one to four words has one shingle.  Repeated rows are copies; a null id gives way to any other.
    An empty table gives an empty result.

    Copies are joined as one set with a count.  A pair of sets that meets on several paths counts on the smallest only, so counts are
    added up where pairs meet, and pairs are never written out.

    A set goes by its digest (128 bits) and by a number that is written once; the text to verify it with is any of its rows', found
    by the SHA-256 of the text.  So nothing rests on the order or the split of the input, which is read twice.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ddl = source.schema["id"].dataType.simpleString()
    runs = runs_for(recall, threshold)
    positions = positions_for(runs)
    sketches = write_table(source.mapInArrow(_sketch(positions), f"id {ddl}, sha binary, n long, digest binary, sketch array<int>, low binary"), "join-sets")
    # One row a set; all rows of a set have the same sketch, and the least hash names the text that stands for it.
    total = sketches.df.count()
    reps = write_table(
        sketches.df.groupBy("digest").agg(
            F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.min("sha").alias("sha"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            F.first("low").alias("low"),
        ).withColumn("rid", F.monotonically_increasing_id()),
        "join-reps",
        rows=total,
    )
    ids_of = write_table(sketches.df.select("id", "digest"), "join-ids", rows=total)
    sketches.drop()
    spent, places = [], total * runs * BRANCHES
    order = np.argsort(mix64(np.arange(positions, dtype=np.uint64) + np.uint64(1 << 32))).tolist()
    root = F.array(*[F.xxhash64(F.lit(p), F.get("sketch", F.lit(p))) for p in order[: runs * BRANCHES]])
    real = reps.df.filter("n > 0")
    level = real.select("rid", F.explode(root).alias("path"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("parent"))
    h = lambda seed: F.xxhash64("rid", F.lit(seed)).cast("decimal(38,0)")
    # Two sums of hashes tell the paths apart that hold different sets.
    stats_of = lambda df: df.groupBy("path").agg(
        F.count("*").alias("m"), F.max("above").alias("above"), F.max("parent").alias("parent"), F.sum(h(1)).alias("s1"), F.sum(h(2)).alias("s2")
    ).filter("m > 1")
    levels, leaves, split, depth = [], [], None, 1
    while True:
        found = write_table(stats_of(level), f"paths-{depth}", rows=places)
        spent.append(found)
        levels.append(level.select("rid", "path"))
        stats = found.df
        if split is not None:
            # Where a part holds most of the path above, that path is compared instead of its parts, which repeat its pairs.
            stuck = stats.filter(F.col("m") > STUCK * F.col("above")).select("parent").distinct()
            leaves.append(split.join(stuck.withColumnRenamed("parent", "path"), "path", "left_semi"))
            stats = stats.join(stuck, "parent", "left_anti")
        whole = (F.col("m") <= LEAF) | F.lit(depth >= DEPTH)
        leaves.append(stats.filter(whole).select("path", "m", "s1", "s2"))
        big = write_table(stats.filter(~whole).select("path", "m", "s1", "s2"), f"split-{depth}", rows=places // LEAF)
        spent.append(big)
        split = big.df
        if not split.limit(1).count():
            break
        here = level.select("rid", "path").join(split.select("path", F.col("m").alias("above")), "path").join(real.select("rid", "sketch"), "rid")
        position = lambda k: F.pmod(F.xxhash64("path", F.lit(k)), F.lit(positions)).cast("int")
        below = F.array_distinct(F.array(*[F.xxhash64("path", position(k), F.get("sketch", position(k))) for k in range(DEEPER)]))
        deeper = write_table(here.select("rid", "above", F.col("path").alias("parent"), F.explode(below).alias("path")), f"level-{depth}", rows=places * DEEPER)
        spent.append(deeper)
        level = deeper.df
        depth += 1
    leaves = union(*leaves)
    kept = write_table(leaves.groupBy("m", "s1", "s2").agg(F.min("path").alias("path")).select("path", "m"), "join-leaves", rows=places)
    members = write_table(union(*levels).join(kept.df, "path"), "join-members", rows=places)
    lists = members.df.groupBy("rid").agg(F.collect_set(F.struct("path", "m")).alias("at"))
    lists = write_table(
        lists.select("rid", "at", F.sort_array("at.path").alias("paths")).join(reps.df.select("rid", "n", "copies", "low", "sha"), "rid"), "join-lists", rows=total
    )
    sets = write_table(reps.df.select("digest", "rid", "copies", "copy_id"), "join-distinct", rows=total)
    for t in [*spent, kept, members, reps]:
        t.drop()
    chunks = F.ceil(F.col("one.m") / LEAF).cast("int")
    dealt = (
        lists.df.select("rid", "n", "low", "paths", F.explode("at").alias("one"))
        .withColumn("chunk", F.pmod(F.xxhash64("rid", "one.path"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("rid", "n", "low", "paths", "chunk", F.col("one.path").alias("path"), F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    )
    place = ["path", "lo", "hi"]
    meet, met_ddl = _meet(threshold, positions)
    met = write_table(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(meet, met_ddl), "join-met")

    wanted = lists.df.select("rid", "sha").join(met.df.select("rid").distinct(), "rid", "left_semi")
    wanted = write_table(wanted, "join-wanted", rows=total)
    ids = wanted.df
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    # Rows of one text are one after the partial aggregate, so copies don't travel.
    texts = source.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).join(ids, "sha").groupBy("rid").agg(F.first("text").alias("text"))
    whole = lists.df.select("rid", "copies", "paths", F.transform("at", lambda x: x.path).alias("p"), F.transform("at", lambda x: x.m).alias("m"))
    chunks = F.ceil(F.element_at("m", F.array_position("p", F.col("path")).cast("int")) / LEAF).cast("int")
    to_verify = (
        met.df.join(whole, "rid")
        .withColumn("chunk", F.pmod(F.xxhash64("rid", "path"), chunks).cast("int"))
        .drop("p", "m")
        .join(texts, "rid")
    )
    verify, verified_ddl = _verify(threshold)
    found = write_table(to_verify.repartition(*place).sortWithinPartitions(*place).mapInArrow(verify, verified_ddl), "join-links")
    links = found.df.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    roots = connected_components(found.df.select(F.col("rid").alias("a"), F.col("root").alias("b")))

    # Smallest ids by set and by class; a set has one row here, a class as many as it has different sets.
    info = (
        sets.df.join(links, "rid", "left")
        .join(roots.df.withColumnRenamed("node", "rid"), "rid", "left")
        .select(
            "digest", "copies", "copy_id", F.coalesce("root", "rid").alias("root"),
            F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("others", F.lit(0)).alias("n_texts"),
        )
    )
    info = write_table(info, "join-info", rows=total)
    for t in (lists, met, wanted, found, roots, sets):
        t.drop()
    classes = write_table(info.df.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("sets")), "join-classes", rows=total)
    per_set = write_table(join_keys(info.df, classes.df, ["root"], "sets", info.df.count()).drop("root", "sets"), "join-per-set", rows=total)
    for t in (info, classes):
        t.drop()
    return join_keys(ids_of.df, per_set.df, ["digest"], "copies", total).select(
        F.col("id").alias(id_col), "class_id", "copy_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("n_texts").cast("long").alias("n_texts")
    )
