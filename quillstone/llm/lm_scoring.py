"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

The model is p(w|u) = l2 c(u,w)/c(u) + l1 c(w)/N + l0/(V+1) with weights l that depend
on the bucket of c(u).  The weights are learned by expectation-maximisation on the
counts of a held-out fold of the training documents, against the counts of the
other folds; scoring then uses the counts of all training documents.  EM begins on cells of
similar held-out events, on the driver, and ends with rounds over all held-out events where they lie.

Words and word pairs are counted by packed exchanges (see ``packed``): blocks of
documents send each distinct word, then each distinct pair, once, and get its counts
over the whole corpus back.  Counts are exact; words and pairs are compared in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.functions.unions import union
from quillstone.llm.packed import (
    block_number,
    by_hash,
    cut_blocks,
    mix64,
    pack,
    pack_words,
    ranges,
    stretches,
    unpack,
    unpack_words,
    word_hashes,
)
from quillstone.llm.workspace import small_batches, write_table

#: Distinct words, and distinct pairs, that one group of an exchange gets on average.
GROUP_WORDS, GROUP_PAIRS = 400_000, 800_000
#: Fewest groups of an exchange.
LEAST_GROUPS = 24
#: Lower bounds of the buckets of context counts.
BUCKETS = np.array([0, 1, 2, 4, 8, 16, 64, 256, 1024, 16384])
#: Cells of held-out events: buckets times steps of half an octave of either estimate.
STEPS = 64
EM_ROUNDS = 100
#: Rounds over all held-out events at most, and the change of a weight below which they end.
EXACT_ROUNDS, STILL = 8, 1e-4

TEST, TRAIN, HELD = 0, 1, 2


@dataclass(frozen=True)
class Model:
    """Mixture weights by bucket (rows: l0, l1, l2), N and V of the training tokens.

    ``held_out`` has the mean log10 probability of a held-out token before each round over all events; the first is that of the cells' weights.
    """

    weights: np.ndarray
    tokens: int
    types: int
    held_out: tuple[float, ...] = ()


def tokenize(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, token codes, tokens a text); a text's last token is the end, the empty word.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    encoded = flat.filter(real).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.bincount(parents.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts)) + 1
    words = pa.concat_arrays([encoded.dictionary.cast(pa.large_string()), pa.array([""], pa.large_string())])
    out = np.full(int(lengths.sum()), len(words) - 1, np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = codes
    return words, out, lengths


def _blocks(batches):
    for seq, table in enumerate(cut_blocks(batches, "text")):
        kinds = table["kind"].to_numpy().astype(np.int64)
        words, tokens, lengths = tokenize(table["text"].combine_chunks())
        words, place = by_hash(words)
        tokens = place[tokens]
        kind = np.repeat(kinds, lengths)
        n = len(words)
        names, content = pack_words(words)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "block": block_number(seq),
                    "ids": table["id"].to_pylist(),
                    "kinds": pack(kinds),
                    "lengths": pack(lengths),
                    "tokens": pack(tokens),
                    "names": names,
                    "content": content,
                    "train": pack(np.bincount(tokens[kind != TEST], minlength=n)),
                    "other": pack(np.bincount(tokens[kind == TRAIN], minlength=n)),
                    "n_words": n,
                    "n_tokens": len(tokens),
                    "n_train": int((kind != TEST).sum()),
                    "n_other": int((kind == TRAIN).sum()),
                }
            ],
            schema=pa.schema(
                [
                    ("block", pa.int64()),
                    ("ids", pa.list_(table.schema.field("id").type)),
                    *[(c, pa.binary()) for c in ("kinds", "lengths", "tokens", "names", "content", "train", "other")],
                    *[(c, pa.int64()) for c in ("n_words", "n_tokens", "n_train", "n_other")],
                ]
            ),
        )


def _send_words(parts: int):
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["names"], row["content"])
                train, other = unpack(row["train"]), unpack(row["other"])
                rows = []
                for p, a, b in stretches(ranges(word_hashes(words), parts)):
                    names, content = pack_words(words.slice(a, b - a))
                    rows.append({"p": p, "block": row["block"], "names": names, "content": content, "train": pack(train[a:b]), "other": pack(other[a:b])})
                yield pa.RecordBatch.from_pylist(
                    rows,
                    schema=pa.schema([("p", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("names", "content", "train", "other")]]),
                )

    return send


_RETURN = pa.schema([("block", pa.int64()), ("p", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("a", "b", "c")], ("n", pa.int64())])
_RETURN_DDL = "block long, p int, kind int, a binary, b binary, c binary, n long"


def _count_words(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    words = [unpack_words(r["names"], r["content"]) for r in rows]
    encoded = pa.concat_arrays(words).dictionary_encode()
    code = encoded.indices.to_numpy(zero_copy_only=False)
    n = len(encoded.dictionary)
    total = lambda c: np.bincount(code, np.concatenate([unpack(r[c]) for r in rows]), n).astype(np.int64)
    train, other = total("train"), total("other")
    out, at = [], 0
    for r, w in zip(rows, words, strict=True):
        own = code[at : at + len(w)]
        at += len(w)
        out.append({"block": r["block"], "p": r["p"], "kind": 0, "a": pack(own), "b": pack(train[own]), "c": pack(other[own]), "n": 0})
    out.append({"block": -1, "p": rows[0]["p"], "kind": 0, "a": b"", "b": b"", "c": b"", "n": int((train > 0).sum())})
    return pa.Table.from_pylist(out, schema=_RETURN)


class _Block:
    """A block with the corpus counts of its words, and its distinct pairs in hash order."""

    def __init__(self, row: dict, words: list[dict]) -> None:
        words.sort(key=lambda r: r["p"])
        gids = np.concatenate([(r["p"] << 32) + unpack(r["a"]) for r in words])
        self.train = np.concatenate([unpack(r["b"]) for r in words])
        self.other = np.concatenate([unpack(r["c"]) for r in words])
        self.lengths, tokens = unpack(row["lengths"]), unpack(row["tokens"])
        self.kind = np.repeat(unpack(row["kinds"]), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = tokens
        end = tokens[self.starts[0] + self.lengths[0] - 1]
        self.context = np.concatenate(([end], tokens[:-1]))  # each text's last token is the end, which begins the next
        pairs, self.pair = np.unique(self.context * len(gids) + tokens, return_inverse=True)
        u, v = pairs // len(gids), pairs % len(gids)
        hashes = mix64(mix64(gids[u].astype(np.uint64)) ^ gids[v].astype(np.uint64))
        order = np.argsort(hashes, kind="stable")
        self.order, self.hashes = order, hashes[order]
        self.u, self.v, self.gu, self.gv = u[order], v[order], gids[u][order], gids[v][order]


def _send_pairs(parts: int):
    columns = ("u", "v", "train", "other", "held", "cu", "cw")
    schema = pa.schema([("p", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in columns]])

    def send(blocks: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            x = _Block(row, words.to_pylist())
            count = lambda k: np.bincount(x.pair[x.kind == k], minlength=len(x.order))[x.order]
            other, held = count(TRAIN), count(HELD)
            for p, a, b in stretches(ranges(x.hashes, parts)):
                # Within a range the pairs go in order of their words, which packs well; the block puts them back.
                own = a + np.lexsort((x.gv[a:b], x.gu[a:b]))
                with_held = own[held[own] > 0]
                out.append(
                    {
                        "p": p,
                        "block": row["block"],
                        "u": pack(np.diff(x.gu[own], prepend=0)),
                        "v": pack(x.gv[own]),
                        "train": pack(other[own] + held[own]),
                        "other": pack(other[own]),
                        "held": pack(held[own]),
                        "cu": pack(x.other[x.u[with_held]]),
                        "cw": pack(x.other[x.v[with_held]]),
                    }
                )
        return pa.Table.from_pylist(out, schema=schema)

    return send, "p int, block long, " + ", ".join(f"{c} binary" for c in columns)


def _cells(c2, cu, cw, weight, tokens: int) -> np.ndarray:
    """Rows (cell, weight, weight * f2, weight * f1) of held-out events."""
    f2 = np.where(cu > 0, c2 / np.maximum(cu, 1), 0.0)
    f1 = cw / max(tokens, 1)
    step = lambda f: np.where(f > 0, np.clip(1 + np.floor(-2 * np.log2(np.maximum(f, 1e-300))), 1, STEPS - 1), 0).astype(np.int64)
    cell = (np.searchsorted(BUCKETS, cu, "right") - 1) * STEPS * STEPS + step(f2) * STEPS + step(f1)
    kinds, at = np.unique(cell, return_inverse=True)
    return np.column_stack([kinds, *[np.bincount(at, w, len(kinds)) for w in (weight, weight * f2, weight * f1)]])


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _frames(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _events(c2, cu, cw, weight) -> bytes:
    """Held-out events by their counts, equal ones as one with their weight."""
    kinds, at = np.unique(np.column_stack([cu, cw, c2]), axis=0, return_inverse=True)
    return _framed([pack(x) for x in (*kinds.T, np.bincount(at.ravel(), weight, len(kinds)).astype(np.int64))])


def _expect(weights: np.ndarray, types: int, n_other: int):
    """One E step over all events: by bucket the events' number, their shares of the three estimates, and their log10 probability."""

    def expect(batches):
        for batch in batches:
            sums = np.zeros((len(BUCKETS), 5))
            for data in batch.column(0).to_pylist():
                cu, cw, c2, weight = map(unpack, _frames(data))
                bucket = np.searchsorted(BUCKETS, cu, "right") - 1
                f = np.column_stack([np.full(len(cu), 1.0 / (types + 1)), cw / max(n_other, 1), np.where(cu > 0, c2 / np.maximum(cu, 1), 0.0)])
                share = f * weights[bucket]
                whole = share.sum(axis=1)
                for k in range(3):
                    sums[:, 1 + k] += np.bincount(bucket, weight * share[:, k] / whole, len(BUCKETS))
                sums[:, 0] += np.bincount(bucket, weight, len(BUCKETS))
                sums[:, 4] += np.bincount(bucket, weight * np.log10(whole), len(BUCKETS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(BUCKETS))), *[pa.array(sums[:, k]) for k in range(5)]], names=["bucket", *_SUMS])

    return expect


_SUMS = ("w", "s0", "s1", "s2", "log")


def refine_weights(events: DataFrame, weights: np.ndarray, types: int, n_other: int) -> tuple[np.ndarray, tuple[float, ...]]:
    """EM over all held-out events (a column of packed ones) from ``weights``; buckets without events keep theirs."""
    seen = []
    for _ in range(EXACT_ROUNDS):
        found = events.mapInArrow(_expect(weights, types, n_other), "bucket long, " + ", ".join(f"{c} double" for c in _SUMS))
        sums = np.array(sorted(map(tuple, found.groupBy("bucket").agg(*[F.sum(c) for c in _SUMS]).collect())))
        if not len(sums) or not sums[:, 1].sum():
            break
        seen.append(float(sums[:, 5].sum() / sums[:, 1].sum()))
        better = weights.copy()
        for bucket, w, *shares, _ in sums:
            if w:
                better[int(bucket)] = _floored(np.array(shares) / w)
        still = np.abs(better - weights).max() < STILL
        weights = better
        if still:
            break
    return weights, tuple(seen)


def _floored(mix: np.ndarray) -> np.ndarray:
    """Weights that leave no word without probability."""
    out = np.maximum(mix, [1e-6, 1e-9, 0.0])
    return out / out.sum()


def _open_cells(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            cells = np.frombuffer(data, "<f8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, i]) for i in range(4)], names=["cell", "w", "f2", "f1"])


def _count_pairs(n_other: int):
    def count(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        u = np.concatenate([np.cumsum(unpack(r["u"])) for r in rows])
        v = np.concatenate([unpack(r["v"]) for r in rows])
        sizes = [len(unpack(r["train"])) for r in rows]
        order = np.lexsort((v, u))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        total = lambda c: np.bincount(code, np.concatenate([unpack(r[c]) for r in rows])).astype(np.int64)
        train, other = total("train"), total("other")
        held = np.concatenate([unpack(r["held"]) for r in rows])
        with_held = held > 0
        seen = [other[code[with_held]], *[np.concatenate([unpack(r[c]) for r in rows]) for c in ("cu", "cw")], held[with_held]]
        cells = _cells(*seen, n_other)
        ends = np.cumsum(sizes)
        out = [
            {"block": r["block"], "p": r["p"], "kind": 1, "a": pack(train[code[e - n : e]]), "b": b"", "c": b"", "n": 0}
            for r, n, e in zip(rows, sizes, ends, strict=True)
        ]
        out.append({"block": -1, "p": rows[0]["p"], "kind": 1, "a": cells.astype("<f8").tobytes(), "b": _events(*seen), "c": b"", "n": 0})
        return pa.Table.from_pylist(out, schema=_RETURN)

    return count


def fit_weights(cells: np.ndarray, types: int) -> np.ndarray:
    """Mixture weights by bucket from cells (cell, weight, weight * f2, weight * f1), by EM.

    Buckets without held-out events take the weights of the next lower bucket that has some.
    """
    out = np.zeros((len(BUCKETS), 3))
    last = np.array([0.5, 0.5, 0.0])
    bucket = (cells[:, 0] // (STEPS * STEPS)).astype(int) if len(cells) else np.zeros(0, int)
    for k in range(len(BUCKETS)):
        own = cells[bucket == k]
        if len(own) and own[:, 1].sum() > 0:
            weight = own[:, 1]
            f = np.column_stack([np.full(len(own), 1.0 / (types + 1)), own[:, 3] / weight, own[:, 2] / weight])
            mix = np.array([1 / 3, 1 / 3, 1 / 3]) if k else np.array([0.5, 0.5, 0.0])
            for _ in range(EM_ROUNDS):
                share = f * mix
                mix = (weight[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / weight.sum()
            last = _floored(mix)
        out[k] = last
    return out


def _score(model_of: dict, id_type: pa.DataType):
    model = Model(np.array(model_of["weights"]), model_of["tokens"], model_of["types"])

    def score(blocks: pa.Table, returned: pa.Table) -> pa.Table:
        out = {c: [] for c in ("id", "n_tokens", "n_known", "base", "score")}
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            parts = returned.to_pylist()
            x = _Block(row, [r for r in parts if r["kind"] == 0])
            both = np.empty(len(x.order), np.int64)
            at = 0
            for r in sorted((r for r in parts if r["kind"] == 1), key=lambda r: r["p"]):
                counts = unpack(r["a"])
                stretch = slice(at, at + len(counts))
                both[x.order[at + np.lexsort((x.gv[stretch], x.gu[stretch]))]] = counts
                at += len(counts)
            c2, cu, cw = both[x.pair], x.train[x.context], x.train[x.word]
            mix = model.weights[np.searchsorted(BUCKETS, cu, "right") - 1]
            p = mix[:, 0] / (model.types + 1) + mix[:, 1] * cw / max(model.tokens, 1) + mix[:, 2] * c2 / np.maximum(cu, 1)
            total = lambda values: np.add.reduceat(values, x.starts)
            out = {
                "id": row["ids"],
                "n_tokens": x.lengths,
                "n_known": total((cw > 0).astype(np.int64)),
                "base": total(np.log10((cw + 1) / (model.tokens + model.types + 1))),
                "score": total(np.log10(p)),
            }
        return pa.table(
            [
                pa.array(out["id"], id_type),
                *[pa.array(np.asarray(out[c], np.int64)) for c in ("n_tokens", "n_known")],
                *[pa.array(np.asarray(out[c], np.float64)) for c in ("base", "score")],
            ],
            names=list(out),
        )

    return score


def score_texts(
    docs: DataFrame,
    kind: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, Model]:
    """Learn a model from part of ``docs`` and score every text.

    ``kind`` says what a row is for: 0 scored only, 1 training, 2 training and held out while
    the mixture weights are learned.  Returns (rows of id, n_tokens, n_known, base, score) and the
    model.  ``score`` is the log10 probability of a text's words and end, ``base`` that of
    the add-one unigram model (c+1)/(N+V+1), ``n_known`` counts tokens seen in training.

    A null text is the empty one, which has one token, its end.  Repeated rows count and
    are scored once each.  With no training row every text gets the uniform estimate.
    An empty table gives an empty result.

    Only N, V, cells of held-out events (at most buckets * STEPS * STEPS) and sums by bucket come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), kind.cast("int").alias("kind"))
    id_ddl = rows.schema["id"].dataType.simpleString()
    binary = lambda *names: ", ".join(f"{c} binary" for c in names)
    blocks = write_table(
        rows.mapInArrow(
            _blocks,
            f"block long, ids array<{id_ddl}>, {binary('kinds', 'lengths', 'tokens', 'names', 'content', 'train', 'other')}, "
            "n_words long, n_tokens long, n_train long, n_other long",
        ),
        "lm-blocks",
    )
    sums = blocks.df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_train", "n_other")]).first()
    groups = lambda n, size: max(LEAST_GROUPS, math.ceil(n / size))
    sent = blocks.df.select("block", "names", "content", "train", "other").mapInArrow(
        _send_words(groups(sums["n_words"], GROUP_WORDS)), f"p int, block long, {binary('names', 'content', 'train', 'other')}"
    )
    words = write_table(sent.groupBy("p").applyInArrow(_count_words, _RETURN_DDL), "lm-words")
    types = words.df.filter("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    plain = blocks.df.select("block", "ids", "kinds", "lengths", "tokens")
    send, ddl = _send_pairs(groups(sums["n_tokens"], GROUP_PAIRS))
    back = words.df.filter("block >= 0")
    pairs = write_table(
        plain.drop("ids").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(send, ddl)
        .groupBy("p").applyInArrow(_count_pairs(int(sums["n_other"])), _RETURN_DDL),
        "lm-pairs",
    )
    gathered = (
        pairs.df.filter("block = -1").select("a").mapInArrow(_open_cells, "cell double, w double, f2 double, f1 double")
        .groupBy("cell").agg(F.sum("w"), F.sum("f2"), F.sum("f1")).collect()
    )
    cells = np.array(sorted(map(tuple, gathered))).reshape(-1, 4)
    events = pairs.df.filter("block = -1").select("b")
    weights, held_out = refine_weights(events, fit_weights(cells, types), int(types), int(sums["n_other"]))
    model = Model(weights, int(sums["n_train"]), int(types), held_out)
    told = {"weights": model.weights.tolist(), "tokens": model.tokens, "types": model.types}
    id_type = to_arrow_type(rows.schema["id"].dataType)
    scored = (
        plain.groupBy("block")
        .cogroup(union(back, pairs.df.filter("block >= 0")).groupBy("block"))
        .applyInArrow(_score(told, id_type), f"id {id_ddl}, n_tokens long, n_known long, base double, score double")
    )
    return scored.withColumnRenamed("id", id_col), model

