"""Byte-level BPE: every distinct pre-token of the corpus is encoded once.

Blocks of documents split their texts into pre-tokens and keep the sequence of
positions; their distinct pre-tokens are exchanged by hash range (see ``packed``),
each is encoded where it meets its copies, and the ids go back to the blocks, which put
the texts together by position.  Decoding joins ids with the table of token bytes, whose
size the vocabulary fixes.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.llm.packed import (
    block_number,
    by_hash,
    cut_blocks,
    pack,
    pack_words,
    ranges,
    stretches,
    unpack,
    unpack_words,
    word_hashes,
)
from quillstone.llm.workspace import small_batches, write_bucketed

#: Distinct pre-tokens that one group of the exchange gets on average, and the fewest groups.
GROUP_WORDS, LEAST_GROUPS = 150_000, 24
#: Text bytes of a block, pre-tokens held as Python strings, and ids decoded at a time.
TEXT_BYTES, PIECES, SLICE_IDS = 4 << 20, 50_000, 250_000

#: A pattern that takes any text as one pre-token.
WHOLE = "(?s:.+)"

_ENCODERS: dict[str, object] = {}
_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


class Vocabulary:
    """A rank file (``base64 rank`` lines) and the pattern of pre-tokens, sent to executors once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            data = f.read()
        self.key = hashlib.sha256(data + pattern.encode()).hexdigest()
        self.pattern = pattern
        self._data = spark.sparkContext.broadcast(data)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self._data.value.splitlines())}

    def encoder(self):
        """The merge machine, one a process; to it a text is one pre-token."""
        if self.key not in _ENCODERS:
            import tiktoken

            _ENCODERS[self.key] = tiktoken.Encoding(self.key[:8], pat_str=WHOLE, mergeable_ranks=self.ranks(), special_tokens={})
        return _ENCODERS[self.key]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte table: where each id's bytes start (one more entry than ids), and all bytes."""
        if self.key not in _TABLES:
            by_id = {b: a for a, b in self.ranks().items()}
            pieces = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
            starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
            _TABLES[self.key] = starts, np.frombuffer(b"".join(pieces), np.uint8)
        return _TABLES[self.key]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)


def by_use(uses: np.ndarray) -> np.ndarray:
    """Words in order of falling use; sequences of such ranks pack well."""
    return np.argsort(-uses, kind="stable")


def _blocks(pattern: str):
    def cut(batches):
        import regex

        find = regex.compile(pattern).findall
        for seq, table in enumerate(cut_blocks(batches, "text", TEXT_BYTES)):
            pieces, lengths, parts = [], [], []
            for text in table["text"]:
                own = find(text.as_py() or "")
                pieces += own
                lengths.append(len(own))
                if len(pieces) > PIECES:  # strings cost far less in Arrow
                    parts.append(pa.array(pieces, pa.large_string()))
                    pieces = []
            parts.append(pa.array(pieces, pa.large_string()))
            del pieces
            encoded = pa.concat_arrays(parts).dictionary_encode()
            del parts
            words, place = by_hash(encoded.dictionary)
            sequence = place[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            uses = np.bincount(sequence, minlength=len(words))
            names, content = pack_words(words)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block_number(seq), "ids": table["id"].to_pylist(), "lengths": pack(np.array(lengths, np.int64)),
                        "sequence": pack(np.argsort(by_use(uses))[sequence]), "uses": pack(uses), "names": names, "content": content, "n_words": len(words),
                    }
                ],
                schema=pa.schema(
                    [("block", pa.int64()), ("ids", pa.list_(table.schema.field("id").type)),
                     *[(c, pa.binary()) for c in ("lengths", "sequence", "uses", "names", "content")], ("n_words", pa.int64())]
                ),
            )

    return cut


def _send(parts: int):
    schema = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("content", pa.binary())])

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = unpack_words(row["names"], row["content"])
                out = []
                for p, a, b in stretches(ranges(word_hashes(words), parts)):
                    names, content = pack_words(words.slice(a, b - a))
                    out.append({"p": p, "block": row["block"], "names": names, "content": content})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return send


def _encode_words(vocabulary: Vocabulary):
    schema = pa.schema([("p", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("tokens", pa.binary())])

    def encode(table: pa.Table) -> pa.Table:
        one = vocabulary.encoder().encode_ordinary
        rows = table.to_pylist()
        words = [unpack_words(r["names"], r["content"]) for r in rows]
        encoded = pa.concat_arrays(words).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = [one(w.decode()) for w in encoded.dictionary.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        out, at = [], 0
        for r, w in zip(rows, words, strict=True):
            own = code[at : at + len(w)]
            at += len(w)
            out.append({"p": r["p"], "block": r["block"], "counts": pack(counts[own]), "tokens": pack(flat[gather(starts[own], counts[own])])})
        return pa.Table.from_pylist(out, schema=schema)

    return encode


def _assemble(id_type: pa.DataType, finish=None):
    def assemble(blocks: pa.Table, returned: pa.Table) -> pa.Table:
        ids, values, offsets = [], np.zeros(0, np.int64), np.zeros(1, np.int64)
        if blocks.num_rows:
            row = blocks.to_pylist()[0]
            parts = sorted(returned.to_pylist(), key=lambda r: r["p"])
            join = lambda c: np.concatenate([np.zeros(0, np.int64), *[unpack(r[c]) for r in parts]])
            counts, flat = join("counts"), join("tokens").astype(np.int32)
            starts = np.cumsum(counts) - counts
            sequence, lengths = by_use(unpack(row["uses"]))[unpack(row["sequence"])], unpack(row["lengths"])
            sizes = counts[sequence]
            values = flat[gather(starts[sequence], sizes)]
            upto = np.concatenate(([0], np.cumsum(sizes)))
            offsets = np.concatenate(([0], upto[np.cumsum(lengths)]))
            ids = row["ids"]
        tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))
        out = pa.table([pa.array(ids, id_type), tokens], names=["id", "tokens"])
        return finish(out) if finish else out

    return assemble


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", finish=None) -> DataFrame:
    """(id, tokens array<int>) of every row of ``docs``, as encoding each pattern match separately gives.

    ``finish`` is a (function of an Arrow table of id and tokens, schema) that is applied where the ids are put together.

    A null or empty text has no tokens; repeated rows are encoded each; an empty table gives an
    empty result.  Only the id and text columns are read.  A text has up to 2**31 bytes, the most that a cell of a table holds.

    The blocks stay in a table of the catalog until ``release`` or the end of the driver.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    ddl = kind.simpleString()
    blocks = write_bucketed(
        rows.mapInArrow(
            _blocks(vocabulary.pattern),
            f"block long, ids array<{ddl}>, lengths binary, sequence binary, uses binary, names binary, content binary, n_words long",
        ),
        "bpe-blocks",
        "block",
    )
    n_words = blocks.df.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    parts = max(LEAST_GROUPS, math.ceil(n_words / GROUP_WORDS))
    returned = (
        blocks.df.select("block", "names", "content")
        .mapInArrow(_send(parts), "p int, block long, names binary, content binary")
        .groupBy("p")
        .applyInArrow(_encode_words(vocabulary), "p int, block long, counts binary, tokens binary")
    )
    return (
        blocks.df.select("block", "ids", "lengths", "sequence", "uses")
        .groupBy("block")
        .cogroup(returned.groupBy("block"))
        .applyInArrow(_assemble(to_arrow_type(kind), finish and finish[0]), f"id {ddl}, " + (finish[1] if finish else "tokens array<int>"))
        .withColumnRenamed("id", id_col)
    )


def decode_lists(tokens: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each list of ids (null: empty); an id that the table lacks has none."""
    starts, data = vocabulary.table()
    tokens = tokens.fill_null([])
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.asarray(tokens.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.where((flat >= 0) & (flat < len(starts) - 1), flat, len(starts) - 1)
    ends = np.concatenate((starts[1:], starts[-1:]))
    sizes = ends[flat] - starts[flat]
    content = data[gather(starts[flat], sizes)]
    upto = np.concatenate(([0], np.cumsum(sizes)))
    offsets = np.concatenate(([0], upto[np.cumsum(counts)])).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(content.tobytes())])


def sliced(batch: pa.RecordBatch, column: str, size: int = SLICE_IDS):
    """Slices of a batch with about ``size`` list elements each."""
    counts = np.asarray(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(counts) // size
    for _, a, b in stretches(group):
        yield batch.slice(a, b - a)


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary, tokens_col: str = "tokens") -> DataFrame:
    """``encoded`` with a column ``data``: the bytes that each row's ids stand for."""

    def decode(batches):
        for whole in batches:
            for batch in sliced(whole, tokens_col):
                data = decode_lists(batch.column(tokens_col), vocabulary).cast(pa.binary())
                keep = [i for i, n in enumerate(batch.schema.names) if n != "data"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], data], names=[*[batch.schema.names[i] for i in keep], "data"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "data"]
    return encoded.mapInArrow(decode, ", ".join([*columns, "data binary"]))


def digests(vocabulary: Vocabulary, tokens: bool = False):
    """A ``finish`` for ``encode_texts``: n_tokens, ids_sha256, decoded_sha256 of each text, and the ids themselves if ``tokens``.

    The first digest is of the ids as little-endian unsigned 32-bit integers, the second of the bytes they decode to.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["tokens"] if tokens else [])]

    def digest(whole: pa.Table) -> pa.Table:
        parts = []
        for batch in (b for record in whole.to_batches() for b in sliced(record, "tokens")):
            lists = batch.column("tokens")
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            data = decode_lists(lists, vocabulary)
            columns = [
                batch.column("id"),
                lists.value_lengths().cast(pa.int64()),
                pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in data], pa.string()),
                *([lists] if tokens else []),
            ]
            parts.append(pa.Table.from_arrays(columns, names=names))
        if not parts:
            kinds = [whole.schema.field("id").type, pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if tokens else [])]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        return pa.concat_tables(parts)

    return digest, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * tokens
