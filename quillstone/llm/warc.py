"""WARC archives of Zstandard frames: a writer and a reader.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the
dictionary; every record is one Zstandard frame compressed with it.  The reader
takes the dictionary from there, decodes frame by frame, and checks each record's
version line, mandatory headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.workspace import identified, join_keys, materialize, new_path, small_batches

# Fixed values of the formats: Zstandard magic numbers, WARC and revisit profile names.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payloads of at least so many bytes are stored once; smaller ones each time.
LEAST_REVISITED = 1000
#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Tasks that write archives of small inputs; larger inputs have one for each ARCHIVE_BYTES of payloads, at most as many as partitions.
LEAST_WRITERS = 16
#: The dictionary is trained on the first bytes of a bounded sample of payloads; it bears on sizes only.
DICTIONARY_BYTES, DICTIONARY_ROWS, DICTIONARY_HEAD = 32 << 10, 400, 16 << 10
#: The date of every record that the writer makes, so that reruns agree.
RECORD_DATE = "1970-01-01T00:00:00Z"
#: Bytes read at a time; what is left of a chunk is copied for every frame in it.
CHUNK = 1 << 16
#: Characters of a URL that stay when the rest is percent-encoded, and the field that holds such a URL whole.
URL_MARKS, WHOLE_URL = "%:/?#[]@!$&'()*+,;=~", "X-Original-Target-URI"


def _sha1(*parts) -> str:
    machine = hashlib.sha1()
    for p in parts:
        machine.update(p)
    return "sha1:" + base64.b32encode(machine.digest()).decode()


def _plain(value: str) -> bool:
    """Whether a header field gives the value back as it is."""
    return value == value.strip() and not any(ord(c) < 32 or ord(c) == 127 for c in value)


def _target(url: str | None) -> list[str]:
    """The field of a URL; one that a field cannot hold is percent-encoded there, and whole in a field of our own."""
    if url is None:
        return []
    if _plain(url):
        return [f"WARC-Target-URI: {url}"]
    return [f"WARC-Target-URI: {quote(url, safe=URL_MARKS)}", f"{WHOLE_URL}: {base64.b64encode(url.encode()).decode()}"]


def record_parts(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> list[bytes]:
    """The bytes of a response record, or of a revisit of ``refers_to``, which leaves the payload out; payloads aren't copied."""
    if not (_plain(record_id) and _plain(refers_to or "")):
        raise ValueError(f"record id {record_id!r} or {refers_to!r} doesn't fit a header field")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = [head] if refers_to else [head, payload]
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {RECORD_DATE}",
        *_target(url),
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(*block)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {sum(map(len, block))}",
    ]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n", *block, b"\r\n\r\n"]


def build_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A record in one piece."""
    return b"".join(record_parts(record_id, url, payload, refers_to))


def _headers(data: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError(f"{what}: malformed header line {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(record: bytes) -> dict:
    """Headers and payload (a view of the record) of one whole record; ValueError where it breaks the format."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    version, _, lines = record[:end].partition(b"\r\n")
    if version not in (b"WARC/1.0", VERSION):
        raise ValueError(f"unknown version line {version[:40]!r}")
    fields = _headers(lines, "record")
    if missing := [x for x in MANDATORY if x not in fields]:
        raise ValueError(f"missing headers {missing}")
    if not fields["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n, first = int(fields["content-length"]), end + 4
    if len(record) != first + n + 4 or not record.endswith(b"\r\n\r\n"):
        raise ValueError(f"Content-Length {n} doesn't match the record's {len(record) - first - 4}")
    whole = memoryview(record)
    block = whole[first : first + n]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _sha1(block):
        raise ValueError("block digest doesn't match")
    url = fields.get("warc-target-uri")
    if WHOLE_URL.lower() in fields:
        url = base64.b64decode(fields[WHOLE_URL.lower()]).decode()
    kind = fields["warc-type"]
    out = {"type": kind, "id": fields["warc-record-id"].strip("<>"), "url": url, "refers_to": None, "payload": block, "payload_bytes": n, "digest": None}
    if kind in ("response", "revisit"):
        gap = record.find(b"\r\n\r\n", first, first + n)
        if gap < 0:
            raise ValueError("no end of HTTP headers")
        payload = whole[gap + 4 : first + n]
        inner = _headers(record[first:gap].partition(b"\r\n")[2], "HTTP")
        length = inner.get("content-length", str(len(payload)))
        if not length.isdigit():
            raise ValueError("HTTP Content-Length is no number")
        out |= {"payload": payload, "payload_bytes": int(length), "digest": fields.get("warc-payload-digest")}
        if kind == "response":
            if int(length) != len(payload):
                raise ValueError(f"HTTP Content-Length {length} doesn't match the payload's {len(payload)}")
            digest = _sha1(payload)
            if out["digest"] not in (None, digest):
                raise ValueError("payload digest doesn't match")
            out["digest"] = digest
        else:
            if "warc-refers-to" not in fields or out["digest"] is None:
                raise ValueError("revisit without WARC-Refers-To or WARC-Payload-Digest")
            out |= {"refers_to": fields["warc-refers-to"].strip("<>"), "payload": None}
    return out


def read_dictionary(stream: BinaryIO) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """The dictionary of the leading skippable frame, and bytes read beyond it.

    The frame may hold the dictionary as it is or compressed.  An archive without that frame has none.
    """
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE_MAGIC:
        return None, head
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut short")
    if data[:4] == struct.pack("<I", FRAME_MAGIC):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data), b""


def read_records(stream: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one a frame; memory holds one record at a time."""
    dictionary, left = read_dictionary(stream)
    machine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while left or (left := stream.read(CHUNK)):
        frame, parts = machine.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data
                break
            left = stream.read(CHUNK)
            if not left:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from sample payloads; a raw-content one when there are too few to train."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[:DICTIONARY_BYTES] or b"<html></html>"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row to archives in the shared folder; returns (path, records, bytes) of each archive.

    Of rows with equal payloads of at least LEAST_REVISITED bytes the one with the largest id is a response
    and the others revisit it (of rows repeated with that id, one is the response); smaller payloads are responses each.  A null
    payload is the empty one; a null id is kept as ``null`` and yields to any other.  A record's id is
    ``urn:x-page:<page id, percent-encoded>:<the row's place in storage>``.  A payload may have up to 2 GB, as a cell of a table.

    Writers name archives anew in every attempt and report those they finished, so a lost executor's files are never read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = new_path(spark, "warc")
    rows = identified(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")), "uid"
    )
    sample = rows.select("uid", F.xxhash64("id").alias("o")).orderBy("o", "uid").limit(DICTIONARY_ROWS).select("uid")
    # The sample is chosen by narrow rows, so that every task sends few bytes; it has at most DICTIONARY_ROWS rows.
    heads = rows.join(F.broadcast(sample), "uid").select("uid", F.substring("payload", 1, DICTIONARY_HEAD).alias("h")).collect()
    heads = [bytes(r.h) for r in sorted(heads)]
    dictionary = train_dictionary(heads)
    n = F.octet_length("payload")
    sums = rows.agg(F.coalesce(F.sum(n), F.lit(0)).alias("bytes"), F.count_if(n >= LEAST_REVISITED).alias("large")).first()

    place = F.concat_ws(".", F.lower(F.hex("uid.a")), F.lower(F.hex("uid.b")), F.col("uid.row").cast("string"))
    name = F.concat(F.lit("urn:x-page:"), F.coalesce(F.url_encode(F.col("id").cast("string")), F.lit("null")), F.lit(":"), place)
    narrow = rows.select("uid", "id", name.alias("name"), F.unhex(F.sha2("payload", 256)).alias("sha"), n.alias("n")).filter(F.col("n") >= LEAST_REVISITED)
    narrow = materialize(narrow, "warc-digests", sums["large"])
    keep = narrow.groupBy("sha", "n").agg(F.max(F.struct("id", "uid", "name")).alias("keep"), F.count("*").alias("k")).filter("k > 1")
    keep = materialize(keep, "warc-groups", sums["large"])
    copies = join_keys(narrow.select("uid", "sha", "n"), keep, ["sha", "n"], "k", sums["large"])
    revisits = copies.filter(F.col("uid") != F.col("keep.uid")).select("uid", F.col("keep.name").alias("refers_to"))
    joined = rows.withColumn("name", name).join(revisits, "uid", "left").select("name", "url", "payload", "refers_to")

    def write(batches):
        filesystem, root = _filesystem(path)
        filesystem.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        done, out, size, records = [], None, 0, 0
        for batch in batches:
            names, urls, payloads, targets = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    file = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out = filesystem.open_output_stream(file)
                    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary)
                    size, records = 8 + len(dictionary), 0
                parts = record_parts(names[i].as_py(), urls[i].as_py(), memoryview(payloads[i].as_buffer()), targets[i].as_py())
                frame = packer.compressobj(size=sum(map(len, parts)))
                for part in (*map(frame.compress, parts), frame.flush()):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{path}/{file.rsplit('/', 1)[1]}", records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{file.rsplit('/', 1)[1]}", records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), *[pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)]],
            names=["path", "records", "bytes"],
        )

    # Few large archives rather than one for each small partition.
    writers = max(LEAST_WRITERS, math.ceil(sums["bytes"] / ARCHIVE_BYTES))
    return materialize(joined.coalesce(writers).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives listed in ``archives`` (path).

    Returns record_id, record_type, url, payload (null for revisits, or when ``payloads`` is false), payload_bytes,
    payload_digest (lower-case hex SHA-1) and refers_to (a record id).  A record or archive that
    breaks the format raises ValueError with its place.  An empty list gives an empty result.
    """
    n = archives.count()
    schema = pa.schema(
        [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
         ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    )

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                filesystem, file = _filesystem(uri)
                held, size = [], 0
                with filesystem.open_input_stream(file) as stream:
                    for k, record in enumerate(read_records(stream)):
                        try:
                            x = parse_record(record)
                            hexed = base64.b32decode(x["digest"].removeprefix("sha1:")).hex() if x["digest"] else None
                        except ValueError as e:
                            raise ValueError(f"{uri}, record {k}: {e}") from e
                        held.append(
                            {"record_id": x["id"], "record_type": x["type"], "url": x["url"], "payload": bytes(x["payload"]) if payloads and x["payload"] is not None else None,
                             "payload_bytes": x["payload_bytes"], "payload_digest": hexed, "refers_to": x["refers_to"]}
                        )
                        size += 300 + (len(x["payload"]) if payloads and x["payload"] is not None else 0)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    ddl = "record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    return archives.select("path").repartition(max(1, min(n, 10_000))).mapInArrow(read, ddl)
