"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of whole records, then a seek table in a skippable frame (the
public seekable format: sizes and checksums of all frames). The index maps a record to its bundle, its frame and its
offset in that frame's content. Tasks stream what they write and read one frame at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyrebird.llm.shared import materialise, ship

#: Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"

LEVEL, FRAME_BYTES, BUNDLE_BYTES = 3, 1 << 20, 256 << 20
INDEX = "page_id {0}, bundle string, frame int, frame_at long, frame_bytes long, offset long, length long"
RECORD = "page_id {0}, url string, record_type string, refers_to {0}, payload_bytes long, payload_digest string"


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row.

    Of equal payloads of at least `least` bytes the smallest page_id is a response, rows that repeat it too, and the
    others revisit it. Null html is an empty payload; a null page_id revisits if another row has the payload. The
    smallest ids are joined from a written table, so that a payload that very many rows share can be split.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n"))
    first = materialise(shared.where((F.col("__n") > 1) & F.col("__first").isNotNull()).drop("__n"), "warc-first")
    revisits = F.col("__first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("__first"), F.lit(False))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("__first")).alias("refers_to"),
    )


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the length of the payload that it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of a frame."""
    at = 0
    while at < len(content):
        top = content.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in content[at:top].decode().split("\r\n")[1:])
        end = top + 4 + int(head["Content-Length"])
        yield at, end + 4 - at, head, content[top + 4 : end]
        at = end + 4


class _Bundle:
    """A bundle that is being written, frame by frame."""

    def __init__(self, folder: str) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        fs, path = _fs(folder)
        self.out, self.size, self.table = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0, []
        self.zstd = zstandard.ZstdCompressor(LEVEL)

    def frame(self, content: bytes) -> tuple[int, int, int]:
        data = self.zstd.compress(content)
        self.out.write(data)
        self.table.append(struct.pack("<III", len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.size += len(data)
        return len(self.table) - 1, self.size - len(data), len(data)

    def close(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int, int]]:
    """Place, size, size of content and checksum of each frame, from the end of a bundle."""
    size = f.size()
    n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError("not a seekable bundle with checksums")
    rows, at, out = f.read_at(12 * n, size - 9 - 12 * n), 0, []
    for packed, content, check in struct.iter_unpack("<III", rows):
        out.append((at, packed, content, check))
        at += packed
    return out


def unpack(f: pa.NativeFile, at: int, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(f.read_at(size, at))


def write_archive(typed: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_types() to bundles in folder, an URI that all executors reach; the index, as a table.

    A bundle's name is new with each attempt of a task, and only bundles that the index names count, so a task that is
    run again leaves nothing wrong. A frame closes at FRAME_BYTES of records, a bundle at BUNDLE_BYTES of frames.
    """
    spark = typed.sparkSession
    ship(spark)
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    kind = typed.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, size, rows = None, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal bundle, held, size, rows
            bundle = bundle or _Bundle(folder)
            name, (n, at, packed) = bundle.name, bundle.frame(b"".join(held))
            cols = list(zip(*((i, name, n, at, packed, o, k) for i, o, k in rows)))
            held, size, rows = [], 0, []
            if bundle.size >= BUNDLE_BYTES:
                bundle.close()
                bundle = None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.string(), pa.int32(), *[pa.int64()] * 4))], ["page_id", "bundle", "frame", "frame_at", "frame_bytes", "offset", "length"])

        for batch in batches:
            id_type = batch.schema.field("page_id").type
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for i in range(len(batch)):
                row = [c[i].as_py() for c in cols]
                data = record(*row)
                rows.append((row[0], size, len(data)))
                held.append(data)
                size += len(data)
                if size >= FRAME_BYTES:
                    yield flush()
        if held:
            yield flush()
        if bundle:
            bundle.close()

    # A payload is only needed where it is written.
    slim = typed.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    return materialise(slim.mapInArrow(write, INDEX.format(kind)), "warc-index")


def read_archive(spark: SparkSession, folder: str, bundles: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """All records of the named bundles (column bundle), read frame by frame after their own seek tables.

    A response's size and digest are those of the payload that was read, and must equal its header's; a revisit's are
    its header's. with_payload adds the bytes, null for revisits. The frames of all bundles are dealt over as many tasks
    as their contents' bytes ask, a task having what it would read of a file (spark.sql.files.maxPartitionBytes).
    """
    ship(spark)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as f:
                    got = seek_table(f)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), *(pa.array(c, pa.int64()) for c in zip(*got))], ["bundle", "at", "size", "content", "checksum"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for x in batch.to_pylist():
                with fs.open_input_file(f"{path}/{x['bundle']}") as f:
                    content = unpack(f, x["at"], x["size"])
                if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != x["checksum"]:
                    raise ValueError(f"a frame of {x['bundle']} is damaged")
                rows = [_parsed(head, block) for _, _, head, block in records(content)]
                cols = list(zip(*rows))[: 7 if with_payload else 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    schema = RECORD.format(id_type) + ", payload binary" * with_payload
    id_arrow = {"int": pa.int32(), "bigint": pa.int64()}.get(id_type, pa.string())
    types = [id_arrow, pa.string(), pa.string(), id_arrow, pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def _parsed(head: dict[str, str], block: bytes) -> tuple:
        own = lambda x: (None if x == "" else int(x) if id_type in ("int", "bigint") else x)
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0]), head["WARC-Payload-Digest"].removeprefix("sha256:")
        page, kind = own(head["WARC-Record-ID"][1 + len(ID) : -1]), head["WARC-Type"]
        if kind == "revisit":
            return page, head.get("WARC-Target-URI"), kind, own(head["WARC-Refers-To"][1 + len(ID) : -1]), size, digest, None
        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
            raise ValueError(f"the payload of {page} is damaged")
        return page, head.get("WARC-Target-URI"), kind, None, size, digest, payload

    found = materialise(bundles.select("bundle").distinct().mapInArrow(frames, "bundle string, at long, size long, content long, checksum long"), "warc-frames")
    content = found.agg(F.coalesce(F.sum("content"), F.lit(0))).first()[0]
    # A number that is given stays: by their own few bytes these rows would be taken together in one task.
    tasks = max(1, -(-content // _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))))
    return found.repartition(tasks, "bundle", "at").mapInArrow(parse, schema)


def _bytes(size: str) -> int:
    """A size as Spark's settings spell it."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.rstrip("b")[:1]]


def fetch(index_row, folder: str) -> tuple[dict[str, str], bytes]:
    """Header and block of one record, by its row of the index: one ranged read and one frame."""
    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/{index_row['bundle']}") as f:
        content = unpack(f, index_row["frame_at"], index_row["frame_bytes"])
    _, _, head, block = next(records(content[index_row["offset"] : index_row["offset"] + index_row["length"]]))
    return head, block
