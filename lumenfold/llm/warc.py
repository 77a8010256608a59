"""WARC archives as seekable Zstandard bundles.

Records are gathered into independent Zstandard frames of about `frame_bytes`; a bundle ends with the seek table of
the public seekable format (a skippable frame with the compressed and raw size of every frame). The index maps each
record to its bundle, frame and offset inside the frame, so one record is read by decompressing one frame.

Rows: null payload = empty payload; null url = no target header; a null id is kept. Repeated rows that share the
smallest id of a payload are all responses. An empty table gives no bundles and no rows. Extra columns are ignored. A
record is whole in one frame, however long its payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

SKIPPABLE_MAGIC = 0x184D2A5E  # fixed values of the seekable format
SEEKABLE_MAGIC = 0x8F92EAB1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX_SCHEMA = "bundle string, frame int, frame_offset long, record_bytes long, record_id string, id long"
READ_SCHEMA = "id long, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to long, bundle string, frame int, frame_offset long"


class BundleWriter:
    """Streams records into one bundle; holds one frame at a time."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size, self.raw, self.frames = [], 0, 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        self.raw += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.codec.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, packed size, raw size) of each frame, from the footer of an open random-access file."""
    size = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, raw in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def read_record(uri: str, frame: int, offset: int, size: int) -> bytes:
    """One record by its index entry."""
    fs, path = common.open_fs(uri)
    with fs.open_input_file(path) as source:
        return read_frame(source, seek_table(source)[frame])[offset : offset + size]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if ord(c) >= 32 and ord(c) != 127 else "%%%02X" % ord(c) for c in value)


def record(record_id: str, page_id, url, payload: bytes, first) -> bytes:
    """A response record, or a revisit of `first` where that is another id."""
    revisit = first is not None and first != page_id
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Row-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Row-ID: {first}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        yield at, head, raw[end + 4 : end + 4 + size]
        at = end + 8 + size


def with_first(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """Rows (id, url, payload, first): first is the smallest id with the same payload, null if the payload occurs once.

    Only digests that occur more than once are joined back, from a written table: where Spark doesn't broadcast it, AQE
    can split a hot payload's partition of the outer join.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    again = common.spool(p.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeated")
    return p.join(again, "digest", "left").select("id", "url", "payload", "first")


def write_bundles(rows: DataFrame, out: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26) -> DataFrame:
    """Write rows (id, url, payload, first) as bundles under the shared folder `out`; the index, one row per record.

    File names carry the task attempt and the index is committed by Spark, so a retried task never mixes two
    attempts' bytes: bundles that the index doesn't name are leftovers.
    """
    spark = rows.sparkSession
    common.small_batches(spark)
    common.ensure_dir(spark, out)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = common.open_fs(out)
        stem, k, writer, name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, None
        schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64()), ("record_id", pa.string()), ("id", pa.int64())])
        n = 0
        for batch in batches:
            index = []
            for page_id, url, payload, first in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if writer is None:
                    name = f"{stem}-{k}.warc.zst"
                    writer, k = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes), k + 1
                rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{stem}/{n}')}"
                n += 1
                raw = record(rid, page_id, url, payload.encode(), first)
                frame, offset = writer.add(raw)
                index.append((f"{out}/{name}", frame, offset, len(raw), rid, page_id))
                if writer.raw >= bundle_bytes:
                    writer.close()
                    writer = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*index) if index else [[]] * 6, schema)], schema=schema)
        if writer is not None:
            writer.close()

    return common.spool(rows.select("id", "url", "payload", "first").mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the index, read from its frame at its offset; payload figures of responses are recomputed.

    Bundles are dealt among tasks with their index rows. Each record is parsed at the place that the index names and must
    be the one that it names; a frame's records must fill it, so a record that the index lacks is found too.
    """
    types = {"long": "int64", "int": "int32", "string": "string"}
    columns = [c.split() for c in READ_SCHEMA.split(", ")]

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([(n, getattr(pa, types[t])()) for n, t in columns])
        source = uri = table = raw = None
        frame, end = -1, 0

        def leave(following):
            """Nothing may be left of the frame, nor frames after a bundle's last one."""
            if raw is not None and (end != len(raw) or following != frame + 1):
                raise ValueError(f"{uri} has records that the index lacks in frame {frame} or after it")

        for batch in batches:
            rows = []
            for name, k, at, size, rid in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if name != uri or k != frame:
                    leave(k if name == uri else len(table or ()))
                    if name != uri:
                        if source is not None:
                            source.close()
                        fs, path = common.open_fs(name)
                        uri, source = name, fs.open_input_file(path)
                        table, frame = seek_table(source), -1
                    if k != frame + 1:
                        raise ValueError(f"{uri} has records that the index lacks before frame {k}")
                    frame, end, raw = k, 0, read_frame(source, table[k])
                _, head, block = next(parse(raw[at : at + size]))
                if at != end or head["WARC-Record-ID"] != f"<{rid}>":
                    raise ValueError(f"{rid} isn't at {at} in frame {k} of {uri}")
                end = at + size
                kind, body = head["WARC-Type"], block[block.index(b"\r\n\r\n") + 4 :]
                length, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:]
                if kind == "response" and (len(body) != length or digest32(body) != digest):
                    raise ValueError(f"damaged record {rid} in {uri}")
                own, to = head.get("X-Row-ID"), head.get("X-Refers-To-Row-ID")
                rows.append((None if own is None else int(own), rid, kind, head.get("WARC-Target-URI"), length, digest, None if to is None else int(to), uri, k, at))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)
        leave(len(table or ()))
        if source is not None:
            source.close()

    places = index.select("bundle", "frame", "frame_offset", "record_bytes", "record_id")
    bundles = max(1, places.select("bundle").distinct().count())
    return places.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "frame_offset").mapInArrow(read, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive `pages`, read the archives back, one row per page."""
    rows = with_first(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    index = write_bundles(rows, common.shared_dir(spark, "warc"))
    return read_bundles(spark, index).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
