"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent frames of a few records each, a skippable
frame that maps record identifiers to (frame, offset in the frame, length), and
the seek table of the seekable format, whose footer ends the file.  Any Zstandard
reader can stream it; a reader of the footer can fetch one record by
decompressing one frame.

Spark's own text sink writes the files (one row a file, the four bytes of the
footer's magic number being the "line separator"), so any file system that Spark
knows will do and a lost executor leaves no half-written bundle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the format: skippable frames for the index and the seek table, and the footer's magic number.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = b"\xb1\xea\x92\x8f"

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 1 << 16
BUNDLE_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"


def _clean(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record_id(page_id, digest: str) -> str:
    """The identifier of the record that others may refer to: of a page and its payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}"


def _record(record_id: str, page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:]))
    return {"version": lines[0], "fields": fields, "http": inner, "payload": payload}


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _bundles(frame_bytes: int, bundle_bytes: int):
    """Rows of records to rows of whole bundles, without the footer's last four bytes."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        frames: list[tuple[bytes, int]] = []
        index: list[tuple[str, int, int, int]] = []
        pending: list[bytes] = []
        size = packed = 0

        def close_frame():
            nonlocal size, packed
            if pending:
                raw = b"".join(pending)
                frames.append((press.compress(raw), len(raw)))
                packed += len(frames[-1][0])
                pending.clear()
                size = 0

        def close_bundle():
            nonlocal packed
            close_frame()
            listed = zstandard.ZstdCompressor(level=3).compress(json.dumps(index).encode())
            seek = b"".join(struct.pack("<II", len(c), n) for c, n in frames) + struct.pack("<IB", len(frames), 0)
            body = b"".join(c for c, _ in frames) + _skippable(INDEX_MAGIC, listed) + struct.pack("<II", SEEK_MAGIC, len(seek) + 4) + seek
            frames.clear()
            index.clear()
            packed = 0
            return pa.record_batch([pa.array([body], pa.binary())], names=["bundle"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, keeper = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "keeper"))
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = "response" if keeper is None or keeper == page_id else "revisit"
                # Rows with the same id and payload are records of their own; the first takes the name that revisits refer to.
                first = batch.column("first")[i].as_py()
                record_id = _record_id(page_id, digest) if first and kind == "response" else f"urn:uuid:{uuid.uuid4()}"
                raw = _record(record_id, page_id, url, payload, digest, kind, keeper)
                index.append((record_id, len(frames), size, len(raw)))
                pending.append(raw)
                size += len(raw)
                if size >= frame_bytes:
                    close_frame()
                    if packed >= bundle_bytes:
                        yield close_bundle()
        if pending or frames:
            yield close_bundle()

    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """One record per row of ``pages`` into bundles under ``path``.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal payloads
    of at least ``min_revisit_bytes`` bytes, that with the largest id is written
    as a response and the others as revisits of it; shorter ones are all
    responses.  Rows that repeat the largest id are responses too; rows with a
    null id are revisits of a known id, or responses where none has an id.  A
    null address writes no target; an empty table writes no bundle.  Only the
    three named columns are read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("row", F.monotonically_increasing_id())
    # Of the rows of a payload, the least row with the largest id bears the name; a payload that occurs once has no entry.
    by_payload = keyed.select("digest", "page_id", "row", F.octet_length("html").alias("size")).groupBy("digest")
    keepers = by_payload.agg(F.max("page_id").alias("keeper"), F.max(F.struct("page_id", (-F.col("row")).alias("back"))).alias("named"), F.count("*").alias("n"), F.max("size").alias("size")).where("n > 1")
    repeated = keepers.select("digest", F.when(F.col("size") >= min_revisit_bytes, F.col("keeper")).alias("keeper"), (-F.col("named.back")).alias("named"))
    # A hot payload's rows are split between tasks by the adaptive skew join, as only the left side has many.
    joined = keyed.join(repeated, "digest", "left").select("page_id", "url", "html", "keeper", F.coalesce(F.col("named") == F.col("row"), F.col("page_id").isNotNull()).alias("first"))
    bundles = joined.mapInArrow(_bundles(frame_bytes, bundle_bytes), "bundle binary")
    (
        bundles.select(F.col("bundle").cast("string").alias("value"))
        .write.option("lineSep", FOOTER_MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1)
        .option("compression", "none").mode("overwrite").text(path)
    )


def bundle_index(content: bytes) -> tuple[list[tuple[int, int]], list]:
    """Place and length of each frame, and the rows (record id, frame, offset, length), from a bundle's end."""
    if content[-4:] != FOOTER_MAGIC:
        raise ValueError("not a seekable bundle")
    count, _ = struct.unpack("<IB", content[-9:-4])
    table = content[-9 - 8 * count : -9]
    frames, at = [], 0
    for i in range(count):
        packed = struct.unpack_from("<I", table, 8 * i)[0]
        frames.append((at, packed))
        at += packed
    magic, length = struct.unpack_from("<II", content, at)
    if magic != INDEX_MAGIC:
        raise ValueError("the bundle has no index")
    import zstandard

    return frames, json.loads(zstandard.ZstdDecompressor().decompress(content[at + 8 : at + 8 + length], max_output_size=1 << 30))


def read_record(content: bytes, record_id: str) -> dict:
    """One record by its identifier; decompresses only its frame."""
    import zstandard

    frames, rows = bundle_index(content)
    _, f, at, length = next(r for r in rows if r[0] == record_id)
    begin, packed = frames[f]
    return parse_record(zstandard.ZstdDecompressor().decompress(content[begin : begin + packed])[at : at + length])


def fetch_record(spark: SparkSession, bundle: str, record_id: str) -> dict:
    """One record of a bundle on any file system that Spark knows, by positioned reads of the footer, the tables and one frame."""
    import zstandard

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(bundle)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    size, stream = fs.getFileStatus(path).getLen(), fs.open(path)

    def read(at: int, n: int) -> bytes:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        foot = read(size - 9, 9)
        if foot[-4:] != FOOTER_MAGIC:
            raise ValueError("not a seekable bundle")
        count = struct.unpack("<I", foot[:4])[0]
        packed = [n for n, _ in struct.iter_unpack("<II", read(size - 9 - 8 * count, 8 * count))]
        end = sum(packed)
        length = struct.unpack("<II", read(end, 8))[1]
        rows = json.loads(zstandard.ZstdDecompressor().decompress(read(end + 8, length), max_output_size=1 << 30))
        _, frame, at, n = next(r for r in rows if r[0] == record_id)
        raw = zstandard.ZstdDecompressor().decompress(read(sum(packed[:frame]), packed[frame]))
        return parse_record(raw[at : at + n])
    finally:
        stream.close()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def warc_index(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, bundle, frame, frame_offset, offset, length)`` of every record under ``path``."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                frames, rows = bundle_index(batch.column("content")[i].as_py())
                name = batch.column("path")[i].as_py()
                yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([name] * len(rows)), pa.array([r[1] for r in rows], pa.int32()), pa.array([frames[r[1]][0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["record_id", "bundle", "frame", "frame_offset", "offset", "length"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "record_id string, bundle string, frame int, frame_offset long, offset long, length long")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload)`` of every record.

    Frame after frame, by the seek table and the index.  A revisit has no payload
    of its own (null); its length and digest are those of the full payload.  The
    digest of each response is computed anew and must equal the header.  A folder
    without bundles gives an empty result.
    """

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                frames, rows = bundle_index(content)
                raw, held, out = b"", None, []
                for _, f, at, length in rows:
                    if f != held:
                        if len(out) >= 256:
                            yield _rows(out)
                            out = []
                        begin, packed = frames[f]
                        raw, held = unpack.decompress(content[begin : begin + packed]), f
                    x = parse_record(raw[at : at + length])
                    fields, payload = x["fields"], x["payload"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(x["http"]["content-length"])
                    full = fields["warc-type"] == "response"
                    if full and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"record {fields['warc-record-id']} is damaged")
                    number = lambda v: None if v is None else int(v)
                    out.append((number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields["warc-type"], size, digest, number(fields.get("x-refers-to-page-id")), payload.decode() if full and with_payload else None))
                if out:
                    yield _rows(out)

    return _files(spark, path).select("content").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string")
