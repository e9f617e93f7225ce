"""WARC archives: write them, turn whole-file gzip into a member for each record with an offset index, read them back."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .files import open_new, open_old

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header's value on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record. ``payload`` None: a revisit of ``refers_to``, whose HTTP head still tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(file, piece: int = PIECE) -> Iterator[bytes]:
    """What a gzip file holds, however its members are cut, in bounded pieces. A cut-off file is an error."""
    inflate, begun = zlib.decompressobj(31), False
    while raw := file.read(piece):
        while raw:
            begun = True
            if out := inflate.decompress(raw, piece):
                yield out
            raw = inflate.unconsumed_tail
            if inflate.eof:
                raw, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    while begun and (out := inflate.decompress(b"", piece)):
        yield out
        begun = not inflate.eof
    if begun and not inflate.eof:
        raise EOFError("the gzip stream is cut off")


def header_of(head: bytes) -> dict[str, str]:
    """Fields of a WARC or HTTP head by lower-case name."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """Each record's head, and its block with the closing line ends, in pieces to be used before the next record."""
    held = bytearray()

    def more() -> bool:
        nonlocal held
        got = next(pieces, None)
        if got is not None:
            held += got
        return got is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 or held[:2] == b"\r\n":
            if held[:2] == b"\r\n":  # stray blank lines before a record
                del held[:2]
            elif not more():
                if held.strip():
                    raise EOFError("a record is cut off")
                return
        head = bytes(held[: end + 4])
        del held[: end + 4]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {head[:40]!r}")
        left = int(header_of(head)["content-length"]) + 4

        def block() -> Iterator[bytes]:
            nonlocal left
            while left:
                if not held and not more():
                    raise EOFError("a record is cut off")
                out = bytes(held[:left])
                del held[:left]
                left -= len(out)
                yield out

        body = block()
        yield head, body
        for _ in body:  # whatever was not read
            pass


def normalise(source: str, target: str, index: str, level: int = 4) -> int:
    """Inflate ``source`` once, write each record as a gzip member of its own to ``target`` and a line for each to ``index``.

    A line of the index is JSON: offset, length, id and type. Memory holds a piece of a record, whatever its size.
    Returns the number of records.
    """
    at, n = 0, 0
    with open_old(source) as file, open_new(target) as out, open_new(index) as lines:
        for head, body in records(inflated(file)):
            deflate, began = zlib.compressobj(level, zlib.DEFLATED, 31), at
            fields = header_of(head)
            for piece in (head,), body:
                for p in piece:
                    if packed := deflate.compress(p):
                        out.write(packed)
                        at += len(packed)
            last = deflate.flush()
            out.write(last)
            at += len(last)
            lines.write(json.dumps({"offset": began, "length": at - began, "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}).encode() + b"\n")
            n += 1
    return n


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The WARC header and the block of the record at an index entry."""
    file.seek(offset)
    raw = zlib.decompress(file.read(length), 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header_of(head)
    return fields, rest[: int(fields["content-length"])]


ARCHIVES = "path string, n_records long"


def _archiver(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, out = TaskContext.get(), [], None
        for batch in batches:
            for page_id, url, html, size, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    made.append([f"{folder}/part-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz", 0])
                    out, deflate, written = open_new(made[-1][0]), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                payload = None if refers is not None else (html or "").encode("utf-8", "surrogatepass")
                raw = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), size, refers, date)
                out.write(deflate.compress(raw))
                written += len(raw)
                made[-1][1] += 1
                if written >= file_bytes:
                    out.write(deflate.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(deflate.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "n_records"])

    return run


def write_warc(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record for each page into archives that are one gzip stream each; return (path, n_records) of the files.

    Of pages whose payloads (html in UTF-8, null: empty) are equal and have ``least_bytes`` or more, the one with the
    largest id is the response and the others are revisits without a payload. Pages that share the largest id are all
    responses; a null id is smaller than any, and where all ids of a group are null all are responses. Only hashes are
    grouped, after partial sums; payloads move at most once, in a join whose hot keys Spark can split.

    A null url is left out of the record; control characters in a url are percent-encoded. Repeated rows get a record
    each. Pages of any length are whole records; a file ends after ``file_bytes``, so it may be longer by one page. An
    empty table gives no files; other columns are not read.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("size", F.octet_length(html).cast("long")).withColumn("digest", F.sha1(html))
    groups = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = rows.join(groups, "digest", "left").select("page_id", "url", "html", "size", "digest", refers.alias("refers_to"))
    return ws.stage(joined.mapInArrow(_archiver(folder or ws.of("archives"), date, file_bytes), ARCHIVES), "manifest", batch_rows=500)


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, min(files.count(), 4 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _normaliser(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths = batch.column(0).to_pylist()
            made = [f"{p.removesuffix('.warc.gz')}-{attempt}.records.warc.gz" for p in paths]
            n = [normalise(p, m, f"{m}.index", level) for p, m in zip(paths, made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(n, pa.int64())], names=["path", "n_records"])

    return run


def normalise_archives(archives: DataFrame, *, level: int = 4) -> DataFrame:
    """(path, n_records) of a file with a member for each record, for every file of ``archives`` (path); PATH.index lies beside.

    Each file is inflated once, by one task, in bounded memory. Attempts write under names of their own.
    """
    ws = Workspace(archives.sparkSession, "warc-records")
    return ws.stage(_spread(archives.select("path")).mapInArrow(_normaliser(level), ARCHIVES), "manifest")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _number(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix("urn:page:")
    return None if tail in ("", "none") else int(tail)


def _record_reader(with_payload: bool):
    schema = RECORDS.append(pa.field("payload", pa.string())) if with_payload else RECORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_old(path) as file, open_old(f"{path}.index") as lines:
                    for line in lines.read().splitlines():
                        entry = json.loads(line)
                        head, block = read_member(file, entry["offset"], entry["length"])
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        whole = head["warc-type"] == "response"
                        if whole and base32_sha1(payload) != digest:
                            raise ValueError(f"{path}: the record at {entry['offset']} does not match its digest")
                        size = len(payload) if whole else int(header_of(http)["content-length"])
                        rows.append((_number(head["warc-record-id"]), size, digest, head["warc-type"], _number(head.get("warc-refers-to")), head.get("warc-target-uri"), payload.decode() if whole and with_payload else None))
                        held += 300 + len(head.get("warc-target-uri") or "") + len(payload) * with_payload
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=False)], schema=schema)
                            rows, held = [], 0
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, schema.types, strict=False)], schema=schema)

    return run


def read_warc(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row for each record of normalised ``archives``: page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload].

    Each record is sought by its index entry and inflated alone; a response whose payload does not match its digest is
    an error. A revisit's digest and size are those of the payload it stands for.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload string" * with_payload
    return _spread(archives.select("path")).mapInArrow(_record_reader(with_payload), schema)
