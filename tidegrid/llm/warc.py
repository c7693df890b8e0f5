"""WARC archives: a writer with revisit records, and a reader that splits files at any byte."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.staging import shared_dir, stage

MAGIC = b"\x1f\x8b\x08"
RANGES_A_TASK = 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_type string, record_id string, target_uri string, payload_bytes long, "
    "payload_digest string, refers_to string, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, sha: str, refers_to: str | None, date: str) -> bytes:
    """One record, not compressed; a revisit keeps the HTTP head, which tells the full length."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; the length must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("record is cut off")
    return fields, rest[:size]


def _writer(folder: str, level: int, date: str):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        # a name of its own for each attempt: only files named by a finished task are read
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for frame in frames:
            for row in frame.itertuples(index=False):
                payload = b"" if row.payload is None else row.payload.encode("utf-8", "surrogatepass")
                kind = "revisit" if row.refers_to is not None else "response"
                data = record(kind, row.record_id, row.target_uri, payload, digest(payload), row.refers_to, date)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress(data) + pack.flush()
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [count]})

    return write


def write_archives(records: DataFrame, folder: str, level: int = 4, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One archive per partition of ``(record_id, target_uri, payload string, refers_to)``; returns ``(path, bytes, records)``.

    The list is written to the shared folder and is what the reader takes; files of lost or
    repeated attempts are not on it.  Null payloads are empty; rows with ``refers_to``
    become revisits; null URIs have no header.  Partitions without rows give no file.
    """
    columns = records.select("record_id", "target_uri", "payload", "refers_to")
    return stage(columns.mapInPandas(_writer(folder, level, date), "path string, bytes long, records long"), "archives")


class _Bytes:
    """A file from ``start`` on, read piece by piece as it is needed."""

    def __init__(self, file, start: int, piece: int):
        self.file, self.start, self.piece, self.data, self.ended = file, start, piece, bytearray(), False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(self.piece)
        self.ended = not got
        self.data += got
        return bool(got)

    def inflate(self, at: int) -> tuple[bytes, int] | None:
        """The gzip member at ``at`` and the place after it; None if there is none."""
        unpack, out, pos = zlib.decompressobj(31), [], at - self.start
        try:
            while not unpack.eof:
                if pos >= len(self.data) and not self.more():
                    return None
                chunk = bytes(self.data[pos : pos + 16384])
                out.append(unpack.decompress(chunk))
                pos += len(chunk)
                if len(out) == 1 and len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        data = b"".join(out)
        return (data, self.start + pos - len(unpack.unused_data)) if data.startswith(b"WARC/1.") else None

    def candidate(self, at: int, end: int) -> int:
        """The next gzip magic at or after ``at`` that starts before ``end``, or -1."""
        while True:
            found = self.data.find(MAGIC, at - self.start)
            if found >= 0:
                return self.start + found if self.start + found < end else -1
            at = max(at, self.start + len(self.data) - 2)
            if at >= end or not self.more():
                return -1


def records_from(file, start: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in ``[start, end)`` of an open file.

    Candidates are gzip magics; one counts if it decodes to a WARC header and a whole member.
    From there members follow each other; after a gap the search begins again.
    """
    source, at = _Bytes(file, start, piece), start
    while (at := source.candidate(at, end)) >= 0:
        member = source.inflate(at)
        if member is None:
            at += 1
            continue
        yield parse(member[0])
        at = member[1]
        done = at - source.start
        if done > 4 * piece:  # what is read is let go
            del source.data[:done]
            source.start = at


def _reader(payloads: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for piece in frame.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(piece.path)
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for fields, block in records_from(file, piece.start, piece.end):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            size, sha = len(body), digest(body)
                            if told and told != sha:
                                raise ValueError(f"payload digest of {fields.get('warc-record-id')} does not agree")
                        else:
                            m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                            size, sha = int(m[1]) if m else None, told
                        refers = fields.get("warc-refers-to")
                        rows.append(
                            (
                                kind,
                                fields.get("warc-record-id", "").strip("<>"),
                                fields.get("warc-target-uri"),
                                size,
                                sha,
                                refers.strip("<>") if refers else None,
                                body if payloads and kind == "response" else None,
                            )
                        )
                        held += len(block) if payloads else 200
                        if held > 8_000_000:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})


def read_archives(files: DataFrame, range_bytes: int = 2_000_000, payloads: bool = True) -> DataFrame:
    """Response and revisit records of archives listed as ``(path, bytes)``.

    Each task takes byte ranges of ``range_bytes``; a record belongs to the range in which it
    starts, wherever it ends.  Payload digests of responses are checked; a revisit tells those
    of the full payload.  Files without records give no rows.
    """
    starts = F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {range_bytes}L)")).alias("start")
    ranges = files.select("path", "bytes", starts)
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    # listed ranges are small in bytes and long in work: a number of tasks that follows them
    # keeps adaptive execution from merging all of them
    count = int(ranges.count())
    tasks = max(min(count, 2 * files.sparkSession.sparkContext.defaultParallelism), -(-count // RANGES_A_TASK))
    return ranges.repartition(max(tasks, 1)).mapInPandas(_reader(payloads), RECORD)


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least_bytes`` bytes, the smallest id is the response.

    Null html is an empty payload.  Rows that repeat the smallest id are responses too; rows
    with a null id are revisits of the smallest known id, and responses if there is none.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    part = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).cast("long").alias("n"), F.col(url).alias("target_uri"), payload.alias("payload"))
    part = part.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    copies = part.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("c"))
    copies = copies.where("c > 1 and first is not null").select("sha", "first")
    joined = part.join(copies, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("n").eqNullSafe(F.col("first"))
    return joined.select(
        F.concat(F.lit("urn:page:"), F.coalesce("id", F.lit("null"))).alias("record_id"),
        "target_uri",
        "payload",
        F.when(again, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
    )


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write pages to archives and read them back: ``page_id``, digest columns, type and reference."""
    folder = folder or f"{shared_dir(spark)}/tidegrid-warc/{uuid.uuid4().hex}"
    files = write_archives(page_records(pages, **columns), folder)
    found = read_archives(files, payloads=False)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) as bigint)")
    return found.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "target_uri",
    )
