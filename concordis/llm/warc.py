"""WARC archives of pages: written by tasks, read back as streams.

Writing: the digest of every payload decides who answers; of equal payloads the row with the
largest page id becomes the response and the others revisit it.  Each task
writes its rows as archives, one gzip member per record, and starts a new archive at ``ARCHIVE_BYTES``.
An archive is written under a name of its own for each task attempt; the list of archives is a table that Spark
commits, so archives of lost or repeated attempts are never read.

Reading: tasks get archive names and read each one in sequence: bytes are inflated piece by
piece, a member ends where zlib says so, the record's header gives the length of its block, and the block is taken
from the stream while its digests are computed.  No archive is held whole; only header lines are.
Block and payload digests are compared with the record's; a mismatch, a truncated member or a
block of another length than stated fails the read.

Archives live in the shared work folder (``session.work_folder``) and are reached by its URI.

Cases: a null html is an empty payload; empty payloads equal each other, so they are deduplicated too.  Repeated rows of
the largest id are all responses.  A null page id sorts below all others; when no row of a group has one,
all are responses.  Urls may be null, of any length, or hold line breaks (percent-encoded in the header).  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordis.llm.common import saved, table, whole
from concordis.session import work_folder

ARCHIVE_BYTES = 64 << 20
MOST_TASKS = 20_000
READ_BYTES = 1 << 16
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2025-01-01T00:00:00Z"
_PAGE_URN = "urn:page:"


class CorruptArchive(ValueError):
    pass


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _safe(url: str | None) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header and names the response."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", _DATE), ("WARC-Target-URI", _safe(url)), ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_PAGE_URN}{refers_to}>"),
        ]
    fields.append(("Content-Length", str(len(block))))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_header(fields) + block + _END) + packer.flush()


class _Inflated:
    """The inflated bytes of a stream of gzip members, read piece by piece."""

    def __init__(self, stream):
        self._stream, self._packed, self._ready, self._inflater = stream, b"", bytearray(), None

    def _fill(self) -> bool:
        """Inflate some more of the current member; false at its end."""
        if self._inflater.eof:
            return False
        data = self._inflater.unconsumed_tail or self._packed or self._stream.read(READ_BYTES)
        self._packed = b""
        more = self._inflater.decompress(data, READ_BYTES)
        if not (data or more or self._inflater.eof):
            raise CorruptArchive("the archive ends inside a member")
        self._ready += more
        self._packed = self._inflater.unused_data if self._inflater.eof else b""
        return True

    def next_member(self) -> bool:
        if not self._packed:
            self._packed = self._stream.read(READ_BYTES)
        if not self._packed:
            return False
        self._inflater = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        searched = 0
        while (at := self._ready.find(mark, searched)) < 0:
            searched = max(0, len(self._ready) - len(mark) + 1)
            if not self._fill():
                raise CorruptArchive("a member ends inside a record header")
        found = bytes(self._ready[:at])
        del self._ready[: at + len(mark)]
        return found

    def pieces(self, size: int):
        while size:
            if not self._ready and not self._fill():
                raise CorruptArchive("a block is shorter than its stated length")
            piece = bytes(self._ready[:size])
            del self._ready[: len(piece)]
            size -= len(piece)
            yield piece

    def finish(self) -> None:
        """A member holds one record: after the block come two line ends and nothing else."""
        while self._fill():
            pass
        if bytes(self._ready) != _END:
            raise CorruptArchive("a block is longer than its stated length")
        self._ready.clear()


def _block(source: _Inflated, size: int) -> tuple[str, str, int]:
    """Digests of block and payload, and the payload's length."""
    block, payload, length, head = hashlib.sha1(), hashlib.sha1(), 0, b""
    in_payload = False
    for piece in source.pieces(size):
        block.update(piece)
        if not in_payload:
            head += piece
            if (at := head.find(_END)) < 0:
                continue
            piece, in_payload = head[at + len(_END) :], True
        payload.update(piece)
        length += len(piece)
    text = lambda h: base64.b32encode(h.digest()).decode()
    return text(block), text(payload), length


def records(stream):
    """Fields of every record: page id, payload length, payload digest, type, what it refers to."""
    source = _Inflated(stream)
    while source.next_member():
        version, *lines = source.until(_END).decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise CorruptArchive("a member does not start with a record")
        fields = dict(line.split(": ", 1) for line in lines)
        block, payload, length = _block(source, int(fields["Content-Length"]))
        source.finish()
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        if fields["WARC-Block-Digest"] != f"sha1:{block}" or not revisit and stated != payload:
            raise CorruptArchive("a digest differs from its record's")
        page = fields["WARC-Page-ID"]
        refers = fields["WARC-Refers-To"].strip("<>").removeprefix(_PAGE_URN) if revisit else None
        yield int(page) if page else None, None if revisit else length, stated, fields["WARC-Type"], int(refers) if refers else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _shared(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself resolves it: its default file system is set in more places than the session.

    Spark names the whole path of an input that is not there; nothing is written for it.
    """
    if ":/" in folder:
        return folder
    try:
        spark.read.text(f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        scheme, path = error.getMessageParameters()["path"].rsplit("/", 1)[0].split(":", 1)
        return f"{scheme}:{path}" if path.startswith("//") else f"{scheme}://{path}"
    raise ValueError(f"no file system found for {folder}")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html, refers_to); return the committed list of archives."""

    def run(batches):
        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        out = name = None
        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns):
                if out is None:
                    name, held = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
                out.write(member)
                held += len(member)
                if held >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], ["archive", "bytes"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held], pa.int64())], ["archive", "bytes"])

    return saved(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, bytes long"), "archives")


_READ = "page_id long, own_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives, each read as one stream."""
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches):
        files, path = _filesystem(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for row in records(stream):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    # A list of names is tiny, whatever lies behind them, so the number of tasks is stated.
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return archives.repartition(tasks, "archive").mapInArrow(run, _READ)


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html and, for revisits, the page whose response holds the payload.

    Payloads are compared by length and SHA-256 (and, when read back, by SHA-1).
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha2(whole(F.col("html")).cast("binary"), 256).alias("payload_hash"), F.octet_length(whole(F.col("html"))).alias("payload_size"),
    )
    # Only ids and hashes are grouped; the largest group adds one row per task.
    first = rows.groupBy("payload_hash", "payload_size").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    shared = first.where(F.col("rows") > 1).select("payload_hash", "payload_size", "first_id")
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shared, ["payload_hash", "payload_size"], "left").select(
        "page_id", "url", "html", F.when(~own, F.col("first_id")).alias("refers_to")
    )


def archive_and_read(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, read all archives, and give each record the length of its full payload."""
    folder = _shared(pages.sparkSession, work_folder(pages.sparkSession, "warc"))
    found = saved(read_archives(write_archives(with_references(pages), folder, archive_bytes), folder), "records")
    # A revisit's payload is that of the response it names; both must state the same digest.
    answers = found.where("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("page_id").alias("answer_id"), F.col("payload_digest").alias("answer_digest"), F.col("own_bytes").alias("answer_bytes")
    ).distinct()
    same = (F.col("refers_to") == F.col("answer_id")) & (F.col("payload_digest") == F.col("answer_digest"))
    return found.join(answers, same, "left").select(
        "page_id", F.coalesce("own_bytes", "answer_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
