"""WARC: archives of request, response or revisit, and metadata records, and their assembly into one row per capture."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import scratch, written
from tallyweave.llm.stores import get, put

LEAST_SHARED = 100  # bytes of a payload that revisits may refer to
ARCHIVE_BYTES = 16 << 20  # payload behind one archive, about
LEVEL = 4  # of compression; every record is a gzip member of its own
PACKED_LEVEL = 1  # of payloads between tasks
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed name space of addresses in RFC 4122
# Fixed value: the profile of WARC 1.1 for records whose payload equals an earlier one.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(text: str | None) -> str:
    """A value that fits one header line: characters that cannot be printed become blanks, blanks at its ends go."""
    return "".join(c if c.isprintable() else " " for c in text or "").strip()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers if v] + [f"Content-Length: {len(content)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _identity(name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, name)}"


def capture(
    name: str, page_id: int | None, url: str | None, html: str | None, refers_to: int | None = None, refers_url: str | None = None, own_id: str | None = None, refers_id: str | None = None,
) -> Iterator[bytes]:
    """The three records of a capture; request and metadata name the response as concurrent.

    ``own_id`` is the identity of its response where revisits name it, ``refers_id`` that of the response it revisits.
    """
    payload = (html or "").encode()
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    own, asked, about = (_identity(f"{name}/{part}") for part in ("response", "request", "metadata"))
    own = own_id or own
    target = ("WARC-Target-URI", _line(url))
    path = "/" + (_line(url).split("://", 1)[-1].split("/", 1) + [""])[1]
    request = f"GET {path} HTTP/1.1\r\nHost: {_line(url).split('://', 1)[-1].split('/', 1)[0]}\r\n\r\n".encode()
    yield record("request", asked, [target, ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/http; msgtype=request")], request)
    # The length of the whole payload stands in the response's own header, also where a revisit leaves the payload out.
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [target, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    fields = f"page-id: {'' if page_id is None else page_id}\r\nurl-missing: {int(url is None)}\r\nhtml-missing: {int(html is None)}\r\n"
    if refers_to is None:
        yield record("response", own, headers, answer + payload)
    else:
        headers += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_id}>" if refers_id else ""), ("WARC-Refers-To-Target-URI", _line(refers_url)), ("WARC-Refers-To-Date", DATE)]
        yield record("revisit", own, headers, answer)
        fields += f"refers-to-page: {refers_to}\r\n"
    yield record("metadata", about, [target, ("WARC-Concurrent-To", f"<{own}>"), ("Content-Type", "application/warc-fields")], fields.encode())


def _warcinfo(path: str) -> bytes:
    """The record that an archive begins with."""
    fields = b"format: WARC File Format 1.1\r\nsoftware: tallyweave\r\n"
    return record("warcinfo", _identity(f"{path}/warcinfo"), [("WARC-Filename", path.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], fields)


MANIFEST = "path string, n_records bigint, n_bytes bigint"
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        members: list[bytes] = []
        gathered, files = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal gathered, files
            path = f"{folder}/{part:08d}-{files:06d}-{attempt}.warc.gz"
            raw = b"".join([_warcinfo(path), *members])
            put(path, raw)
            row = pa.record_batch({"path": [path], "n_records": [len(members) + 1], "n_bytes": [len(raw)]}, schema=_MANIFEST_ARROW)
            members.clear()
            gathered, files = 0, files + 1
            return row

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url", "named")]
            for page_id, url, html, refers_to, refers_url, named in zip(*columns, strict=True):
                identity = _identity(f"{folder}/{named}") if named else None
                own_id, refers_id = (identity, None) if refers_to is None else (None, identity)
                members.extend(capture(f"{folder}/{part}/{files}/{len(members)}/{attempt}", page_id, url, html, refers_to, refers_url, own_id, refers_id))
                gathered += len(html or "")
                if gathered >= archive_bytes:
                    yield flush()
        if members:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives; returns the manifest (path, n_records, n_bytes).

    Each page becomes a request, a response and a metadata record. Among pages whose payloads
    (html in UTF-8, null as empty) are equal and have at least ``least`` bytes, the one with
    the smallest page_id is a response and the others revisit it. Pages that share that
    smallest id are all responses, as are pages in a group without any id. Ids may be null
    (such a page can be a revisit, never the one referred to), urls may be null, and other
    columns are ignored. An empty table gives an empty manifest. Header lines hold urls with characters that
    cannot be printed as blanks. Revisits name the response's record, unless several rows are that first page; the page's id
    stands in their metadata. Every archive begins with a warcinfo record.

    Only digests are grouped, by partial aggregation; pages are joined with the revisits by
    page_id, without a shuffle where these are few. Archives of lost attempts are not in the manifest.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = written(narrow.filter(F.octet_length(payload) >= least).select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), "url"), "digests")
    rows = digests.groupBy("digest", "page_id").agg(F.count("*").alias("rows"), F.min("url").alias("url"))
    groups = rows.groupBy("digest").agg(F.min_by(F.struct("page_id", "rows", "url"), F.struct(F.col("page_id").isNull(), "page_id")).alias("first"), F.sum("rows").alias("n"))
    shared = groups.filter("n > 1 and first.page_id is not null").select("digest", "first")
    # What revisits name is one record; a first page that stands there several times has no name of its own.
    named = F.when(F.col("first.rows") == 1, F.col("digest")).alias("named")
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    marks = rows.join(shared, "digest").select(F.col("page_id").alias("page"), "digest", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("refers_url"), named)
    marks = written(marks.filter("refers_to is not null or named is not null"), "revisits")
    same = narrow["page_id"].eqNullSafe(marks["page"]) & (F.sha2(payload.cast("binary"), 256) == marks["digest"])
    marked = narrow.join(marks, same, "left").select("page_id", "url", "html", "refers_to", "refers_url", "named")
    return written(marked.mapInArrow(_write(folder, archive_bytes), MANIFEST), "manifest")


def _members(raw: bytes) -> Iterator[bytes]:
    """The gzip members of an archive in turn; an archive that is not compressed is one member."""
    if raw[:2] != b"\x1f\x8b":
        yield from [raw] if raw else []
        return
    at = 0
    while at < len(raw):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            piece = raw[at : at + 4096]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(opened.decompress(piece))
            at += len(piece) - len(opened.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content of the records of an archive."""
    for member in _members(raw):
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers.get("content-length", 0))
            yield headers, member[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


RECORDS = (
    "record_id string, concurrent_to string, record_type string, target_uri string, path string, nth bigint, "
    "payload_bytes bigint, payload_digest string, refers_to_record string, refers_to bigint, page_id bigint, url_missing boolean, html_missing boolean, request_line string, packed binary"
)
_RECORDS_ARROW = pa.schema(
    [("record_id", pa.string()), ("concurrent_to", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("path", pa.string()), ("nth", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("page_id", pa.int64()), ("url_missing", pa.bool_()), ("html_missing", pa.bool_()), ("request_line", pa.string()), ("packed", pa.binary())]
)


def _record_row(path: str, nth: int, headers: dict[str, str], content: bytes, with_payload: bool) -> dict:
    kind = headers["warc-type"]
    row = {"record_id": headers["warc-record-id"].strip("<>"), "concurrent_to": headers.get("warc-concurrent-to", "").strip("<>") or None, "record_type": kind}
    row |= {"target_uri": headers.get("warc-target-uri"), "path": path, "nth": nth}
    if kind in ("response", "revisit"):
        head, _, body = content.partition(b"\r\n\r\n")
        lengths = [x.split(b":", 1)[1].strip() for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        whole = kind == "response"
        # A response's figures come from the payload itself, a revisit's from what its headers say of it, if they do.
        said = headers.get("warc-payload-digest")
        row["payload_bytes"] = len(body) if whole else int(lengths[0]) if lengths and lengths[0].isdigit() else None
        row["payload_digest"] = hashlib.sha256(body).hexdigest() if whole else said.removeprefix("sha256:") if said else None
        row["packed"] = zlib.compress(body, PACKED_LEVEL) if whole and with_payload else None
        row["refers_to_record"] = headers.get("warc-refers-to", "").strip("<>") or None
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in content.decode(errors="replace").split("\r\n") if ": " in x)
        for name, field in (("page_id", "page-id"), ("refers_to", "refers-to-page")):
            row[name] = int(fields[field]) if re.fullmatch(r"-?\d+", fields.get(field, "").strip()) else None
        row |= {"url_missing": fields.get("url-missing") == "1", "html_missing": fields.get("html-missing") == "1"}
    elif kind == "request":
        row["request_line"] = content.split(b"\r\n", 1)[0].decode(errors="replace")
    return row


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                for nth, (headers, content) in enumerate(parse(get(path))):
                    rows.append(_record_row(path, nth, headers, content, with_payload))
                    if len(rows) == 300:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)

    return run


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives of a manifest (path), in columns; payloads, ``packed``, only if asked for. A task opens whole archives.

    Archives of other writers are read alike, record kinds of all sorts included; a revisit that does not say the length or digest of
    its payload has null there, digests other than SHA-256 keep their algorithm's name. An empty manifest gives no rows.
    """
    parts = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(_read(with_payload), RECORDS)


def unpacked(packed: Column) -> Column:
    """The payloads of ``read_records``, which are packed on their way between tasks."""

    @F.arrow_udf("binary")
    def unpack(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else zlib.decompress(x) for x in column.to_pylist()], pa.binary())

    return unpack(packed)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the records that are concurrent to one response or revisit, and that one itself.

    capture_id, page_id, url and the structs request, response and metadata, each null where the
    archives lack that record. Requests and metadata that name a response that is not there
    still make a capture. Of records repeated in the archives the first by path and place counts. Records of other
    kinds belong to no capture; page ids are null where the metadata name none; no records give no rows. ``response.refers_to`` is
    the page that a revisit repeats, ``refers_to_record`` the record.
    """
    kinds = {"request": ("request",), "response": ("response", "revisit"), "metadata": ("metadata",)}
    records = records.filter(F.col("record_type").isin(*[k for some in kinds.values() for k in some]))
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    fields = {
        "request": F.struct("record_id", "target_uri", "request_line"),
        "response": F.struct("record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to_record", "packed"),
        "metadata": F.struct("record_id", "page_id", "url_missing", "html_missing", "refers_to"),
    }
    order = F.struct("path", "nth")
    firsts = [F.min_by(fields[k], F.when(F.col("record_type").isin(*kinds[k]), order)).alias(k) for k in fields]
    rows = keyed.groupBy("capture_id").agg(*firsts)
    url = F.when(~F.col("metadata.url_missing"), F.coalesce("response.target_uri", "request.target_uri", F.lit("")))
    rows = rows.withColumn("payload", unpacked(F.col("response.packed")))
    known = [F.col(f"response.{c}") for c in ("record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to_record")]
    refers_to = F.when(F.col("response.record_type") == "revisit", F.col("metadata.refers_to")).alias("refers_to")
    response = F.when(F.col("response").isNotNull(), F.struct(*known, refers_to, "payload"))
    metadata = F.col("metadata").dropFields("refers_to").alias("metadata")
    return rows.select("capture_id", F.col("metadata.page_id").alias("page_id"), url.alias("url"), "request", response.alias("response"), metadata)
