"""WARC archives written and read by tasks, with an index that comes first.

Each task writes the records of its rows into one archive in a shared folder, each as a gzip
member of its own, and returns an index row per record: archive, offset and length of the member,
URL and digest. Only the index of the attempt that succeeded is used, so a lost executor leaves at
most an archive that nothing refers to. A read takes index rows, sorts them by archive and offset,
joins neighbouring ranges into few large reads of bounded size, and parses the records.

A record whose payload equals that of a record with a smaller id is a revisit: it keeps the
HTTP header block (with the payload's length) and refers to the first record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoint_dir, scratch, settle, table

#: Ranges with a smaller gap between them are read at once, up to so many bytes.
GAP, READ_BYTES = 1 << 16, 1 << 23
#: Payloads that a reader passes on at once have about so many bytes.
PAYLOAD_BYTES = 1 << 23
#: Repeated pages (some 60 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_PAGES = 1_000_000
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 0
#: Effort of compression.
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def one_line(url: str) -> str:
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A whole record with its closing blank lines, and the payload's digest."""
    sha1 = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", sha1


def parsed(data: bytes) -> dict:
    """The fields of one record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"].strip() else None,
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": size if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
        "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None,
    }


def with_firsts(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload, null for that one.

    Equal payloads are found on digests alone; the pages themselves stay where they are while the
    repeats among them are few.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    narrow = settle(rows.where(F.col("size") >= least_bytes).select("page_id", "sha", "size"))
    several = narrow.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1").select("sha", "size", "first")
    later = settle(narrow.join(several, ["sha", "size"]).where(F.col("page_id") > F.col("first")).select("page_id", "sha", F.col("first").alias("refers_to")).distinct())
    joined = rows.join(F.broadcast(later) if later.count() <= BROADCAST_PAGES else later, ["page_id", "sha"], "left")
    return joined.select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes all pages and returns the index, itself written, so that no archive is written twice.

    `folder` is a URI that all executors reach. A null html is an empty payload, a null url
    becomes one made of the page_id. Rows that repeat a page_id each give a record; equal ones
    among them are responses. An empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                found: dict[str, list] = {k: [] for k in ("page_id", "archive", "offset", "length", "url", "digest", "record_type")}
                columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                    data, sha1 = record(page_id, url, html.encode(), refers_to)
                    data = gzip.compress(data, LEVEL, mtime=0)
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)  # records are members already
                    out.write(data)
                    for k, v in zip(found, (page_id, name, at, len(data), url, sha1, "response" if refers_to is None else "revisit"), strict=True):
                        found[k].append(v)
                    at += len(data)
                yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())]))
        finally:
            if out is not None:
                out.close()

    return settle(with_firsts(pages, least_bytes).mapInArrow(run, INDEX))


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name: page_id, record_type, payload, payload_bytes, payload_digest, refers_to.

    An archive may be large and hold a third of all records; its index rows are dealt by
    stretches of offsets, so several tasks read it.
    """
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        name, source = None, None

        def rows(group: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal name, source
            if group[0][0] != name:
                if source is not None:
                    source.close()
                name, source = group[0][0], store.open_input_file(f"{path}/{group[0][0]}")
            start = group[0][1]
            data = source.read_at(group[-1][1] + group[-1][2] - start, start)
            found, size = [], 0
            for _, a, n in group:
                found.append(parsed(gzip.decompress(data[a - start : a - start + n])))
                size += found[-1]["payload_bytes"]
                if size > PAYLOAD_BYTES:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found, size = [], 0
            yield pa.RecordBatch.from_pylist(found, schema=schema)

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                end = group[-1][1] + group[-1][2] if group else 0
                if group and (item[0] != group[-1][0] or item[1] - end > GAP or item[1] + item[2] - group[0][1] > READ_BYTES):
                    yield from rows(group)
                    group = []
                group.append(item)
        if group:
            yield from rows(group)
        if source is not None:
            source.close()

    part = F.floor(F.col("offset") / (4 * READ_BYTES))
    dealt = index.select("archive", "offset", "length").repartition("archive", part).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives that go when the driver ends."""
    folder = checkpoint_dir(spark)
    found = f"{folder if '://' in folder or folder.startswith('file:') else 'file://' + folder}/warc-{uuid.uuid4().hex}"
    scratch(spark, found)
    return found


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
