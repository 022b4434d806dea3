"""WARC: records written as gzip members, and a reader that splits the archives by byte ranges.

A task of the reader owns the records that start inside its range. It looks for the gzip magic from the start of the
range on, takes a candidate for a member only if its first bytes decode to a WARC header, and from there goes from
member to member, reading past the end of the range only to finish its last record. So one archive of any size is read
by as many tasks as it has ranges, without an index.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import HOT_KEYS, materialize, new_folder, only, read_table, schema

#: Payloads of fewer bytes are always stored whole.
MIN_REVISIT_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range; and of one read.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, path string, start bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def _line(value: str | None) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n\0]+", " ", value or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member; a revisit has the payload's digest and length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def decode_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    kind = fields.get("warc-type", "")
    whole = int(n) if (n := fields.get("x-payload-length")) else len(payload)
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2]
    digest = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    if kind == "response" and (stated and stated != digest or whole != len(payload)):
        raise ValueError(f"record {fields.get('warc-record-id')}: its payload differs from its digest or length")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": whole, "refers_to": number("x-refers-to-page"), "payload": None if kind == "revisit" else payload,
    }


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to and revisit of each page. See write_warc for the rule."""
    p = only(pages, page_id="bigint", url="string", html="string").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    groups = p.where(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1 and first is not null"), "warc-groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT_KEYS groups can exceed this share of the repeated rows, so they may be broadcast; the rest is joined by shuffle
    hot = groups.where(F.col("n") > total / HOT_KEYS).select(F.col("payload_digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    cold = groups.where(F.col("n") <= total / HOT_KEYS).select(F.col("payload_digest").alias("cold_digest"), F.col("first").alias("cold_first"))
    p = p.join(F.broadcast(hot), p.payload_digest == hot.hot_digest, "left")
    key = F.when(F.col("hot_digest").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    p = p.withColumn("key", key).join(cold, F.col("key") == F.col("cold_digest"), "left")
    first = F.coalesce("hot_first", "cold_first")
    revisit = F.coalesce((first < F.col("page_id")) | (first.isNotNull() & F.col("page_id").isNull()), F.lit(False))
    return p.select("page_id", "url", "payload", "payload_digest", F.when(revisit, first).alias("refers_to"), revisit.alias("revisit"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each page (page_id, url, html) into archives in the folder; returns path, records, bytes.

    Of the records with equal payloads of at least MIN_REVISIT_BYTES bytes, the one with the smallest page_id is a
    response and the others are revisits that refer to it; smaller payloads are always responses. A null html is an
    empty payload. Rows that repeat the smallest page_id are responses as well; a row without page_id is a revisit if
    an equal payload has one. No pages give no archives. Other columns are ignored.

    A task writes its archive under a name of its own and renames it at the end, so a repeated task leaves one whole
    archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        at = TaskContext.get()
        final, own = f"{base}/pages-{at.partitionId():06d}.warc.gz", f"{base}/.tmp-{at.partitionId()}-{uuid.uuid4().hex}"
        n = size = 0
        out = None
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6))):
                if out is None:
                    out = files.open_output_stream(own, compression=None)
                page_id, url, payload, digest, refers_to, revisit = row
                size += out.write(member) if (member := encode_record(page_id, url, payload, digest, refers_to, revisit)) else 0
                n += 1
        if out is not None:
            out.close()
            files.move(own, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "records": [n], "bytes": [size]})

    return classify(pages).mapInArrow(write, "path string, records bigint, bytes bigint")


def splits(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, start, stop of the byte ranges of the archives in a folder, one to a partition."""
    from pyarrow import fs

    files, base = filesystem(folder)
    found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    rows = [(f.path, s, min(f.size, s + split_bytes)) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".warc.gz") for s in range(0, f.size, split_bytes)]
    df = spark.createDataFrame(rows, "path string, start bigint, stop bigint")
    return df.repartitionByRange(max(1, len(rows)), "path", "start") if len(rows) > 1 else df


class _Window:
    """Bytes of a file from some place on, read on demand, of which what lies behind can be dropped."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        if to > self.at:
            self.data, self.at = self.data[to - self.at :], to


def _member(w: _Window, at: int, probe: bool) -> tuple[bytes, int] | None:
    """The member that starts at a place, and where it ends; None if there is none. probe: look at its header first."""
    z, parts, pos, checked = zlib.decompressobj(31), [], at - w.at, not probe
    try:
        while True:
            if pos >= len(w.data) and not w.more():
                return None
            chunk = w.data[pos : pos + (512 if not checked else READ_BYTES)]
            parts.append(z.decompress(chunk))
            pos += len(chunk)
            if not checked and (z.eof or sum(map(len, parts)) >= 5):
                if not b"".join(parts).startswith(b"WARC/"):
                    return None
                checked = True
            if z.eof:
                return b"".join(parts), w.at + pos - len(z.unused_data)
    except zlib.error:
        return None


def read_range(file, start: int, stop: int, damage=None) -> Iterator[tuple[int, dict]]:
    """The records that start in [start, stop) of an open archive, with their places. damage is called with the place of
    each gap: where a member should follow the one before, or begin the file, and none does."""
    w, at, follows = _Window(file, start), start, start == 0
    while at < stop:
        found = _member(w, at, True)
        if found is None:  # the next magic; a gap can only be at the start of a range, or in a damaged archive
            if follows and damage and (at < w.at + len(w.data) or w.more()):
                damage(at)
            follows = False
            while True:
                k = w.data.find(MAGIC, at + 1 - w.at)
                if k >= 0:
                    at = w.at + k
                    break
                at = max(at, w.at + len(w.data) - len(MAGIC))
                if at >= stop or not w.more():
                    return
            w.drop(at)
            continue
        data, end = found
        yield at, decode_record(data)
        at, follows = end, True
        w.drop(at)
    # the next range doesn't know that a member should start here
    if follows and damage and (at < w.at + len(w.data) or w.more()) and _member(w, at, True) is None:
        damage(at)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, damaged=None) -> DataFrame:
    """The records of all archives (*.warc.gz) in a folder, read by byte ranges: page_id, url, record_type,
    payload_digest (hex SHA-256 of the full payload), payload_bytes (of the full payload), refers_to, payload (null
    in revisits), and the path and start of the record. Bytes that are no valid member are passed over, and each such
    gap adds 1 to damaged, an accumulator of the context, if one is given; a response whose payload differs from its
    digest is an error. A folder without archives gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("start", pa.int64())])
        files, _ = filesystem(folder)
        tell = None if damaged is None else lambda _: damaged.add(1)
        for b in batches:
            for path, start, stop in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows: list[dict] = []
                held = 0
                with files.open_input_file(path) as f:
                    for at, r in read_range(f, start, stop, tell):
                        rows.append(r | {"path": path, "start": at})
                        held += len(r["payload"] or b"") + 300
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return splits(spark, folder, split_bytes).mapInArrow(read, schema(RECORDS))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), folder).write.format("noop").mode("overwrite").save()
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id > first THEN first END AS refers_to
FROM g
"""
