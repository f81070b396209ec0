"""WARC archives with an index: offset, length, URL and digest of every record, and byte-range reads by it.

Records are gzip members of their own, so a record can be read by its byte range alone. Each task writes one archive
file under a fresh name and returns one index row per record; the index, not the folder, says which files count, so a
task that is run again leaves at most an unused file.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map, materialize, partitions
from ledgerloom.sources.scratch import scratch_path

INDEX = "file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, page_id long, refers_to long"
#: Payloads below this many bytes are always stored.
LEAST = 100
#: Bytes between two selected records up to which one read covers both, and the most that one read covers.
GAP, SPAN = 64 << 10, 8 << 20


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    ident = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return fields, rest[:size]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_record_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses): of equal payloads of LEAST bytes and more, the row
    with the smallest page_id is the response; rows that share that page_id as well are all responses."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    big = F.octet_length("html") >= LEAST
    firsts = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    # written first, so that the join's two sides are plain shuffles and Spark can split a digest that many rows share
    firsts = materialize(firsts, "warc-firsts")
    typed = rows.join(firsts, (F.col("digest") == F.col("d")) & big, "left")
    return typed.select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path as Spark takes it: `s3a` and `s3n` are names of Hadoop's for `s3`, and a local path
    may stand without a scheme."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def write_archive(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Writes a record per row of pages under `path` (a folder that all executors reach) and returns the index, which
    is stored there as well, under `index`.

    Null html: an empty payload. Null page_id: a record without a number; where an equal payload has one, it revisits
    that. Null url: no target. Repeated rows: a record each. Empty table: no file, an empty index. Other columns of
    pages aren't stored.
    """
    typed = with_record_types(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        offset = 0
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64())])
        for b in batches:
            rows = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store, folder = store_of(path)
                    store.create_dir(folder, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                payload = html.encode()
                kind = "response" if refers_to is None else "revisit"
                data = _gzip(record(kind, page_id, url, digest, len(payload), refers_to, payload if refers_to is None else b""))
                out.write(data)
                rows.append((name, offset, len(data), url, digest, len(payload), kind, page_id, refers_to))
                offset += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        if out is not None:
            out.close()

    arrow_map(typed, run, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """Reads that cover the records at (offset, length), in order: (start, end, indexes of the records in it)."""
    found: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in sorted(enumerate(rows), key=lambda x: x[1]):
        end = offset + length
        if found and offset - found[-1][1] <= gap and end - found[-1][0] <= span:
            start, old, members = found[-1]
            found[-1] = (start, max(old, end), [*members, i])
        else:
            found.append((offset, end, [i]))
    return found


def read_records(index: DataFrame, path: str) -> DataFrame:
    """The selected records of an archive: index may be filtered in any way. Returns page_id, url, record_type,
    refers_to, digest and payload_bytes as the record states them, with payload (null for a revisit).

    Records are dealt by file and stretch of SPAN bytes and sorted by offset; each task reads runs of near records in
    one byte range. A payload that doesn't fit its digest raises.
    """
    dealt = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("stretch")).repartition(partitions(index.sparkSession), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def run(batches):
        store, folder = store_of(path)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def number(text: str | None) -> int | None:
            body = (text or "<urn:page:null>")[10:-1]
            return None if body == "null" else int(body)

        def one(raw: bytes) -> tuple:
            f, payload = parse(gzip.decompress(raw))
            digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "revisit"
            if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(f["X-Payload-Length"])):
                raise ValueError(f"payload of {f['WARC-Record-ID']} doesn't fit its digest")
            return number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], number(f.get("WARC-Refers-To")), digest, int(f["X-Payload-Length"]), None if revisit else payload

        for b in batches:
            files = b.column(0).to_pylist()
            places = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            for name in dict.fromkeys(files):
                mine = [i for i, x in enumerate(files) if x == name]
                with store.open_input_file(f"{folder}/{name}") as f:
                    for start, end, members in ranges([places[i] for i in mine]):
                        data = f.read_at(end - start, start)
                        rows = [one(data[places[mine[m]][0] - start : sum(places[mine[m]]) - start]) for m in members]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(schema)], schema=schema)

    return arrow_map(dealt, run, "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary")


def new_archive(pages: DataFrame, **columns) -> tuple[DataFrame, str]:
    """write_archive into a fresh folder of the shared one: (index, path)."""
    path = scratch_path(pages.sparkSession, "warc")
    return write_archive(pages, path, **columns), path
