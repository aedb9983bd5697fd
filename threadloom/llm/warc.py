"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

Pages become WARC records in archives that are each one gzip stream. The normaliser inflates such a
stream once, from front to back, rewrites every record as a gzip member of its own, and leaves a
sidecar index of offsets beside the new archive, by which the reader fetches records one at a time.
All files live in a folder that every executor reaches; archives are rolled at ``ROLL_BYTES``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import small_slices
from threadloom.session import materialize, scratch_path

ROLL_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the record holding it."""
    uri = lambda u: "".join(c for c in u or "about:blank" if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {uri(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated pieces of a gzip stream of one or more members; a stream that ends early raises."""
    member = None
    for chunk in chunks:
        while chunk:
            member = member or zlib.decompressobj(31)
            if piece := member.decompress(chunk):
                yield piece
            chunk = member.unused_data if member.eof else b""
            if member.eof:
                member = None
    if member is not None:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records of an inflated stream; holds one record and one piece."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while need(1):
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not need(len(held) + 1):
                raise ValueError("a record's header ends early")
            at = held.find(b"\r\n\r\n")
        fields = dict(line.split(b":", 1) for line in bytes(held[:at]).split(b"\r\n")[1:])
        size = at + 4 + int({k.strip().lower(): v for k, v in fields.items()}[b"content-length"]) + 4
        if not need(size):
            raise ValueError("a record ends early")
        yield bytes(held[:size])
        del held[:size]


def gzip_member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """``pages(page_id, url, html, digest, refers_to, refers_url)`` -> ``(archive)``, one row per monolithic archive written.

    A retried task writes under new names, so only files of tasks that succeeded are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out = deflate = None
        path, written = "", 0
        for batch in small_slices(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, deflate, written = system.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                record = write_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"], row["refers_url"])
                out.write(deflate.compress(record))
                written += len(record)
                if written >= ROLL_BYTES:
                    out.write(deflate.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [path]})
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path]})

    return pages.select("page_id", "url", "html", "digest", "refers_to", "refers_url").mapInArrow(run, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """``archives(archive)`` -> ``(archive, sidecar, records)`` of the rewritten archives, a member per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                path, lines, offset = f"{base}/{uuid.uuid4().hex}.warc.gz", [], 0
                with system.open_input_stream(source, compression=None) as inp, system.open_output_stream(path, compression=None) as out:
                    for record in records(inflate(iter(lambda inp=inp: inp.read(CHUNK), b""))):
                        member = gzip_member(record)
                        out.write(member)
                        fields, _ = parse_record(record)
                        lines.append(json.dumps({"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}))
                        offset += len(member)
                with system.open_output_stream(f"{path}.index.jsonl", compression=None) as out:
                    out.write("\n".join(lines).encode())
                yield pa.RecordBatch.from_pydict({"archive": [path], "sidecar": [f"{path}.index.jsonl"], "records": [len(lines)]})

    return archives.mapInArrow(run, "archive string, sidecar string, records long")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``archives(archive, sidecar)`` -> ``(page_id, record_type, payload_bytes, payload_digest, stored_digest, refers_to)``.

    Records are fetched by their sidecar offsets; digest and size are of the payload found in the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        number = lambda v: int(v) if v else None
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(row["sidecar"], compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with system.open_input_file(row["archive"]) as f:
                    for entry in index:
                        fields, payload = parse_record(zlib.decompress(f.read_at(entry["length"], entry["offset"]), 31))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        rows.append((number(fields["x-page-id"]), fields["warc-type"], len(payload), hashlib.sha256(payload).hexdigest(), digest, number(fields.get("x-refers-to-page-id"))))
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    names = ["page_id", "record_type", "payload_bytes", "payload_digest", "stored_digest", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, stored_digest string, refers_to long"
    return archives.select("archive", "sidecar").mapInArrow(run, schema)


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Adds ``digest``, ``refers_to`` and ``refers_url``: of equal payloads of ``least_bytes`` or more, all but the smallest page_id refer to it."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    columns = ["page_id", "url", "html", "digest"]
    large, small = keyed.where(F.octet_length("html") >= least_bytes), keyed.where(F.octet_length("html") < least_bytes)
    first = large.select("page_id", "url", "digest").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("page_id") != F.col("first_id")
    marked = large.join(first, "digest", "left").select(*columns, F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))
    return marked.union(small.select(*columns, F.lit(None).cast("long"), F.lit(None).cast("string")))


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 100) -> DataFrame:
    """Write, normalise and read back ``pages(page_id, url, html)``: one row per page, from the archives.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; a revisit's size and digest are
    those of the response it resolves to, and a payload that differs from its stored digest raises.
    A null html is an empty payload, a null url ``about:blank``; rows that repeat the first page_id of
    their group are responses too; a null page_id is kept. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    raw, _ = materialize(write_archives(mark_revisits(pages, least_bytes), f"{folder}/raw"), "warc-raw")
    count = max(1, raw.count())
    own, _ = materialize(normalise(raw.repartition(count), f"{folder}/members"), "warc-members")
    back, _ = materialize(read_archives(own.repartition(count), f"{folder}/members"), "warc-read")
    checked = F.when((F.col("record_type") == "response") & (F.col("payload_digest") != F.col("stored_digest")), F.raise_error(F.lit("a payload differs from its stored digest")))
    responses = back.where("record_type = 'response'").withColumn("payload_digest", F.coalesce(checked.cast("string"), F.col("payload_digest")))
    held = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stored_digest"), F.col("payload_bytes").alias("held_bytes")).distinct()
    revisits = back.where("record_type = 'revisit'").select("page_id", "stored_digest", "record_type", "refers_to").join(held, ["refers_to", "stored_digest"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(
        revisits.select("page_id", F.col("held_bytes"), F.col("stored_digest"), "record_type", "refers_to")
    )
