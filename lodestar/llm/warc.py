"""WARC archives with revisit records: equal payloads are written once, and later copies refer to the first.

1. Headers (id, payload digest and length, no payload) are shuffled by digest; the smallest id of each digest that occurs
   more than once is its original, and the join of headers to originals names the revisits. The aggregate combines before
   the shuffle and the join is one that Spark splits where a digest is hot. The revisits are stored and counted: up to
   ``MOST_BROADCAST`` of them go to the payloads as a broadcast, and payloads stay where they are; more meet by a join.
2. Each task writes its records with fresh headers, one gzip member each, to files of bounded size in shared storage, and
   returns a manifest. A file's name has the task's attempt, so a task that runs again writes files of its own, and only
   files of the committed manifest are read.
3. Reading parses the members and checks digests of stored payloads. A revisit takes its length from the response that it
   refers to, by id and digest; a revisit without its response is an error.

A null html is an empty payload; payloads under ``least`` bytes are always responses. A null page_id is kept (it has no
WARC-Record-ID of its own and comes last in the order of originals); rows that tie for the smallest id are responses all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import shared_path, stored

LEAST = 100
#: Compressed bytes after which a task starts another file.
FILE_BYTES = 8 << 20
#: Revisits (some 60 bytes each) that are broadcast to the payloads at most.
MOST_BROADCAST = 500_000
DATE = "1970-01-01T00:00:00Z"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes and payload_digest; the payload itself stays where it is."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def resolve_revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_digest and refers_to of the records that revisit another."""
    big = heads.where(F.col("payload_bytes") >= least)
    originals = big.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "refers_to")
    return big.join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def put_file(folder: str, name: str, body: bytes) -> None:
    """Write a file of shared storage (a local or cluster URI) under a name of its own, then move it into place."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    ctx = TaskContext.get()
    draft = f"{path}/.{name}.{ctx.taskAttemptId() if ctx else 0}"
    with fs.open_output_stream(draft) as out:
        out.write(body)
    fs.move(draft, f"{path}/{name}")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Write every page's record under folder, and return the stored manifest: file, records, bytes."""
    revisits = stored(resolve_revisits(headers(pages), least), "warc-revisits")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    found = revisits.select(F.col("page_id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to")
    found = F.broadcast(found) if revisits.count() <= most_broadcast else found.hint("merge")
    # by id and digest: an id that repeats with other payloads keeps each row's own answer
    rows = rows.join(found, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    files = f"{folder}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, number, held, size = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}", 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"pages-{part}-{number:05d}.warc.gz"
            put_file(files, name, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)]), pa.array([size])], schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                held.append(_member(_record(*(batch.column(i)[k].as_py() for i in range(5)))))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")


def members(body: bytes) -> Iterator[bytes]:
    """The records of a .warc.gz file."""
    while body:
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(body) + unpacker.flush()
        body = unpacker.unused_data


def parse_record(record: bytes) -> dict:
    """Header fields in lower case, and the http payload under 'payload'."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = next((x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), "0")
    return fields | {"payload": payload}


def _row(f: dict) -> tuple:
    number = lambda s: int(s[len("<urn:page:") : -1]) if s not in ("", "<urn:page:>") else None
    digest, revisit = f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(f["payload"]).hexdigest() != digest:
        raise ValueError(f"the payload of {f['warc-record-id']} doesn't match its digest")
    return number(f["warc-record-id"]), None if revisit else len(f["payload"]), digest, f["warc-type"], number(f.get("warc-refers-to", "")), f["warc-target-uri"]


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives that the manifest under folder names; those of revisits have no length."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = [_row(parse_record(m)) for m in members(batch.column(0)[k].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    manifest = spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    there = spark.read.format("binaryFile").load(f"{folder}/warc").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return there.join(manifest.select("file"), "file", "left_semi").select("content").mapInArrow(run, RECORDS)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record, with the length of the payload that it stands for."""
    # without payloads, and read twice
    records = stored(read_records(spark, folder), "warc-records")
    responses = records.where("record_type = 'response'")
    held = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    revisits = records.where("record_type = 'revisit'").join(held, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("a revisit of "), F.col("refers_to").cast("string"), F.lit(" lacks its response"))).cast("long")
    return responses.unionByName(revisits.withColumn("payload_bytes", F.coalesce("found", lost)).drop("found"))


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages to fresh archives in shared storage and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    write_archives(pages, folder, least)
    return read_archives(pages.sparkSession, folder)
