"""WARC archives, Zstandard-compressed record by record with a dictionary in a leading skippable frame.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is a frame of its
own that needs that dictionary and nothing else.  Responses hold an HTTP head and the payload; records whose payload
an archived response already has are revisits, with the head alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditflow.llm.shared import scratch_path, side, small_batches, written

SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "file string, offset long, record_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def train_dictionary(rows: DataFrame, date: str = "2024-01-01T00:00:00Z", sample_bytes: int = 8 << 20, size: int = 65_536) -> bytes:
    """A dictionary of at most ``size`` bytes from whole archived records of a bounded sample of ``classify``'s rows.

    About ``sample_bytes`` of records are drawn by a hash at a rate from the table's bytes; a record of over an
    eighth of that is no sample, so the driver holds little whatever the input.  The size follows the sample.  Where
    there is too little to train on, the sampled records themselves are the dictionary's content, so that every
    archive has one; only compression depends on it.  Empty only for an empty table.
    """
    import zstandard

    head = 500  # about what a record has beside its payload
    total = rows.agg(F.sum(F.col("payload_bytes") + head)).first()[0]
    if not total:
        return b""
    key = F.xxhash64("page_id", "url", "digest")
    rate = int(min(1.0, sample_bytes / total) * (1 << 30))
    rows = rows.withColumn("key", key).where(F.col("payload_bytes") <= sample_bytes // 8)
    drawn = rows.where(F.pmod("key", F.lit(1 << 30)) <= rate).collect() or rows.orderBy("key").limit(1).collect()
    drawn = sorted(drawn, key=lambda r: (r["key"], -1 if r["page_id"] is None else r["page_id"]))
    samples = [record_bytes(r["page_id"], r["url"], r["html"], r["digest"], r["payload_bytes"], r["record_type"], r["refers_to"], date) for r in drawn]
    size = max(1024, min(size, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b"".join(samples)[-size:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def classify(pages: DataFrame, least_bytes: int) -> DataFrame:
    """The rows with payload_bytes, digest, record_type and refers_to.

    Of payloads that are equal and at least ``least_bytes`` long, the row with the largest page_id is the response.
    Digests meet without the pages; pages are joined by id and digest with the revisits alone, so that neither
    short pages nor a payload that many share make a hot key.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    long = rows.where(F.col("payload_bytes") >= least_bytes)
    first = long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = written(first.select("digest", "first"), "payloads")
    other = long.select("page_id", "digest").join(side(first), "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = side(written(other.select("page_id", "digest", "first").distinct(), "revisits")).alias("v")
    same = (F.col("p.digest") == F.col("v.digest")) & F.col("p.page_id").eqNullSafe(F.col("v.page_id"))
    columns = ["page_id", "url", "html", "digest", "payload_bytes"]
    kind = F.when(F.col("v.digest").isNotNull(), "revisit").otherwise("response").alias("record_type")
    found = long.alias("p").join(revisits, same, "left").select(*[F.col(f"p.{c}").alias(c) for c in columns], kind, F.col("v.first").alias("refers_to"))
    short = rows.where(F.col("payload_bytes") < least_bytes).select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return found.unionByName(short)


def _uri(page_id) -> str:
    return "<urn:page:none>" if page_id is None or pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def _line(text: str | None) -> str:
    return "" if text is None else "".join(" " if c in "\r\n" else c for c in text)


def record_bytes(page_id, url: str | None, html: str | None, digest: str, size: int, kind: str, refers_to, date: str) -> bytes:
    body = b"" if kind == "revisit" else (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_uri(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); checks the digest of a payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda uri: None if uri is None or uri.endswith(":none>") else int(uri[10:-1])
    kind = fields["WARC-Type"]
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30, level: int = 3, dictionary: bytes | None = None) -> DataFrame:
    """Write one record per row (page_id, url, html) and return the list of archives: (path, records, bytes).

    Every task writes files of its own under a temporary name and renames them when complete, so a task that runs
    again after a lost executor replaces what it wrote.  Nulls: a null html is an empty payload, a null url leaves
    the target out, a null id is recorded as none and is the last choice for a response.  Repeated rows are written
    each; rows that repeat the response's id are responses too.  Extra columns are ignored.  An empty table
    writes no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or scratch_path(spark, "warc")
    rows = classify(pages.select(F.col("page_id").cast("long"), "url", "html"), least_bytes)
    words = train_dictionary(rows, date) if dictionary is None else dictionary
    run = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        out, name, done, n, size = None, "", [], 0, 0

        def close() -> None:
            out.close()
            store.move(f"{base}/.{name}.{task.taskAttemptId()}", f"{base}/{name}")
            done.append((f"{path}/{name}", n, size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None or size >= file_bytes:
                    if out is not None:
                        close()
                    name, n, size = f"{run}-{task.partitionId():06d}-{len(done):04d}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{base}/.{name}.{task.taskAttemptId()}", compression=None)
                    size += out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
                raw = record_bytes(row.page_id, row.url, row.html, row.digest, row.payload_bytes, row.record_type, row.refers_to, date)
                size += out.write(packer.compress(raw))
                n += 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return written(rows.mapInPandas(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """Every record of the archives listed in ``archives`` (a path column): see READ_SCHEMA.

    Files are read as streams, one task for a file; the dictionary comes from the file's leading frame.  ``payload``
    is null for revisits, and for all with ``payloads=False``.
    """
    small_batches(spark)

    def records(name: str) -> Iterator[tuple[int, bytes]]:
        import zstandard
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(name)
        with store.open_input_stream(at, compression=None) as f:
            magic, size = struct.unpack("<II", f.read(8))
            if magic != SKIPPABLE:
                raise ValueError(f"{name} has no leading dictionary frame")
            words = f.read(size)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
            offset, data = 8 + size, f.read(chunk)
            while data:
                one, parts, used = reader.decompressobj(), [], 0
                while True:
                    parts.append(one.decompress(data))
                    used += len(data)
                    if one.eof:
                        break
                    data = f.read(chunk)
                    if not data:
                        raise ValueError(f"{name} ends inside a record")
                data = one.unused_data
                yield offset, b"".join(parts)
                offset += used - len(data)
                data = data or f.read(chunk)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        for batch in batches:
            for name in batch["path"]:
                rows, held = [], 0
                for offset, raw in records(name):
                    record_id, url, kind, refers_to, size, digest, payload = parse_record(raw)
                    rows.append((name, offset, record_id, url, kind, refers_to, size, digest, payload if payloads else None))
                    held += len(raw) * payloads + 200
                    if held > 8 << 20:
                        yield _frame(rows, columns)
                        rows, held = [], 0
                yield _frame(rows, columns)

    files = max(1, archives.count())
    return archives.select("path").repartition(files).mapInPandas(read, READ_SCHEMA)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"record_id": "Int64", "refers_to": "Int64"})
