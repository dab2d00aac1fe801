"""Deterministic sharded WARC archives: written by ranges of page ids, committed by a manifest, read back.

Shard bounds come from a sample of page ids chosen by hash, so they depend on the data alone and not
on its partitions. A task writes its shards in order of page id, a gzip member for each record, and
starts a new file when the compressed size is reached. Files get their names by moving a temporary
file into place, and only files that the manifest lists count. The manifest is itself written by
Spark's committer after all tasks have ended.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import files
from .common import new_path, pick, tidied

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "shard int, file string, n_records long, n_bytes long, sha256 string"
SAMPLE = 20_000
SALTS = 64


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """One record as a gzip member; a revisit has the response's headers and no payload."""
    digest = _digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    target = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    at = 0
    while at < len(data):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(unpacker.decompress(data[at : at + 8192]))
            at = min(len(data), at + 8192) - len(unpacker.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _shard(pages: DataFrame, rows_per_shard: int) -> tuple[Column, int]:
    """The shard of a page id, and how many shards there are."""
    n = pages.count()
    rows = max(rows_per_shard, n // SAMPLE)
    shards = max(1, -(-n // rows))
    one_in = max(1, n // SAMPLE)
    ids = pages.select("page_id").where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(one_in)) == 0)).distinct()
    known = np.sort(np.array([r[0] for r in ids.collect()], np.int64))  # about SAMPLE ids at any size
    bounds = known[[len(known) * k // shards for k in range(1, shards)]] if len(known) else known

    @F.arrow_udf("int")
    def place(page_id: pa.Array) -> pa.Array:
        values = page_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, values, "right").astype(np.int32))

    return place(F.col("page_id")), shards


def write(pages: DataFrame, path: str, rows_per_shard: int = 2000, roll_bytes: int = 16 << 20, level: int = 4) -> DataFrame:
    """Write archives under ``path``; returns the manifest, which is kept in ``path/manifest``."""
    rows = pick(pages, "page_id", "url", "html")
    shard, shards = _shard(rows, rows_per_shard)
    # rows without an id have no place in the order and are dealt by their content
    shard = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url", "html"), F.lit(shards)).cast("int")).otherwise(shard)
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    # of pages with equal payloads, all but the last are revisits of it
    ids = rows.where("page_id is not null").select("page_id", digest.alias("digest"))
    last = ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    # pages of a very common payload are dealt over salts first, the others by their digests
    common = last.where(F.col("n") >= 16 * SALTS).select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(common, ["digest", "salt"], "left").drop("salt")
    rest = met.where("last is null").drop("last").join(last.where(F.col("n") < 16 * SALTS).drop("n"), "digest")
    revisits = met.where("last is not null").unionByName(rest).where("page_id < last").distinct()
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("last").alias("refers_to"), "digest")
    given = rows.select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"))
    both = marks.unionByName(given).withColumn("shard", shard)
    # a page's marks come before it
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("shard"), F.col("page_id").asc_nulls_first(), F.col("digest").asc_nulls_last(), F.col("url").asc_nulls_first(), F.sha1("html"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        held: list[bytes] = []
        size, current, number = 0, None, 0

        def roll() -> None:
            nonlocal held, size, number
            if held:
                data = b"".join(held)
                name = f"{path}/shard-{current:06d}-{number:04d}.warc.gz"
                files.write_whole(name, data)
                made.append((current, name, len(held), len(data), hashlib.sha256(data).hexdigest()))
                held, size, number = [], 0, number + 1

        page, refers = None, {}
        for batch in stream:
            for page_id, url, html, refers_to, mark, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    roll()
                    current, number = shard, 0
                if page_id != page:
                    page, refers = page_id, {}
                if mark is not None:
                    refers[mark] = refers_to
                    continue
                payload = (html or "").encode()
                packed = record(page_id, url, payload, refers.get(hashlib.sha1(payload).hexdigest()) if refers else None, level)
                if held and size + len(packed) > roll_bytes:
                    roll()
                held.append(packed)
                size += len(packed)
        roll()
        columns = list(zip(*made, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "file", "n_records", "n_bytes", "sha256"])

    both.mapInArrow(tidied(run), MANIFEST).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the files that a manifest lists; digests and lengths are checked."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for headers, block in records(files.read(name)):
                    kind, digest, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    if _digest(block) != headers["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"a record of {name} has another block digest")
                    payload = block.partition(b"\r\n\r\n")[2]
                    if kind == "response" and (_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"a record of {name} has another payload digest")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"]
                width = 7 if with_payload else 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns[:width], kinds[:width], strict=True)], names=names[:width])

    return manifest.select("file").mapInArrow(tidied(run), RECORD + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) and read the archives back.

    A null html is an empty payload; a null url becomes ``urn:page:<page_id>``. Of pages with equal
    payloads the one with the largest page_id is the response; rows that repeat it are responses
    too. A null page_id never refers nor is referred to. An empty table gives no records; other
    columns are ignored.
    """
    manifest = write(pages, new_path(pages.sparkSession, "warc"), **options)
    return read(manifest.repartition(max(1, manifest.count()), "file")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
