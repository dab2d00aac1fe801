"""Media columns: lossless images in archives, read by a data source that plans byte ranges.

A payload becomes an 8-bit grey PNG image 64 samples wide. Tasks gather images into zip archives of
stored members, and a manifest lists the archives with the place of each one's directory. The data
source ``media_archive`` plans partitions as byte ranges of archives from the manifest. A partition
reads the archive's directory, then its own members by their offsets, each checked against the
directory's checksum and read again by itself if that fails, and streams them as Arrow batches.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import files
from .common import new_path, pick, tidied

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "archive string, n_bytes long, n_members long, dir_start long, dir_bytes long"
MEMBERS = "doc_id long, offset long, media binary"


def pad(data: bytes) -> bytes:
    """With zero bytes appended up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """An 8-bit grey image of the payload, which notes the length before padding."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    packed = zlib.compress(lines.tobytes(), level)
    return PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + b"".join(chunk(b"IDAT", packed[k : k + (1 << 30)]) for k in range(0, len(packed), 1 << 30)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and length before padding of an image that to_png() made."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, n_bytes = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk has another checksum")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if n_bytes is None or lines[:, 0].any():
        raise ValueError("not an image of this writer")
    return lines[:, 1:].ravel(), n_bytes


def write_archives(docs: DataFrame, path: str, archive_bytes: int = 32 << 20) -> None:
    """Store every text of ``docs`` in archives under ``path``, and the manifest in ``path/manifest``.

    Archives are named by their content, so repeated attempts of a task write the same files; the
    manifest lists those of the attempts that Spark committed.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        out = io.BytesIO()
        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)

        def close() -> None:
            nonlocal out, archive
            n = len(archive.infolist())
            start = archive.start_dir
            archive.close()
            if n:
                data = out.getvalue()
                name = f"{path}/media-{hashlib.sha256(data).hexdigest()[:32]}.zip"
                files.write_whole(name, data)
                end = data.rindex(b"PK\x05\x06")
                far = data.rfind(b"PK\x06\x06", start, end)
                made.append((name, len(data), n, start, (far if far >= 0 else end) - start))
            out = io.BytesIO()
            archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)

        for batch in stream:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                archive.writestr(zipfile.ZipInfo(f"{doc_id}.png"), to_png(pad(data), len(data)))
                if out.tell() >= archive_bytes:
                    close()
        close()
        columns = list(zip(*made, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    pick(docs, "doc_id", "text").mapInArrow(tidied(run), MANIFEST).write.parquet(f"{path}/manifest")


@dataclass
class ByteRange:
    """Members of an archive whose headers begin in start..end-1."""

    archive: str
    start: int
    end: int
    dir_start: int
    dir_bytes: int


@dataclass
class ByteRanges(InputPartition):
    """What one task reads: a range of an archive, or several small archives."""

    ranges: list[ByteRange]


def directory(data: bytes) -> list[tuple[int, int, int, str]]:
    """(offset, stored bytes, crc32, name) of each member, from a zip archive's central directory."""
    at, out = 0, []
    while data[at : at + 4] == b"PK\x01\x02":
        crc, size, full, n_name, n_extra, n_comment, offset = struct.unpack_from("<III3H8xI", data, at + 16)
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        if extra[:2] == b"\x01\x00":  # large values are here, in this order
            wide = iter(struct.unpack_from(f"<{(len(extra) - 4) // 8}Q", extra, 4))
            full = next(wide) if full == 0xFFFFFFFF else full
            size = next(wide) if size == 0xFFFFFFFF else size
            offset = next(wide) if offset == 0xFFFFFFFF else offset
        out.append((offset, size, crc, name))
        at += 46 + n_name + n_extra + n_comment
    return out


def read_member(source, offset: int, size: int, crc: int, tries: int = 3) -> bytes:
    """A stored member's bytes by its offset; a failed read or checksum is tried again."""
    for left in reversed(range(tries)):
        try:
            source.seek(offset)
            head = source.read(30)
            n_name, n_extra = struct.unpack_from("<HH", head, 26)
            source.seek(offset + 30 + n_name + n_extra)
            data = source.read(size)
            if head[:4] == b"PK\x03\x04" and len(data) == size and zlib.crc32(data) == crc:
                return data
        except OSError:
            if not left:
                raise
        time.sleep(0.1 * (tries - left))
    raise ValueError(f"the member at {offset} has another checksum")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 8 << 20))
        self.most = int(options.get("most_partitions", 100_000))
        self.rows, self.bytes = int(options.get("batch_rows", 500)), int(options.get("batch_bytes", 8 << 20))

    def partitions(self) -> list[ByteRanges]:
        """Ranges of about ``split_bytes``, or of more where there would be over ``most_partitions``."""
        system, path = files.at(f"{self.path}/manifest")
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
        found = pa.concat_tables([pq.read_table(name, filesystem=system) for name in names]) if names else None
        if found is None or not found.num_rows:
            return []
        split = max(self.split, -(-pa.compute.sum(found["dir_start"]).as_py() // self.most))
        out: list[ByteRanges] = []
        held: list[ByteRange] = []
        size = 0
        for archive, dir_start, dir_bytes in zip(*(found[c].to_pylist() for c in ("archive", "dir_start", "dir_bytes")), strict=True):
            for k in range(0, dir_start, split):
                held.append(ByteRange(archive, k, min(k + split, dir_start), dir_start, dir_bytes))
                size += held[-1].end - k
                if 2 * size > split:
                    out.append(ByteRanges(held))
                    held, size = [], 0
        return out + ([ByteRanges(held)] if held else [])

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if partition is not None else ():  # None: no archives
            yield from self._read(part)

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        members = [m for m in directory(files.read(partition.archive, partition.dir_start, partition.dir_bytes)) if partition.start <= m[0] < partition.end]
        system, path = files.at(partition.archive)
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=names)

        with system.open_input_file(path) as source:
            for offset, n, crc, name in members:
                stem = name.removesuffix(".png")
                held.append((int(stem) if stem != "None" else None, offset, read_member(source, offset, n, crc)))
                size += n
                if len(held) >= self.rows or size >= self.bytes:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(path)``: the members of all archives under a path."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(samples: np.ndarray) -> str:
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    return f"mean={mean:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};zeros={int(counts[0])};distinct={len(share)}"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored images."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for doc_id, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples, n_bytes = from_png(image)
                data = samples.tobytes()
                rows.append((doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), _feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return media.select("doc_id", "media").mapInArrow(tidied(run), FEATURES)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text), read the archives back, compute features.

    A null text counts as empty, whose payload is 64 zero bytes. A null doc_id stays null; repeated
    rows stay; an empty table gives no rows; other columns are ignored. Equal texts have equal
    values, for the image depends on the text alone.
    """
    spark = docs.sparkSession
    path = new_path(spark, "media")
    write_archives(docs, path)
    spark.dataSource.register(ArchiveSource)
    return features(spark.read.format("media_archive").load(path))
