"""Passages that repeat across documents, found through a count-min sketch.

Every run of ``window`` words has a fingerprint made of its words' hashes. First pass: a task sketches
the windows it reads; its sketch is sparse, the cells of each block that it met once and more often,
and blocks are merged by a shuffle. What remains is a bit for each cell that was met twice, at least.
Second pass: windows whose cells all have that bit, which every repeated window has, are grouped
exactly by 96 bits of their fingerprint. A window within a batch that a smaller document of the batch
also has is settled there, so a common passage sends one entry for each batch, and entries are dealt by
fingerprint. Nothing repeated is lost; cells that unlike windows share only cost entries.

The sketch has ``cells`` for each word up to ``most_bits`` cells a row, so that its bits, which every
worker holds, are bounded. Beyond ``most_bits`` / ``cells`` words it fills up and passes more windows on;
results stay the same and the work grows in proportion to the input still.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, tidied

#: Odd multipliers by which a window's words count, one for each half of the fingerprint; a last mix.
STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Rows without an id are greater than all others.
NO_ID = 2**63 - 1
BLOCK_BITS = 20


@dataclass(frozen=True)
class Params:
    """window: words. cells: of a sketch's row for each word. most_bits: log2 of a row's cells, at most.
    rows: of the sketch. words_at_once: of a batch. entries: words for each shard of the second pass,
    of which some are entries."""

    window: int = 13
    cells: int = 4
    most_bits: int = 29
    rows: int = 2
    words_at_once: int = 1_000_000
    entries: int = 2_000_000


class _Words(dict):
    """Numbers of words as they come, and their hashes by number; long words are hashed each time."""

    def __init__(self):
        self.high: list[int] = []
        self.low: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n, h = len(self.high), xxhash.xxh3_128_intdigest(word)
        self.high.append(h >> 64)
        self.low.append(h & 0xFFFFFFFFFFFFFFFF)
        if len(word) <= 48:
            self[word] = n
        return n


class Fingerprints:
    """Of all windows of texts, in one worker. Forgets its words when there are many."""

    def __init__(self, window: int, limit: int = 300_000):
        self.window, self.limit, self.words = window, limit, _Words()

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of each window's fingerprint, its text's number, and where it starts."""
        if len(self.words.high) > self.limit:
            self.words = _Words()
        size = np.array([len(t) for t in texts])
        number = np.concatenate([np.fromiter(map(self.words.__getitem__, t), np.int64, len(t)) for t in texts])
        count = np.maximum(size - self.window + 1, 0)
        text = np.repeat(np.arange(len(texts)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(size) - size, count) + at
        out = []
        for hashes, step in zip((self.words.high, self.words.low), STEP, strict=True):
            h = np.array(hashes, np.uint64)[number]
            n = len(h) - self.window + 1
            total = np.zeros(max(n, 0), np.uint64)
            for j in range(self.window if n > 0 else 0):
                total = total * step + h[j : j + n]
            total = total[start] if len(start) else np.zeros(0, np.uint64)
            total = (total ^ (total >> np.uint64(32))) * MIX
            out.append(total ^ (total >> np.uint64(29)))
        return out[0], out[1], text, at


def _texts(stream: Iterator[pa.RecordBatch], column: str, words: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[bytes]]]]:
    """Runs of rows of at least ``words`` words, but the last of a batch: the batch, rows, their words."""
    for batch in stream:
        rows, texts, n = [], [], 0
        for k, value in enumerate(batch.column(column)):
            text = (value.as_py() or "").encode().split()  # at ASCII white space, which is what lies between words
            rows.append(k)
            texts.append(text)
            n += len(text)
            if n >= words:
                yield batch, rows, texts
                rows, texts, n = [], [], 0
        if rows:
            yield batch, rows, texts


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers, compressed byte by byte: first bytes of all, second ones, and so on."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return len(columns[0]).to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, widths = int.from_bytes(data[:4], "little"), [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    cuts = np.split(planes, n * np.cumsum(widths)[:-1])
    return [np.ascontiguousarray(c.reshape(w, n).T).view(k).ravel() for c, w, k in zip(cuts, widths, kinds, strict=True)]


def gaps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending.astype(np.uint32), prepend=np.uint32(0)).astype(np.uint32)


def _met(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint32)[0], dtype=np.int64)


def _cells(high: np.ndarray, low: np.ndarray, bits: int, rows: int) -> list[np.ndarray]:
    """A window's cell in each row of the sketch."""
    return [((high + np.uint64(r) * low) >> np.uint64(64 - bits)).astype(np.int64) for r in range(rows)]


def sketches(docs: DataFrame, bits: int, p: Params) -> DataFrame:
    """Sparse sketches of batches: row, block, cells met once, cells met more often."""
    block = min(BLOCK_BITS, bits)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Fingerprints(p.window)
        for _, _, texts in _texts(stream, "text", p.words_at_once):
            high, low, _, _ = find(texts)
            out = []
            for r, cells in enumerate(_cells(high, low, bits, p.rows)):
                cell, n = np.unique(cells, return_counts=True)
                cuts = np.flatnonzero(np.diff(cell >> block)) + 1
                for c, m in zip(np.split(cell, cuts), np.split(n, cuts), strict=True):
                    if len(c):
                        own = c & ((1 << block) - 1)
                        out.append((r, int(c[0] >> block), pack(gaps(own[m == 1])), pack(gaps(own[m > 1]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "block", "once", "more"])

    return docs.select("text").mapInArrow(tidied(run), "row int, block int, once binary, more binary")


def merged(parts: DataFrame, bits: int, tasks: int) -> DataFrame:
    """The sketch: for each block, a bit for every cell that was met twice at least."""
    width = 1 << min(BLOCK_BITS, bits)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, None

        def done() -> pa.RecordBatch:
            packed = pa.compress(np.packbits(n > 1).tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary())], names=["row", "block", "bits"])

        for batch in stream:
            for row, block, once, more in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (row, block) != key:
                    if key is not None:
                        yield done()
                    key, n = (row, block), np.zeros(width, np.uint8)
                cells = _met(once)
                n[cells] = np.minimum(n[cells] + 1, 2)
                n[_met(more)] = 2
        if key is not None:
            yield done()

    dealt = parts.repartition(tasks, "row", "block").sortWithinPartitions("row", "block")
    return dealt.mapInArrow(tidied(run), "row int, block int, bits binary")


def _sketch(docs: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """The merged sketch as bits, and about how many words there are."""
    spark = docs.sparkSession
    # a word takes seven bytes with its space, about; the sketch's width needn't be exact
    words = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 7
    bits = int(min(p.most_bits, max(10, (p.cells * words - 1).bit_length())))
    block = min(BLOCK_BITS, bits)
    tasks = int(max(1, min(p.rows << (bits - block), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    table, _ = materialize(merged(sketches(docs, bits, p), bits, tasks), "sketch")
    out = np.zeros((p.rows, 1 << max(0, bits - 3)), np.uint8)
    size = (1 << block) >> 3
    for r in table.toLocalIterator():  # rows x 2**most_bits bits, at most
        out[r["row"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(pa.decompress(r["bits"], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return out, words


#: Of an entry: both parts of a fingerprint, the document's id and key, where the window starts.
ENTRY = (np.uint64, np.uint32, np.int64, np.int64, np.int32)
FOUND = "shard long, entries binary, settled binary"


def suspects(docs: DataFrame, sketch, bits: int, shards: int, p: Params) -> DataFrame:
    """Entries of windows that may be repeated, by shards of their fingerprints; and, by shards of their
    documents, windows that a smaller document of their own batch also has."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, heavy = Fingerprints(p.window), sketch.value
        for batch, rows, texts in _texts(stream, "text", p.words_at_once):
            high, low, text, at = find(texts)
            may = np.ones(len(high), bool)
            for r, c in enumerate(_cells(high, low, bits, p.rows)):
                may &= (heavy[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            may = np.flatnonzero(may)
            if not len(may):
                continue
            ids = np.array([NO_ID if x is None else x for x in batch.column("doc_id").take(pa.array(rows)).to_pylist()], np.int64)
            keys = np.array(batch.column("key").take(pa.array(rows)).to_pylist(), np.int64)
            high, low, text, at = high[may], (low[may] >> np.uint64(32)).astype(np.uint32), text[may], at[may].astype(np.int32)
            doc, key = ids[text], keys[text]
            later = _later(high, low, doc)
            out = []
            for chosen, by, settled in ((~later, high, False), (later, key.view(np.uint64) ^ doc.view(np.uint64), True)):
                k = np.flatnonzero(chosen)
                shard = (by[k] % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((at[k], key[k], doc[k], shard))
                k, shard = k[order], shard[order]
                for own in np.split(np.arange(len(k)), np.flatnonzero(np.diff(shard)) + 1):
                    if len(own):
                        j = k[own]
                        packed = pack(doc[j], key[j], at[j]) if settled else pack(high[j], low[j], doc[j], key[j], at[j])
                        out.append((int(shard[own[0]]), None if settled else packed, packed if settled else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "entries", "settled"])

    return docs.select("doc_id", "key", "text").mapInArrow(tidied(run), FOUND)


def _later(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows a smaller document among these also has."""
    order = np.lexsort((doc, low, high))
    a, b, d = high[order], low[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    out = np.zeros(len(high), bool)
    out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _settle(shards: int):
    """From all entries of a partition, windows to remove, by shards of their documents."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in stream:
            for shard, entries, settled in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if entries is not None:
                    held.append(unpack(entries, *ENTRY))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([settled], pa.binary())], names=["shard", "settled"])
        if not held:
            return
        high, low, doc, key, at = (np.concatenate(c) for c in zip(*held, strict=True))
        k = np.flatnonzero(_later(high, low, doc))
        shard = ((key[k].view(np.uint64) ^ doc[k].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((at[k], key[k], doc[k], shard))
        k, shard = k[order], shard[order]
        for own in np.split(np.arange(len(k)), np.flatnonzero(np.diff(shard)) + 1):
            if len(own):
                j = k[own]
                yield pa.RecordBatch.from_arrays([pa.array([shard[own[0]]], pa.int64()), pa.array([pack(doc[j], key[j], at[j])], pa.binary())], names=["shard", "settled"])

    return run


def _by_document(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of a partition's documents, a row for each document."""
    held = [unpack(x, *ENTRY[2:]) for batch in stream for x in batch.column(1).to_pylist()]
    if not held:
        return
    doc, key, at = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    first = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) + 1, len(doc)]
    for k in range(0, len(first) - 1, 5_000):
        own = first[k : k + 5_001]
        yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), pa.array(key[own[:-1]]), pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(at[own[0] : own[-1]]))], names=["doc", "key", "at"])


def repeated(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc, key, at: starts of windows that a document of a smaller id also has. ``docs``: doc_id, key, text."""
    spark = docs.sparkSession
    bits_table, words = _sketch(docs, p)
    bits = int(bits_table.shape[1] * 8).bit_length() - 1
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // p.entries))
    found = suspects(docs, spark.sparkContext.broadcast(bits_table), bits, shards, p)
    settled = found.repartition(shards, "shard").mapInArrow(tidied(_settle(shards)), "shard long, settled binary")
    return settled.repartition(shards, "shard").mapInArrow(tidied(_by_document), "doc long, key long, at array<int>")


def _key() -> Column:
    """Tells texts of one id apart: few bytes where ids are few to a value, more for rows without one."""
    h = F.xxhash64("text")
    return F.when(F.col("doc_id").isNull(), h).otherwise(F.pmod(h, F.lit(1 << 32)))


def deduplicate(df: DataFrame, p: Params = Params(), text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the kept words as ``text`` if asked for.

    ``df``: doc_id, text, whatever other columns. A null text has no words, and a text of fewer words
    than a window loses none. Rows without an id count as of the greatest id: they lose what any other
    has, and others lose nothing to them. Rows that repeat an id lose nothing to each other. An empty
    table gives an empty one.
    """
    docs = pick(df, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key().alias("key"))
    found = repeated(docs, p)
    keyed = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    joined = keyed.join(found, ["doc", "key"], "left").select("doc_id", "text", "at")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if text else [])]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for value, starts in zip(batch.column("text"), batch.column("at"), strict=True):
                words = (value.as_py() or "").encode().split()
                n = len(words)
                if starts.is_valid:
                    change = np.zeros(n + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(change, at, 1)  # equal rows give a window twice
                    np.add.at(change, at + p.window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if text else None))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns][: len(names)], names=names)

    return joined.mapInArrow(tidied(run), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if text else ""))
