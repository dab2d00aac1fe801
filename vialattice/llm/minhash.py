"""Near-duplicate texts: MinHash bands propose pairs, odd sketches sieve them, full sets decide.

Equal shingle sets form a class, and everything after works on one representative of each class, so
that thousands of copies count once. Pairs whose odd sketches are too far apart for the similarity
asked are dropped, and the rest are confirmed on the full shingle sets.

In turns, each band bucket proposes its members against one leader, another one each turn, and only
across components found so far. So the members of a large family join its component after a few
turns, with a number of pairs in proportion to the members. What is then still apart in one bucket
is compared exhaustively: first by sketches, then members with a partner in reach by full sets. So
no link is lost, and full sets move only for documents that share a bucket with another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, drop_path, grouped, materialize, pick, spread, tidied
from .graph import components

MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Params:
    """words: of a shingle. percent: least similarity. bands x rows: MinHash values. sketch_bits:
    of an odd sketch. slack: standard errors of the sketch's estimate that a true pair may lack.
    turns: most turns with leaders. tries: most leaders that a document meets in a turn; what they
    leave apart is compared exhaustively after, in blocks of at most ``at_once`` documents and
    ``codes_at_once`` shingles."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    slack: float = 4.5
    turns: int = 1
    tries: int = 3
    at_once: int = 512
    codes_at_once: int = 2_000_000

    @property
    def most_apart(self) -> int:
        """Differing sketch bits beyond which a pair is below the similarity asked."""
        k, m, j = self.bands * self.rows, self.sketch_bits, self.percent / 100
        flips = 2 * k * (1 - j)
        mean = m / 2 * (1 - (1 - 2 / m) ** flips)
        slope = (1 - 2 / m) ** flips  # bits that one more flip changes
        var = slope**2 * 4 * k * j * (1 - j) + m / 4 * (1 - (1 - 2 / m) ** (2 * flips))
        return math.ceil(mean + self.slack * math.sqrt(var))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * MIX[0] + np.uint64(seed)) | np.uint64(1)


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes. Words are bytes between ASCII white space."""

    def __init__(self, words: int, limit: int = 100_000):
        self.words, self.limit, self.known = words, limit, {}
        self.weights = _constants(words, 7)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = self.words
        if len(codes) < n:
            return _mix((codes * _constants(n, 11 + len(codes))[: len(codes)]).sum(keepdims=True))
        return np.unique(_mix(reduce(np.add, (codes[k : len(codes) - n + 1 + k] * self.weights[k] for k in range(n)))))


def _signature(codes: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch (as 64-bit words) of a set."""
    k = p.bands * p.rows
    factor, shift = _constants(k, 101)[:, None], _constants(k, 202)[:, None]
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 2048):
        np.minimum(least, (codes[None, at : at + 2048] * factor + shift).min(axis=1), out=least)
    bands = _mix((least.reshape(p.bands, p.rows) * _constants(p.rows, 303)).sum(axis=1) + _constants(p.bands, 404))
    places = _mix(least + _constants(k, 505)) % np.uint64(p.sketch_bits)
    parity = np.bincount(places.astype(np.int64), minlength=p.sketch_bits) & 1
    return bands, np.packbits(parity.astype(np.uint8)).view(np.uint64)


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def sign(docs: DataFrame, p: Params) -> DataFrame:
    """Number of shingles, a 128-bit key of the set, band keys and odd sketch of every row."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(p.words)
        for batch in batches(stream, 1000):
            count, h1, h2, bands, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                codes = shingles(text)
                key = _key(codes)
                count.append(len(codes))
                h1.append(key[0])
                h2.append(key[1])
                b, s = _signature(codes, p) if len(codes) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                bands.append(b.view(np.int64))
                sketches.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (count, h1, h2)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, sketches))], names=[c.split()[0] for c in SIGNED.split(", ")])

    return pick(docs, "doc_id", "text").mapInArrow(tidied(run), SIGNED)


def _key(codes: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set."""
    key = xxhash.xxh3_128_intdigest(codes.tobytes())
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def shingle_sets(docs: DataFrame, wanted: DataFrame, p: Params) -> DataFrame:
    """(id, codes) of the classes wanted (id, rep, h1, h2), from a row of the representative that has the key.

    The texts are shuffled once whatever the number wanted; no plan here depends on the tables' size.
    """
    texts = pick(docs, "doc_id", "text").join(wanted.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")
    texts = texts.dropDuplicates(["doc_id", "id", "text"]).select("id", "h1", "h2", "text")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(p.words)
        for batch in batches(stream, 500):
            ids, h1, h2, given = (c.to_pylist() for c in batch.columns)
            sets = map(shingles, given)
            found = [(i, codes.view(np.int64)) for i, *key, codes in zip(ids, h1, h2, sets, strict=True) if _key(codes) == tuple(key)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["id", "codes"])

    return texts.mapInArrow(tidied(run), "id long, codes array<long>")


def _apart(a: str, b: str, words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(words)))


def _likely(pairs: DataFrame, p: Params) -> DataFrame:
    """Pairs that sizes and odd sketches allow."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return pairs.where((small * 100 >= large * p.percent) & (_apart("sketch_a", "sketch_b", p.sketch_bits // 64) <= p.most_apart))


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as asked."""
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("codes").alias("codes_b")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("codes").alias("codes_a")), "a")
        .where(both * 100 >= (F.size("codes_a") + F.size("codes_b") - both) * p.percent)
        .select("a", "b")
    )


def _overlaps(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k]."""
    flat = np.concatenate(codes)
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    values, which, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1  # codes of one set alone are in no intersection
    width = -(-max(1, int(place[-1]) + 1) // 64)
    if len(a) < 200:
        return np.fromiter((len(np.intersect1d(codes[x], codes[y], assume_unique=True)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    use = count[which] > 1
    owner, at = owner[use], place[which[use]]
    both = np.zeros(len(a), np.int64)
    wide = max(1, 2_000_000 // len(codes))  # words of a bitmap in memory at once
    for first in range(0, width, wide):
        here = (at // 64 >= first) & (at // 64 < first + wide)
        bits = np.zeros((len(codes), min(wide, width - first)), np.uint64)
        np.bitwise_or.at(bits, (owner[here], at[here] // 64 - first), np.uint64(1) << (at[here] % 64).astype(np.uint64))
        step = max(1, 1_000_000 // bits.shape[1])
        for k in range(0, len(a), step):
            both[k : k + step] += np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return both


SALTS = 32

MEMBER = ("bucket", "i", "j", "block", "band", "id", "component", "n", "bands", "sketch")


def _within_reach(t: pa.Table, p: Params) -> np.ndarray:
    """Pairs of one bucket's members that sizes and sketches allow.

    Pairs of one component and pairs that an earlier band has too are left out.
    """
    component, size, band = (t[c].to_numpy() for c in ("component", "n", "band"))
    bands, sketches = (t[c].combine_chunks().flatten().to_numpy().reshape(len(size), -1) for c in ("bands", "sketch"))
    sketches, part = sketches.view(np.uint64), t["block"].to_numpy() != t["i"].to_numpy()
    pair = np.triu(component[:, None] != component[None, :], 1)
    if part.any():
        pair &= part[:, None] != part[None, :]
    pair &= np.minimum(size[:, None], size[None, :]) * 100 >= np.maximum(size[:, None], size[None, :]) * p.percent
    apart = np.zeros(pair.shape, np.uint16)
    for word in sketches.T:
        apart += np.bitwise_count(word[:, None] ^ word[None, :])
    pair &= apart <= p.most_apart
    for earlier in bands.T[: band[0]]:
        pair &= earlier[:, None] != earlier[None, :]
    return pair


def _compare(t: pa.Table, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's members: (class, least class that it hangs on through links found here)."""
    ids, size = t["id"].to_numpy(), t["n"].to_numpy()
    a, b = np.nonzero(_within_reach(t, p))
    if not len(a):
        return ids[:0], ids[:0]
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    flat = t["codes"].combine_chunks()
    codes = [flat[int(k)].values.to_numpy() for k in used]
    both = _overlaps(codes, where[: len(a)], where[len(a) :])
    good = both * 100 >= (size[a] + size[b] - both) * p.percent
    near = np.zeros((len(ids), len(ids)), bool)
    near[a[good], b[good]] = near[b[good], a[good]] = True
    linked = np.flatnonzero(near.any(axis=1))
    return ids[linked], ids[spread(near)[linked]]


def _exhaust(live: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) that connect what is linked across components within a bucket."""
    info = classes.select("id", F.col("n_shingles").alias("n"), "bands", "sketch")
    placed = live.join(info, "id")
    blocks = F.ceil(F.greatest(F.count("*") / (p.at_once // 2), F.sum("n") / (p.codes_at_once // 2)))
    split = live.join(info.select("id", "n"), "id").groupBy("bucket").agg(blocks.cast("int").alias("n_blocks"))
    # only large buckets are split, and their members are dealt over salts to learn of it
    split = split.where("n_blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id", "bucket"), F.lit(SALTS)).cast("int")).join(split, ["bucket", "salt"], "left")
    placed = placed.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).select(*MEMBER)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")

    def sieve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(stream, (0, 1, 2)):
            pair = _within_reach(t, p)
            keep = np.flatnonzero(pair.any(axis=0) | pair.any(axis=1))
            if len(keep):
                yield from t.take(pa.array(keep)).combine_chunks().to_batches()

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(stream, (0, 1, 2)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _compare(t, p)], names=["a", "b"])

    suspects = dealt(placed).mapInArrow(tidied(sieve), placed.schema)
    return dealt(suspects.join(sets, "id").select(*MEMBER, "codes")).mapInArrow(tidied(compare), "a long, b long")


def near_duplicates(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """Link ``docs`` (doc_id, text) of similar shingle sets and name each row's component.

    Returns doc_id, n_shingles, component_id, kept for each row. A text without words (null, empty,
    only white space) has no shingles and is its own component, whatever the id's other rows have. Rows with a null doc_id link with
    nothing and are kept, with a null component. Rows that repeat a doc_id are one vertex: what is
    linked with any of their texts is linked with all. Other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    p = p or Params()
    spark = docs.sparkSession
    used: list[str] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        df, path = materialize(df, tag)
        used.append(path)
        return df

    signed = kept(sign(docs, p), "signed")
    key = ["n_shingles", "h1", "h2"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = kept(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so an id stays with its class
    info = classes.select("id", F.col("n_shingles").alias("n"), "sketch")
    of = {s: info.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab"}
    members = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = members.join(shared, "bucket", "left_semi").select("bucket", "band", "id", F.col("id").alias("component"))
    live, path = materialize(live, "live")
    wanted = classes.join(live.select("id").distinct(), "id", "left_semi").select("id", "rep", "h1", "h2")
    sets = kept(shingle_sets(docs, wanted, p), "sets")
    found = spark.createDataFrame([], "id long, component long")
    for turn in range(p.turns):
        order = F.xxhash64(F.lit(turn), "id")
        leader = live.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("lead"), F.col("component").alias("c"))).alias("l")).select("bucket", "l.lead", "l.c")
        met = live.join(leader, "bucket").where("component <> c").groupBy("id").agg(F.collect_set("lead").alias("leads"))  # at most one of each band
        tried = F.slice(F.array_sort(F.transform("leads", lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("o"), x.alias("lead")))), 1, p.tries)
        pairs = met.select("id", F.explode(tried).alias("t")).select(F.least("id", "t.lead").alias("a"), F.greatest("id", "t.lead").alias("b")).distinct()
        pairs = kept(_likely(pairs.join(of["b"], "b").join(of["a"], "a"), p).select("a", "b"), "pairs")
        links = kept(_confirm(pairs, sets, p), "links")
        if not links.limit(1).count():
            break
        found = kept(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)), "found")
        placed = live.drop("component").join(found, "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
        (live, path), old = materialize(placed.join(mixed, "bucket", "left_semi"), "live"), path
        drop_path(spark, old)

    more = kept(_exhaust(live, classes, sets, p), "more")

    stars_of = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    # an id with several sets joins their classes
    several = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = signed.select("doc_id", *key).join(several, "doc_id", "left_semi").join(classes.select(*key, "id"), key).select("doc_id", "id")
    several = several.join(several.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select(F.col("id").alias("a"), "b")
    final = kept(components(stars_of.unionByName(more).unionByName(several)), "final")
    # classes are numbered without regard to documents: a component is named by its least document
    named = classes.select("id", "rep").join(final, "id")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("name")), "component").select("id", "name")
    labels = classes.select(*key, "id", "rep").join(named, "id", "left").select(*key, F.coalesce("name", "rep").alias("component"))
    out = signed.select("doc_id", *key).join(labels, key, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
    out, _ = materialize(out, "near-duplicates")
    for path in [path, *used]:
        drop_path(spark, path)
    return out
