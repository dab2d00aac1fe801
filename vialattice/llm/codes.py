"""Vector compression: product codes by Lloyd's iteration that is maintained by changes.

Vectors become integers and are cut into equal parts; each position has a codebook of its own. A
round's table in the shared folder holds, for each vector, its parts and their present entries.
A round reads it once: every task assigns its parts anew, writes them with the new entries, and adds
up plus and minus contributions of those parts alone whose entry changed. These few sums, at most one
for each entry and batch of rows, are all that is shuffled; added to the running sums of the round
before, they give the next codebooks exactly. A round without changes ends the iteration, since all
later rounds would repeat it.

What the driver holds is the codebooks and running sums: parts x entries x width numbers, at any size
of the table. Running sums are written beside the rounds, so that a round depends on tables only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import drop_path, materialize, pick, tidied

#: Larger components count as this one, so that a squared distance fits 64 bits.
BOUND = 1 << 26
#: Below this, products of parts are exact in double precision.
EXACT = 1 << 21
STATE = "vec_id long, label long, x array<int>, codes binary, delta array<struct<part:int,entry:int,n:long,s:array<long>>>"


@dataclass(frozen=True)
class Params:
    """scale: of a component before its floor. parts: of a vector. entries: of a codebook, 256 at most.
    rounds: of assignment and update. salts: over which rows of a label are dealt for its sum."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    salts: int = 32

    def __post_init__(self):
        if not 1 <= self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("entries: 1 to 256, parts: 1 at least, rounds: 0 at least")


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each entry, exact integers."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < EXACT and x.shape[1] <= 512:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book.astype(np.int64)], axis=1)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part of each row, the lowest of equals, and its squared distance."""
    near = [distances(x[:, p], book) for p, book in enumerate(books)]
    codes = np.stack([d.argmin(axis=1) for d in near], axis=1).astype(np.uint8)
    return codes, np.stack([d[np.arange(len(x)), codes[:, p]] for p, d in enumerate(near)], axis=1)


def contributions(x: np.ndarray, before: np.ndarray | None, now: np.ndarray, entries: int) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, count, sums) that parts whose entry changed add to the new one and take from the old."""
    out = []
    for p in range(x.shape[1]):
        changed = np.flatnonzero(now[:, p] != before[:, p]) if before is not None else np.arange(len(x))
        if not len(changed):
            continue
        n, s = np.zeros(entries, np.int64), np.zeros((entries, x.shape[2]), np.int64)
        for sign, codes in ((1, now), (-1, before)):
            if codes is not None:
                np.add.at(n, codes[changed, p], sign)
                np.add.at(s, codes[changed, p], sign * x[changed, p])
        # an entry that gains as many as it loses may still have other sums
        out += [(p, int(e), int(n[e]), s[e].tolist()) for e in np.flatnonzero((n != 0) | s.any(axis=1))]
    return out


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, -1)


def _round(state: DataFrame, books: np.ndarray, first: bool) -> DataFrame:
    """The state after one assignment, with a row of contributions after each batch that has some."""
    kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))
    names = ["vec_id", "label", "x", "codes", "delta"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if not batch.num_rows:
                continue
            x = _parts(batch, len(books))
            before = None if first else np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            now, _ = assign(x, books)
            coded = pa.array([row.tobytes() for row in now], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), coded, pa.nulls(len(x), kind)], names=names)
            if moved := contributions(x, before, now, books.shape[1]):
                moved = [dict(zip(("part", "entry", "n", "s"), row, strict=True)) for row in moved]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field("vec_id").type), pa.nulls(1, batch.schema.field("label").type), pa.nulls(1, batch.schema.field("x").type), pa.nulls(1, pa.binary()), pa.array([moved], kind)], names=names)

    return state.mapInArrow(tidied(run), STATE)


def _least(kept: DataFrame, count: int) -> list[Row]:
    """The vectors of the least distinct ids, and of rows that repeat an id the least vector."""
    ids: list[int] = []
    while len(ids) < count:
        rest = kept.where("vec_id is not null") if not ids else kept.where(F.col("vec_id") > ids[-1])
        found = [r[0] for r in rest.select("vec_id").orderBy("vec_id").limit(count - len(ids)).collect()]
        if not found:
            break
        ids += sorted(set(found))
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    if len(rows) < count:  # rows without an id come after all others
        rows += kept.where("vec_id is null").select("vec_id", "x").distinct().orderBy("x").limit(count - len(rows)).collect()
    return rows


def integers(df: DataFrame, p: Params) -> DataFrame:
    """vec_id, label, x: the rows that count, their components as bounded integers.

    A vector counts if it isn't null, has no null or non-finite component, and its length is a positive
    multiple of ``parts``.
    """
    rows = pick(df, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.col("e").isNotNull() & (F.size("e") > 0) & (F.size("e") % p.parts == 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * p.scale, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))
    return rows.where(good).select("vec_id", "label", whole.alias("x"))


def compress(df: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that counts.

    ``df``: vec_id, label, embedding, whatever other columns. Null vectors and such with a null or
    non-finite component are left out; so are empty ones, and ones of another length than that of the
    least id, which have no parts to compare. Components beyond 2**26 after scaling count as that
    bound. With fewer ids than entries, codebooks are shorter. Rows that repeat an id are coded one by
    one, and the least vector of an id may start an entry; null ids start entries only after all
    others. Null labels share one sum. An empty table gives an empty one.
    """
    spark = df.sparkSession
    kept = integers(df, p)
    start = _least(kept, p.entries)
    if not start:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    size = len(start[0]["x"])
    start = [r for r in start if len(r["x"]) == size]
    books = np.array([r["x"] for r in start], np.int64).reshape(len(start), p.parts, -1).transpose(1, 0, 2)
    state, path = kept.where(F.size("x") == size), None
    sums, sums_path = None, None
    for k in range(p.rounds):
        state, now = materialize(_round(state, books, k == 0), "codes")
        if path:
            drop_path(spark, path)
        path = now
        moved = state.where("delta is not null").select(F.explode("delta").alias("d")).select("d.part", "d.entry", "d.n", F.posexplode("d.s").alias("at", "s"))
        state = state.where("delta is null")
        exact = "decimal(38,0)"
        moved = moved.select("part", "entry", "at", F.col("n").cast(exact).alias("n"), F.col("s").cast(exact).alias("s"))
        every = moved if sums is None else moved.unionByName(sums)
        sums, now = materialize(every.groupBy("part", "entry", "at").agg(F.sum("n").cast(exact).alias("n"), F.sum("s").cast(exact).alias("s")), "sums")
        if sums_path:
            drop_path(spark, sums_path)
        sums_path = now
        after = books.copy()
        for r in sums.collect():  # parts x entries x width rows
            if r["n"]:
                after[r["part"], r["entry"], r["at"]] = int(r["s"]) // int(r["n"])
        if (after == books).all():
            break
        books = after
    if sums_path:
        drop_path(spark, sums_path)
    out = _coded(state, books, p)
    if path:
        drop_path(spark, path)
    return out


def _coded(state: DataFrame, books: np.ndarray, p: Params) -> DataFrame:
    """The last assignment, and its errors summed by label."""
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                codes, near = assign(_parts(batch, len(books)), books)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes]), pa.array(near.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    coded, _ = materialize(state.select("vec_id", "label", "x").mapInArrow(tidied(run), "vec_id long, label long, code string, error long"), "coded")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    # a label's rows are dealt over salts, each of which gets the label's sum; nulls together as a label of their own
    keyed = lambda rows: rows.select("*", F.coalesce("label", F.lit(0)).alias("key"), F.col("label").isNull().alias("none"))
    dealt = keyed(coded).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(p.salts)).cast("int"))
    every = keyed(total).drop("label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
    return dealt.join(every, ["key", "none", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
