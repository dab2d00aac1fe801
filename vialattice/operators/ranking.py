"""Orders, samples, batches and similarity matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A multiplicative hash whose products stay within 64 bits, the same in any engine.
FACTORS, MODULUS = (7919, 104729, 1299709), 1_000_003


def drawn(*keys: Column, seed: int = 42) -> Column:
    """A reproducible draw in 0..MODULUS-1 from integer keys."""
    total = F.lit(seed * FACTORS[2]).cast("long")
    for k, key in enumerate(keys):
        total = total + F.pmod(key.cast("long"), F.lit(MODULUS)) * FACTORS[k % len(FACTORS)]
    return F.pmod(total, F.lit(MODULUS))


def sampled(rows: DataFrame, keys: list[str], item: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each key, drawn by a hash of ``item`` (L5); the same whatever the order of rows.

    Items are cut down within each key as they arrive (a top-k per key), so no task holds a key's all.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(drawn(F.col(item), seed=seed), item))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def top(rows: DataFrame, value: str, tie: list[str], k: int = 30) -> DataFrame:
    """The k rows of highest value (L3); the limit is the feature, and each task keeps only its own k."""
    return rows.orderBy(F.round(value, 9).desc(), *tie).limit(k)


def numbered_labels(rows: DataFrame, label: str, order: list[Column | str]) -> DataFrame:
    """Labels with a running number among equal ones (W11), for rows that are few by definition."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("display", F.concat(F.col(label), F.lit(" #"), n.cast("string")))


def lowest_by_role(rows: DataFrame, role: Column, value: str, tie: list[str], roles: tuple[str, ...] = ("Leftmost", "Rightmost", "Middle", "Merge")) -> DataFrame:
    """Of each wanted role, the lane of the lowest value (L7); labels count by how they begin."""
    of = F.coalesce(*(F.when(F.startswith(role, F.lit(r)), F.lit(r)) for r in roles))
    best = F.min(F.struct(F.round(value, 9).alias("v"), *tie, F.col(value).alias("value")))
    found = rows.withColumn("role", of).where("role is not null").groupBy("role").agg(best.alias("b"))
    return found.select("role", *(F.col(f"b.{t}").alias(t) for t in tie), F.col("b.value").alias(value))


def places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's place from 0 in the order of ``keys``, of which the first names a part of bounded size.

    Parts are numbered within themselves and moved by the rows of the parts before; only the parts'
    counts, a row each, meet in one task.
    """
    part = keys[0]
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*keys[1:])) - 1
    return rows.join(counts.select(part, before.alias("_before")), part).withColumn("place", F.col("_before") + inside).drop("_before")


def similarity_blocks(index: DataFrame, keys: list[str]) -> DataFrame:
    """The similarity matrix of each camera's lanes, rows and columns in the order of ``keys``.

    ``index``: lane, camera, e and the keys. A camera's lanes are few, so blocks are of bounded size.
    """
    from ..functions import vectors as v

    placed = index.withColumn("place", F.row_number().over(Window.partitionBy("camera").orderBy(*keys)) - 1)
    a = placed.select("camera", F.col("place").alias("i"), F.col("lane").alias("lane_i"), F.col("e").alias("ea"))
    b = placed.select("camera", F.col("place").alias("j"), F.col("lane").alias("lane_j"), F.col("e").alias("eb"))
    return a.join(b, "camera").select("camera", "i", "j", "lane_i", "lane_j", v.dot(F.col("ea"), F.col("eb")).alias("sim"))


def camera_similarity(index: DataFrame) -> DataFrame:
    """Mean similarity between the lanes of each two cameras (the matrix' blocks outside the diagonal, J19).

    The mean of dot products is the dot product of means: a vector for each camera, no pair of lanes.
    """
    from ..functions import vectors as v

    means = index.select("camera", F.posexplode("e").alias("k", "x")).groupBy("camera", "k").agg(F.avg("x").alias("x"))
    mean = means.groupBy("camera").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("m"))
    a, b = mean.select(F.col("camera").alias("camera_i"), F.col("m").alias("mi")), mean.select(F.col("camera").alias("camera_j"), F.col("m").alias("mj"))
    return a.join(b, F.col("camera_i") < F.col("camera_j")).select("camera_i", "camera_j", v.dot(F.col("mi"), F.col("mj")).alias("sim"))


def group_batches(lanes: DataFrame, keys: list[str], batch_size: int, shard_groups: int = 1000, seed: int = 42) -> DataFrame:
    """Whole groups packed into batches, in a drawn order; a group that doesn't fit begins the next one.

    ``keys``: of a group, the last one an integer. Groups are dealt over shards of about
    ``shard_groups``, and each shard fills its own batches, so none holds an unbounded list. Returns
    keys, shard, batch.
    """
    sizes = lanes.groupBy(*keys).agg(F.count("*").alias("n"))
    n = F.broadcast(sizes.agg(F.greatest(F.ceil(F.count("*") / shard_groups), F.lit(1)).alias("shards")))  # one row
    draw = drawn(F.col(keys[-1]), seed=seed)
    rows = sizes.crossJoin(n).withColumn("shard", F.pmod(draw, F.col("shards")))
    item = F.struct(draw.alias("o"), *keys, "n")
    lists = rows.groupBy("shard").agg(F.array_sort(F.collect_list(item)).alias("all"))
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"))
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("batches"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["at"]["held"] > 0) & (acc["at"]["held"] + x["n"] > batch_size)
        batch = acc["at"]["batch"] + full.cast("long")
        held = F.when(full, x["n"]).otherwise(acc["at"]["held"] + x["n"])
        return F.struct(F.struct(batch.alias("batch"), held.alias("held")).alias("at"), F.concat(acc["batches"], F.array(batch)).alias("batches"))

    packed = lists.select("shard", F.explode(F.arrays_zip("all", F.aggregate("all", start, step)["batches"].alias("batch"))).alias("z"))
    return packed.select(*(F.col(f"z.all.{k}").alias(k) for k in keys), "shard", F.col("z.batch").alias("batch"))


def padded(rows: DataFrame, key: str, items: str, zero: Column, most: int) -> DataFrame:
    """Arrays filled up to ``most`` items, and which of these are real (L11); longer ones are an error."""
    rows, n = rows.withColumn("_n", F.size(items)), F.col("_n")  # a name in a lambda would mean the select's own
    checked = F.when(n <= most, n).otherwise(F.raise_error(F.concat(F.lit("more items than "), F.lit(most)))).cast("int")
    return rows.select(key, F.concat(items, F.array_repeat(zero, F.lit(most) - checked)).alias(items), F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: k <= n).alias("mask"))


def pooled(rows: DataFrame, keys: list[str], valid: Column, vector: str) -> DataFrame:
    """Mean vector over each key's valid rows, zeros without any (A25): keys, n_valid, mean."""
    parts = rows.select(*keys, valid.cast("int").alias("_v"), F.posexplode(vector).alias("k", "x"))
    mean = parts.groupBy(*keys, "k").agg(F.coalesce(F.avg(F.when(F.col("_v") == 1, F.col("x"))), F.lit(0.0)).alias("x"), F.sum("_v").alias("n_valid"))
    return mean.groupBy(*keys).agg(F.max("n_valid").alias("n_valid"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("mean"))


def oracle_features(rows: DataFrame, stats: list[Column | str], role: list[Column | str]) -> DataFrame:
    """Statistics and role side by side, to unit length."""
    from ..functions import vectors as v

    both = F.array(*(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0)) for c in [*stats, *role]))
    return rows.withColumn("_f", both).withColumn("features", F.transform("_f", lambda x: x / (v.norm(F.col("_f")) + 1e-8))).drop("_f")
