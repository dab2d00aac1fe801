"""Collocations: phrases whose words occur together more often than their parts would suggest.

Texts are cut into pieces at marks and pieces into words; equal pieces are counted first. All runs of
one to ``words`` words become rows, which are counted by language with partial aggregation before the
shuffle, so common phrases travel once for each task. Counts of at least ``least`` are kept, as every
part of a candidate occurs as often as the candidate at least, and those of all single words, which
add up to a language's size. Each cut of a candidate into two parts is joined with the counts of both;
scores are exact decimals. A candidate that lives mostly inside a longer one is dropped by an anti-join
with the one-word extensions: a longer phrase that holds it is no more frequent than the extension
within that phrase, so these suffice.

Parts that very many candidates share are dealt over salts in the joins, and the first ranks are
found within salts before they meet for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_path, materialize, pick

#: Between pieces, and what becomes lower case.
MARKS, UPPER, LOWER = ".,;:!?\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark's switch that removes a query's shuffle files at its end, instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Params:
    """words: of a phrase, at most. least: count of a candidate. percent: of a candidate's count that a
    longer one may not reach. top: ranks for each language. hot: a part that more than one in ``hot`` cuts
    share is dealt over ``salts``."""

    words: int = 3
    least: int = 10
    percent: int = 50
    top: int = 2000
    hot: int = 500
    salts: int = 64

    def __post_init__(self):
        if self.words < 2 or self.least < 1:
            raise ValueError("words: 2 at least, least: 1 at least")


def pieces(df: DataFrame) -> DataFrame:
    """lang, piece, times: the pieces that have words, set apart by single spaces. Equal ones are one row: copied texts and lines count once."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER + MARKS + "\t", LOWER + "\n" * len(MARKS) + " ")
    rows = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "\n")).alias("piece"))
    return rows.select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("times"))


def counts(pieces: DataFrame, lengths: range) -> DataFrame:
    """lang, phrase, f: occurrences of phrases of these numbers of words.

    They are counted by one string, the phrase and behind a tab, which no word has, its language.
    """
    most, n = lengths[-1], F.size("w")
    rest = [F.when(n > k, F.slice("w", k + 1, F.greatest(n - k, F.lit(1)))).otherwise(F.array().cast("array<string>")) for k in range(1, most)]
    words = pieces.select("lang", F.split("piece", " +").alias("w"), "times")
    runs = words.select("lang", "times", F.inline(F.arrays_zip(F.col("w").alias("w0"), *(r.alias(f"w{k}") for k, r in enumerate(rest, 1)))).alias(*(f"w{k}" for k in range(most))))
    # a row for every length; beyond the piece's end words are null, and so is the phrase
    phrase = [F.concat(*(x for j in range(k) for x in ((F.lit(" "), F.col(f"w{j}")) if j else (F.col("w0"),))), F.lit("\t"), F.col("lang")) for k in lengths]
    rows = runs.select("times", F.explode(F.array(*phrase)).alias("key")).where("key is not null")
    tab = F.instr("key", "\t")
    return rows.groupBy("key").agg(F.sum("times").alias("f")).select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"), F.substring("key", F.lit(1), tab - 1).alias("phrase"), "f")


def _counted(df: DataFrame, p: Params) -> DataFrame:
    """lang, phrase, f, size: single words, and frequent phrases. The longest phrases, which are most of the
    rows, are counted after the others, and a step's shuffle goes when its table is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        some, path = materialize(pieces(df), "pieces")
        out = None
        for lengths in (range(1, p.words), range(p.words, p.words + 1)):
            found = counts(some, lengths).withColumn("size", F.size(F.split("phrase", " ")))
            found, _ = materialize(found.where((F.col("f") >= p.least) | (F.col("size") == 1)), "phrases")
            out = found if out is None else out.unionByName(found)
        drop_path(spark, path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return out


def _dealt(cuts: DataFrame, known: DataFrame, part: str, value: str, hot: DataFrame, p: Params) -> DataFrame:
    """``cuts`` with the count of a part; parts that very many cuts share are dealt over salts on both sides."""
    hot = F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.lit(p.salts).alias("many")))
    salt = F.pmod(F.xxhash64("phrase", "k"), F.coalesce("many", F.lit(1))).cast("int")
    left = cuts.join(hot, ["lang", part], "left").withColumn("salt", salt).drop("many")
    right = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(value)).join(hot, ["lang", part], "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1))).drop("many")
    return left.join(right, ["lang", part, "salt"]).drop("salt")


def _hot(cuts: DataFrame, p: Params) -> DataFrame:
    """Parts that more than one in ``hot`` cuts share: fewer than twice ``hot`` rows at any size."""
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("uses"))
    limit = cuts.agg((F.count("*") / p.hot).alias("limit"))
    return parts.crossJoin(F.broadcast(limit)).where("uses > limit").select("lang", "phrase")  # one row on the right


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), by exact integer division; at most a million, as a part is no rarer than the whole."""
    d = "cast({} as decimal(15,0))".format
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {d(a)} * {d(a)}) div ({d(l)} * {d(r)})")


def collocations(df: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    ``df``: text, lang, whatever other columns. Null texts count as empty, null languages as ``und``.
    Equal scores are ordered by count, then by the phrase's bytes. Rows that repeat count each time. An
    empty table, or one without candidates, gives an empty one.
    """
    every = _counted(pick(df, "lang", "text"), p)
    known = every.where(F.col("f") >= p.least)
    candidates = known.where("size > 1")
    words = F.split("phrase", " ")
    joined = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "size", k.alias("k")).select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    hot, _ = materialize(_hot(cuts, p), "hot-parts")
    cuts = _dealt(_dealt(cuts, known, "left", "l", hot, p), known, "right", "r", hot, p)
    scored = cuts.select("lang", "phrase", "a", F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))
    longer = candidates.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = (longer["lang"] == scored["lang"]) & (longer["phrase"] == scored["phrase"]) & (100 * longer["f"] >= p.percent * scored["a"])
    own = scored.join(longer, held, "left_anti").select("lang", "phrase", "a", "cut.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(p.salts))
    first = own.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= p.top).drop("salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= p.top)
    total = every.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
