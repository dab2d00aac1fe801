"""Best-two-fit packing of documents into fixed-length token sequences.

Documents become pieces of at most ``seq_len`` tokens. Which lengths share a sequence is decided on
the histogram of piece lengths, which has at most ``seq_len`` entries at any corpus size; the pieces
themselves stay distributed and find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.taskcontext import TaskContext

from .common import batches, materialize, pick, tidied

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long"


#: The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside of those that all Unicode versions of the two libraries class alike, and white
#: space so long that the pattern of tiktoken's engine runs out of stack.
UNCOMMON = re.compile(r"[^\0-\u024f\u0410-\u044f\u2010-\u2027]|\s{200}")


def _byte_names() -> dict[str, int]:
    """Characters that stand for bytes in a vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _same_engine(path: str, tokenizer):
    """tiktoken's engine for the tokenizer's vocabulary, a quarter as slow, if it gives the same ids; else None.

    It does for byte-level BPE whose ids are in the order of its merges, if both libraries turn the
    bytes of each token into just that token. By induction over the length, each token's last
    contraction is then the same one in any context. That is checked here for the whole vocabulary.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, byte = spec["model"], spec["pre_tokenizer"] or {}, _byte_names()
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if odd or model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or not all(t["special"] for t in spec["added_tokens"]):
        return None
    vocab = model["vocab"]
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if not set(byte) <= set(vocab) or not set("".join(vocab)) <= set(byte) or any(a >= b for a, b in zip(made, made[1:])) or len(made) != len(vocab) - 256 or made[0] < 0:
        return None
    ranks = {bytes(map(byte.__getitem__, name)): k for name, k in vocab.items()}
    engine = tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    same = all([t.id for t in tokenizer.model.tokenize(name)] == [k] for name, k in vocab.items()) and all(engine._encode_single_piece(t) == [k] for t, k in ranks.items())
    return engine if same else None


@lru_cache(maxsize=1)
def _encoders(path: str):
    """Per Python worker: the tokenizer, an engine of the same ids or None, and what only the tokenizer may encode."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    odd = re.compile("|".join([UNCOMMON.pattern, *map(re.escape, added)]))
    return tokenizer, _same_engine(path, tokenizer), odd


def encoded(texts: list[str], tokenizer_path: str) -> Iterator[bytes]:
    """Each text's ids, as little-endian 32-bit numbers.

    As the library does by default, none are added at the ends, and a text's own special tokens, such as
    ``<|endoftext|>``, are one id each.
    """
    tokenizer, engine, odd = _encoders(tokenizer_path)
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids if engine is None or odd.search(text) else engine.encode_ordinary(text)
        yield np.asarray(ids, "<u4").tobytes()


def cut_lengths(n: int, seq_len: int) -> list[int]:
    """Lengths of a document's pieces: one if it fits, else a shorter first one and full ones."""
    if n <= seq_len:
        return [n]
    return ([n % seq_len] if n % seq_len else []) + [seq_len] * (n // seq_len)


def encode_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int) -> DataFrame:
    """A row per piece, with its rank (``ord``) among its input partition's pieces of its length."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, np.int64)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches(stream, 1000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts, tokenizer_path), strict=True):
                ids += end
                at = 0
                for k, length in enumerate(cut_lengths(len(ids) // 4, seq_len)):
                    for column, x in zip(rows, (doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), part, int(seen[length])), strict=True):
                        column.append(x)
                    seen[length] += 1
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return pick(docs, "doc_id", "text").mapInArrow(tidied(run), PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How to fill bins from so many items of each length: (bins, [(length, times in a bin)]).

    A bin takes the longest item left, then greedily the longest that fits. If a gap stays, its
    shortest item gives way to the two unpacked items that fill the expanded gap best, as long as
    that makes the gap smaller. The same bin is repeated while the counts allow it, so the work
    depends on the number of different lengths and not on the number of items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit a bin of {capacity}")
        left[length] = n
    plan = []
    while left.any():
        used = np.zeros(capacity + 1, np.int64)
        gap = capacity
        while gap:
            fits = np.flatnonzero((left - used)[1 : gap + 1] > 0)
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            used[length] += 1
            gap -= length
        while gap and used.sum() > 1:
            small = int(np.flatnonzero(used)[0])
            room = gap + small
            free = left - used
            lengths = np.flatnonzero(free[1:room] > 0) + 1
            best = (small, 0, 0)
            for a in lengths:
                b = lengths[: np.searchsorted(lengths, min(a, room - a), "right")]
                if len(b) and b[-1] == a and free[a] < 2:
                    b = b[:-1]
                if len(b) and a + b[-1] > best[0]:
                    best = (int(a + b[-1]), int(a), int(b[-1]))
            if not best[1]:
                break
            used[small] -= 1
            used[best[1]] += 1
            used[best[2]] += 1
            gap = room - best[0]
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left -= used * times
        plan.append((times, [(int(k), int(used[k])) for k in kinds[::-1]]))
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times in a bin, first bin, offset in the bin), by first rank."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    first_bin = 0
    for bins, content in plan:
        offset = 0
        for length, times in content:
            out.setdefault(length, []).append((taken.get(length, 0), times, first_bin, offset))
            taken[length] = taken.get(length, 0) + bins * times
            offset += length * times
        first_bin += bins
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``seq_len`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    text counts as empty and still has its end token; a null doc_id stays null; repeated rows are
    packed as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    pieces, _ = materialize(encode_pieces(docs, tokenizer_path, seq_len, end_id), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    where = slots(best_two_fit(counts, seq_len))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("ord")).alias("rank"))

    def place(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                first, times, first_bin, at = where[int(size)].T
                k = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[k]
                sequence[rows] = first_bin[k] + nth // times[k]
                offset[rows] = at[k] + (nth % times[k]) * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
