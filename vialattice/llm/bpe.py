"""Byte-level BPE by recursive SQL, one DuckDB database in each Python worker.

Distinct words (matches of the pre-tokenizer pattern) of a batch of documents become rows
(word and position, token), first a token for each byte. A recursive query joins neighbouring
positions to the merge table and contracts each word's leftmost pair of least rank, until no word
has a pair. Ordered aggregation then gives each word's ids, which the vocabulary turns into bytes.

The query's work grows with the square of a word's length. Words of more than ``LONG`` bytes (never
seen in prose) take the same contractions from a heap in Python instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, pick, tidied
from .tokens import MARKS, ChunkTable, chunks, plain

#: Words of more bytes than this are contracted outside SQL.
LONG = 256
#: Bits of a position within a word, and of a word's number and a position together.
POS_BITS, WORD_BITS = 9, 34

#: wp: word and position in one number, by which rows are ordered; a finished word leaves the recursion.
CONTRACT = f"""
with recursive state(wp, t, done) as (
  select wp, t, false from start
  union all
  select * from (
    with near as materialized (
      select wp, t, lead(wp) over (order by wp) as wp2, lead(t) over (order by wp) as t2 from state where not done),
    least as (
      select near.wp >> {POS_BITS} as w, min((merges.rank::bigint << {WORD_BITS}) + near.wp) as key, arg_min(near.wp2, (merges.rank::bigint << {WORD_BITS}) + near.wp) as wp2
      from near join merges on merges.pair = (near.t::bigint << 20) + near.t2
      where near.wp >> {POS_BITS} = near.wp2 >> {POS_BITS} group by 1)
    select near.wp, case when near.wp = (key & {(1 << WORD_BITS) - 1}) then (key >> {WORD_BITS})::int else near.t end, key is null
    from near left join least on near.wp >> {POS_BITS} = least.w where key is null or near.wp <> least.wp2)
)
select list(t order by wp) as ids from state where done group by wp >> {POS_BITS} order by wp >> {POS_BITS}
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RecursiveBpe:
    """The vocabulary, the merge table and the recursive query over it."""

    def __init__(self, path: str, memory: str = "256MB"):
        import duckdb

        ranks = read_ranks(path)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [((a << 20) + b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        given = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        self.db.register("given", given)
        self.db.execute("create table merges as select * from given")
        self.db.unregister("given")
        size = max(ranks.values()) + 1
        self.names, self.tokens = list(map(str, range(size))), [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def encode(self, words: list[str], at_once: int = 25_000) -> list[tuple[int, str, bytes]]:
        """For each word: number of tokens, ids joined by spaces, and the bytes these ids decode to."""
        every = [w.encode() for w in words]
        out = [self._by_heap(b) if len(b) > LONG else None for b in every]
        done = iter(self._by_query([b for b in every if len(b) <= LONG], at_once))
        return [o if o is not None else next(done) for o in out]

    def _by_heap(self, word: bytes) -> tuple[int, str, bytes]:
        """The same contractions for one long word, in n log n steps."""
        n = len(word)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := self.ranks.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, at, to = heapq.heappop(heap)
            nxt = end[at] if alive[at] else n
            if nxt >= n or end[nxt] != to:
                continue
            alive[nxt], end[at] = False, to
            if to < n:
                before[to] = at
                if (r := self.ranks.get(word[at : end[to]])) is not None:
                    heapq.heappush(heap, (r, at, end[to]))
            if (left := before[at]) >= 0 and (r := self.ranks.get(word[left:to])) is not None:
                heapq.heappush(heap, (r, left, to))
        tokens = [word[k : end[k]] for k in range(n) if alive[k]]
        return len(tokens), " ".join(str(self.ranks[t]) for t in tokens), b"".join(tokens)

    def _by_query(self, words: list[bytes], at_once: int) -> list[tuple[int, str, bytes]]:
        out: list[tuple[int, str, bytes]] = []
        for at in range(0, len(words), at_once):
            coded = words[at : at + at_once]
            size = np.fromiter(map(len, coded), np.int64, len(coded))
            w = np.repeat(np.arange(len(coded)), size)
            place = np.arange(len(w)) - (np.cumsum(size) - size)[w]
            self.db.register("start", pa.table({"wp": (w << POS_BITS) + place, "t": self.byte[np.frombuffer(b"".join(coded), np.uint8)]}))
            found = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
            self.db.unregister("start")
            ids, end = found.values.to_pylist(), found.offsets.to_pylist()
            names, tokens = list(map(self.names.__getitem__, ids)), list(map(self.tokens.__getitem__, ids))
            out += [(e - b, " ".join(names[b:e]), b"".join(tokens[b:e])) for b, e in zip(end, end[1:])]
        return out


@lru_cache(maxsize=1)
def _table(path: str, pattern: str, limit: int) -> tuple[ChunkTable, tuple[int, str, bytes], object]:
    """Per Python worker: chunks known so far, the line feed's encoding and the pattern.

    A word (a match of the pattern) is known by the chunk that stands for it, or behind a mark.
    """
    import regex

    engine, find = RecursiveBpe(path), regex.compile(pattern)
    feed = engine.encode(["\n"])[0]

    def cut(chunk: str) -> tuple[str, ...]:
        """The keys of a chunk's words."""
        if chunk.isalpha():
            return (chunk,)
        if chunk[0] == " ":  # a match of the pattern
            return (chunk,)
        lead, body = (" ", chunk[1:]) if chunk[0] == "\n" else ("", chunk)
        base = body.rstrip(MARKS)
        if base.isalpha():
            return (lead + base,) if len(base) == len(body) else (lead + base, " " + body[len(base) :])
        return tuple(map(_key, find.findall(body if lead else " " + body)))

    def learn(new: list[str], table: ChunkTable) -> tuple[list, list, list]:
        parts = list(map(cut, new))
        keys, number, have = dict.fromkeys(chain.from_iterable(parts)), table.numbers.get, len(table.columns[0])
        unknown = [k for k in keys if number(k, have) >= have]
        value = dict(zip(unknown, engine.encode([k[1:] if k[0] == " " else " " + k for k in unknown]), strict=True))
        for k in keys.keys() - value.keys():
            value[k] = tuple(column[number(k)] for column in table.columns)
        more = [k for k in unknown if k not in table.numbers]
        for k in more:
            table.add(k)
        rows = [value[p[0]] if len(p) == 1 and c[0] != "\n" else join(([feed] if c[0] == "\n" else []) + [value[k] for k in p]) for c, p in zip(new, parts, strict=True)]
        rows += [value[k] for k in more]
        return tuple(map(list, zip(*rows, strict=True)))

    def join(values: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
        return sum([v[0] for v in values]), " ".join([v[1] for v in values]), b"".join([v[2] for v in values])

    return ChunkTable(learn, 3, limit), feed, find


def _key(word: str) -> str:
    """The chunk that stands for a match of the pattern: without its space if it has just one, else behind a mark."""
    return word[1:] if word[:1] == " " and len(word) > 1 and not word[1].isspace() else " " + word


def encoded(texts: list[str], ranks_path: str, pattern: str, limit: int) -> Iterator[tuple[int, str, bytes]]:
    """For each text: number of tokens, ids joined by spaces, and the bytes that these ids decode to."""
    table, feed, find = _table(ranks_path, pattern, limit)
    whole = [plain(t) for t in texts]
    found = table.lookup([chunks(t) if p else [_key(w) for w in find.findall(t)] for t, p in zip(texts, whole, strict=True)])
    n, names, decoded = table.columns
    for numbers, p in zip(found, whole, strict=True):
        count, ids, back = sum(map(n.__getitem__, numbers)), " ".join(map(names.__getitem__, numbers)), b"".join(map(decoded.__getitem__, numbers))
        # a plain text's first chunk has a line feed too many
        yield (count - feed[0], ids[len(feed[1]) + 1 :], back[len(feed[2]) :]) if p else (count, ids, back)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, limit: int = 700_000) -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 for each row. A null text counts as empty
    (no tokens, digests of the empty string); repeated rows stay; other columns are ignored; an empty
    table gives an empty one. Special tokens' strings are ordinary text. ``limit``: chunks that a
    Python worker remembers.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, 1000):
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()) for n, ids, back in encoded([t or "" for t in batch.column(1).to_pylist()], ranks_path, pattern, limit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
