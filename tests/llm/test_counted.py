"""Vector codes, collocations and repeated passages against plain versions, with odd rows of all kinds."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vialattice.llm import codes, passages, phrases

VECTORS = "vec_id long, label long, embedding array<float>, Label2 string"
TEXTS = "doc_id long, lang string, text string, Text2 string"


def lloyd(rows, parts=8, entries=16, rounds=6):
    """Plain integers, all parts anew in every round."""
    whole = [(i, lab, [[math.floor(4096 * x) for x in v[k : k + len(v) // parts]] for k in range(0, len(v), len(v) // parts)]) for i, lab, v in rows]
    start: dict = {}
    for i, _, x in whole:
        if i is not None:
            start[i] = min(start.get(i, x), x)
    first = [start[i] for i in sorted(start)] + sorted(x for i, _, x in whole if i is None)
    books = [[x[p] for x in first[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, x in whole:
                own[near(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else b for e, b in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, lab, x in whole:
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = Counter()
    for _, lab, _, error in out:
        total[lab] += error
    return Counter((i, code, error, total[lab], digest) for i, lab, code, error in out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((5, 16))
    rows = [(int(k), None if k % 7 == 0 else int(k % 3), [float(x) for x in np.float32(centre[k % 5] + 0.3 * rng.standard_normal(16))]) for k in rng.permutation(90)]
    rows += [(90 + k, 1, rows[4][2]) for k in range(20)]  # copies
    rows += [(3, 2, rows[8][2]), (3, 2, rows[8][2]), (None, 1, rows[5][2])]  # ids again, and none
    rows += [(200, 0, [0.0] * 16), (201, 0, [-0.0] * 16), (202, 1, [1e-9, -1e-9] * 8), (203, 1, [3000.0] * 16)]
    return rows


@pytest.mark.parametrize("entries, rounds", [(16, 6), (4, 2), (200, 3), (16, 0)])
def test_codes(spark, vectors, entries, rounds):
    odd = [(300, 0, None), (301, 0, [float("nan")] * 16), (302, 0, [float("inf")] + [0.0] * 15), (303, 0, [None] + [0.0] * 15), (304, 0, []), (305, 0, [1.0] * 15), (306, 0, [1.0] * 24)]
    df = spark.createDataFrame([(*r, "x") for r in vectors + odd], VECTORS).repartition(5)
    got = codes.compress(df, codes.Params(entries=entries, rounds=rounds)).collect()
    rows = [r for r in vectors if r[0] is not None] + [r for r in vectors if r[0] is None]
    assert Counter(tuple(r) for r in got) == lloyd(rows, entries=entries, rounds=rounds)


def test_codes_of_large_components_and_of_none(spark):
    far = spark.createDataFrame([(1, 0, [3e38] * 8, "x"), (2, 0, [-3e38] * 8, "x"), (3, None, [1e5] * 8, "x")], VECTORS)
    got = {r["vec_id"]: r for r in codes.compress(far).collect()}
    assert [got[k]["code"] for k in (1, 2, 3)] == ["00" * 8, "01" * 8, "00" * 8]  # both bounded, the third as far as the first
    assert codes.compress(far.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert codes.compress(far.limit(0)).count() == 0


def test_a_change_moves_sums_only():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (40, 2, 3))
    before, now = rng.integers(0, 4, (40, 2)).astype(np.uint8), rng.integers(0, 4, (40, 2)).astype(np.uint8)
    now[:30] = before[:30]
    moved = codes.contributions(x, before, now, 4)
    assert codes.contributions(x, before, before, 4) == []
    for p in range(2):
        n, s = np.zeros(4, int), np.zeros((4, 3), int)
        for part, e, count, sums in codes.contributions(x, None, before, 4) + moved:
            if part == p:
                n[e] += count
                s[e] += sums
        assert all(n[e] == (now[:, p] == e).sum() and (s[e] == x[now[:, p] == e, p].sum(0)).all() for e in range(4))


def collocations(rows, p):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, p.words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    chosen = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    inside = {}
    for (lang, w), a in chosen.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(a, inside.get((lang, w[i:j]), 0))
    for (lang, w), a in chosen.items():
        if 100 * inside.get((lang, w), -1) >= p.percent * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, k + 1, b.decode(), -a, left, r, n[lang], -s) for lang in out for k, (s, a, b, left, r) in enumerate(sorted(out[lang])[: p.top])]


@pytest.mark.parametrize("p", [phrases.Params(least=3), phrases.Params(words=4, least=2, top=25, hot=3, salts=4), phrases.Params(words=2, least=5, percent=90)])
def test_collocations(spark, p):
    rng = random.Random(4)
    words = ["a", "b", "the", "The", "of", "né", "ÉA", "x-y", "日本", "q r", "\x1cz", "w"]
    texts = [("en" if k % 3 else None, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(rng.randint(0, 60)))) for k in range(80)]
    texts += [("en", None), ("und", "a b a b"), ("", "a b a b a b a b"), ("en", "a b " * 3000), ("de", "only once here")] + [("fr", "same line of text here")] * 30
    df = spark.createDataFrame([(k, *t, "of") for k, t in enumerate(texts)], TEXTS).repartition(5)
    got = phrases.collocations(df, p).collect()
    assert sorted(map(tuple, got)) == sorted(collocations(texts, p)) and len(got) > 20
    assert phrases.collocations(df.limit(0), p).count() == 0


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13, 3 * 10**13, 2 * 10**13)], "a long, l long, r long")
    assert df.select(phrases._score("a", "l", "r")).first()[0] == 10**6 * 10**26 // (6 * 10**26)


def deduplicated(rows, window):
    first: dict = {}
    split = [(i, re.findall("[^ \t-\r]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, math.inf), math.inf if i is None else i)
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (math.inf if i is None else i) for j in range(window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("p", [passages.Params(), passages.Params(window=3, words_at_once=50, entries=20), passages.Params(window=1, most_bits=4, rows=1), passages.Params(window=13, most_bits=3)])
def test_repeated_passages(spark, p):
    rng = random.Random(6)
    words = ["a", "b", "c", "né", "q r", "\x1cz", "x" * 100, "日本", "\x85", "A"]
    line = " ".join(rng.choice(words) for _ in range(20))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(500 + k, texts[k % 9]) for k in range(30)]
    rows += [(1000 + k, f"{texts[k]}\n{line}\t{texts[-k - 1]}  {line}") for k in range(20)]
    rows += [(None, line), (None, texts[3]), (None, "no one else has these words " * 4), (5, None), (8, ""), (9, line), (9, line), (9, "again " + line), (7, "word " * 400), (2**63 - 1, line)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, None, t, "x") for i, t in rows], TEXTS).repartition(6)
    out = passages.deduplicate(df, p, text=True).collect()
    assert Counter(tuple(r)[:4] for r in out) == deduplicated(rows, p.window)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in out)
    assert passages.deduplicate(df.limit(0), p).count() == 0


def test_the_sketch_never_counts_too_few(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    p = passages.Params(window=4, words_at_once=500)
    times = Counter(tuple(w[k : k + 4]) for w in (t.encode().split() for t in texts) for k in range(197))
    for bits in (6, 12, 18):
        table = {(r["row"], r["block"]): r["bits"] for r in passages.merged(passages.sketches(docs, bits, p), bits, 2).collect()}
        assert len(table) == p.rows
        heavy = [np.unpackbits(np.frombuffer(passages.pa.decompress(table[r, 0], decompressed_size=1 << max(0, bits - 3), codec="zstd", asbytes=True), np.uint8)) for r in range(p.rows)]
        high, low, text, at = passages.Fingerprints(4)([t.encode().split() for t in texts])
        cells = passages._cells(high, low, bits, p.rows)
        for k in range(len(high)):
            repeated = times[tuple(texts[text[k]].encode().split()[at[k] : at[k] + 4])] > 1
            assert not repeated or all(heavy[r][cells[r][k]] for r in range(p.rows))


def test_packed_cells():
    for cells in ([], [0], [5, 6, 7, 2**20 - 1], sorted(random.Random(0).sample(range(2**20), 5000))):
        assert passages._met(passages.pack(passages.gaps(np.array(cells, np.int64)))).tolist() == cells
        columns = [np.array(cells, np.int64) * -3, np.array(cells, np.int32)]
        assert all((a == b).all() for a, b in zip(passages.unpack(passages.pack(*columns), np.int64, np.int32), columns, strict=True))
