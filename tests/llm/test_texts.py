"""Toxicity, surrogates and the pipeline on small cases."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vialattice.llm import pii, toxicity
from vialattice.llm.queries import pii_key


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = ["idiot", "scum", "worthless", "moronic", "abcabc"]
    lexicon = toxicity.Lexicon(terms, ["loser"], frozenset(["idiom"]), 5)
    words = {"losers", "loserish", "loser", "lose", "idiom", "scun"} | set(terms)
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                rng.choice([lambda w=w, k=k: w.insert(k, "x"), lambda w=w, k=k: w.pop(min(k, len(w) - 1)) if w else None])()
            words.add("".join(w))
    for w in words:
        want = 1 if w in terms else 2 if w.startswith("loser") else 3 if w != "idiom" and any(len(t) >= 5 and edits(w, t) <= 1 for t in terms) else 0
        assert lexicon.kind(w) == want, w


def test_stems_that_are_terms():
    lexicon = toxicity.Lexicon(["idiot"], ["idio", "idiot", "idioti"], frozenset(), 5)
    assert [lexicon.kind(w) for w in ("idiot", "idiotic", "idiotisch", "idiom", "idyot", "idi", "iddiotic")] == [1, 2, 2, 2, 3, 0, 0]
    lexicon = toxicity.Lexicon(["idiot"], ["idiot"], frozenset(), 5)
    assert [lexicon.kind(w) for w in ("idiotic", "idiots", "idio")] == [2, 2, 3]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    clean = [f"{a}{b}{c}" for a in ("ba", "do", "ri", "ne") for b in ("ta", "lu", "mo") for c in ("n", "s", "rk")]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["scumbag", "moronic", "vileness"])
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "batan scumbxg moronic vilenes batan", "en", "s", 0), (None, "batan", "en", "s", 0), (903, "batan " * 50_000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count()
    held = [r for k, r in got.items() if k is not None and k < 400 and r["held_out"]]
    assert len(held) > 50 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert got[902]["predicted"] == 1 and got[900]["score"] == got[901]["score"] < 0.3 and got[903]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_toxicity_learns_nothing_from_held_out_rows(spark, corpus):
    docs, labels = corpus
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, changed)
    assert a.terms == b.terms and np.allclose(a.weights, b.weights)


def test_toxicity_without_labels(spark, corpus):
    docs, labels = corpus
    got = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert all(r["score"] < 0.01 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_rows_that_repeat_an_id_teach_once(spark, corpus):
    docs, labels = corpus
    one = docs.where(~toxicity.held_out()).orderBy("doc_id").limit(1)
    many = docs
    for _ in range(40):
        many = many.unionByName(one)
    a, b = toxicity.fit(docs, labels), toxicity.fit(many.repartition(5), labels)
    assert (a.terms, a.stems, a.known) == (b.terms, b.stems, b.known) and np.allclose(a.weights, b.weights)


def test_quotation_counts_apart():
    scorer = toxicity.Scorer(toxicity.Lexicon(["scumbag"], [], frozenset(), 5), toxicity.Params())
    assert scorer.features('he is a scumbag')[0] > 0
    assert scorer.features('she said "you scumbag" to him')[0] == 0
    assert scorer.features('she said "you scumbag" to him')[3] > 0


def test_surrogates():
    s = pii.Surrogates("k")
    text = "Mail ann.b2@x1.org or Ann.B2@x1.org, call +1 (988) 555-2485; card 4111 1111 1111 1111, 10.1.2.3, GB82 WEST 1234 5698 7654 32, Señora María Lopez and Mr. John Smith. CC BY-NC 4.0, Version 2.0."
    new, found = pii.find_and_replace(text, s)
    kinds = [f[0] for f in found]
    assert kinds == ["email", "email", "phone", "card", "ip", "iban", "name", "name"]
    for kind, start, end, value in found:
        assert text[start:end].lower() != value.lower() and value in new, kind
    assert found[0][3] == found[1][3] and found[0][3].endswith(".org.example")  # one address
    assert found[6][3].startswith("Señora ") and found[6][3].split()[1].endswith("a")
    assert new.endswith("CC BY-NC 4.0, Version 2.0.")
    digits = [int(c) for c in found[3][3] if c.isdigit()]
    assert sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(digits))) % 10 == 0
    assert pii.find_and_replace(text, pii.Surrogates("k"))[0] == new != pii.find_and_replace(text, pii.Surrogates("other"))[0]


def test_surrogates_are_distinct():
    s = pii.Surrogates("k")
    for kind, given in (("ip", [f"10.0.{a}.{b}" for a in range(20) for b in range(20)]), ("card", [c for k in range(4000) if s.replace("card", c := f"41111111{k:08d}")]), ("ssn", [f"123-45-{k:04d}" for k in range(400)]), ("email", [f"a{k}@b.com" for k in range(300)])):
        got = [s.replace(kind, g) for g in given]
        assert len(set(got)) == len(given) and all(a != b for a, b in zip(given, got, strict=True))
    assert sorted(s.number(97, x, "t") for x in range(97)) == list(range(97))


def test_names_are_distinct_under_any_title():
    s = pii.Surrogates("k")
    for first, rest, vowels in (("AEIOUY", "bcdfghjklmnpqrstvwxz", "aeiouy"), ("АЕЁИОУЫЭЮЯ", "бвг", "аеёиоуыэюя")):
        names = [a + b + c for a in first for b in rest for c in vowels]
        for title in ("Mrs.", "Dr."):
            got = [s.replace("name", f"{title} {n}") for n in names]
            assert len(set(got)) == len(names) and all(g != f"{title} {n}" and (g[-1] == n[-1] or n[-1] not in "aoая") for g, n in zip(got, names, strict=True))
    words = [s.replace("name", f"{t} Anna Smith").removeprefix(t) for t in ("Dr.", "Mrs.", "Herr", "Prof.")]
    assert len(set(words)) == 1 and words[0].split()[0].endswith("a")


def test_secrets_and_addresses_are_distinct():
    s = pii.Surrogates("k")
    alphabet = "0aAgG9fFzZ"
    given = [f"token={a}{b}{c}00000" for a in alphabet for b in alphabet for c in alphabet]
    got = [s.replace("secret", g) for g in given]
    assert len(set(got)) == len(given) and all(a != b for a, b in zip(given, got, strict=True))
    hexes = [s.replace("secret", f"token={k:08x}") for k in range(0, 1 << 16, 97)]
    assert all(set(h.removeprefix("token=")) <= set("0123456789abcdef") for h in hexes) and len(set(hexes)) == len(hexes)
    mails = [f"{a}@{d}" for a in ("a", "b", "a1") for d in ("b.com", "b.org", "c.com", "b.com.org", "x.b.com")]
    got = [s.replace("email", m) for m in mails]
    assert len(set(got)) == len(mails) and all(g.endswith(".example") for g in got)


def test_names_after_greetings():
    s = pii.Surrogates("k")
    new, found = pii.find_and_replace("Dear Anna Schmidt, and Liebe Eva Maier! Dear all, Dear Sir or Lieber Gott im. Dr. Anna Schmidt", s)
    assert [f[0] for f in found] == ["greeted", "greeted", "name"]
    assert found[0][3].removeprefix("Dear ") == found[2][3].removeprefix("Dr. ")  # one person, one surrogate
    assert new.endswith("Dear all, Dear Sir or Lieber Gott im. " + found[2][3])


def test_collisions_are_resolved():
    s = pii.Surrogates("k")
    s.replace = lambda kind, x: {"111-11-1111": "333-33-3333", "222-22-2222": "333-33-3333", "333-33-3333": "555-55-5555"}.get(x, "444-44-4444")
    new, found = pii.find_and_replace("111-11-1111, 222-22-2222, 222-22-2222 and 111-11-1111", s)
    values = [f[3] for f in found]
    assert values[0] == values[3] != values[1] == values[2] and len(new) == 53
    s.replace = lambda kind, x: "333-33-3333"  # nothing else is there to take
    assert len(pii.find_and_replace("111-11-1111, 222-22-2222", s)[1]) == 2
    text = "Mr. Smith, Mr. 王 and Mr. Ωω"
    assert pii.find_and_replace(text, pii.Surrogates("k"))[0].startswith("Mr. ")


def test_pseudonymize(spark):
    rows = [(1, "call 202-555-0143 now"), (2, None), (3, ""), (4, "clean text, really."), (None, "a@b.org"), (5, "x " * 100_000 + "a@b.org")]
    df = spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in rows], "doc_id long, text string, n_chars long, Entities string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, "k").collect()}
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == rows[3][1] and got[4]["n_entities"] == 0
    assert got[1]["n_entities"] == 1 and "555-0143" not in got[1]["text"]
    assert got[5]["text"].endswith(got[None]["text"])
    whole = pii.replace_text(df, "k")
    assert whole.columns == df.columns and all(r["n_chars"] == len(r["text"] or "") for r in whole.collect())
    assert pii.collisions(df, "k").count() == 0 and pii.pseudonymize(df.limit(0), "k").count() == 0


def test_pipeline(spark, corpus, tmp_path):
    docs, labels = corpus
    docs.union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(5000).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {k for k in range(400) if k % 4}
    assert 5000 not in got and 902 not in got and clean <= got and not got & {k for k in range(0, 400, 4)}
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == seen.columns, name
        assert stage(spark, seen.limit(0), str(tmp_path)).count() == 0


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    docs, labels = corpus
    rows = [(1, "b c d e f g", "en", "s", 11), (1, "a c d e f g", "en", "s", 11), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (3, "B c d e f g", "en", "s", 11), (None, "b c d e f g", "en", "s", 1), (None, "", "en", "s", 0), (7, "mail a@b.org", "en", "s", 12)]
    given = spark.createDataFrame(rows, docs.schema)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "")
    got = sorted(corpus_pipeline.keep_one_of_each(spark, given, str(tmp_path)).collect(), key=key)
    assert [(r["doc_id"], r["text"]) for r in got] == [(1, "a c d e f g"), (2, None), (7, "mail a@b.org"), (None, ""), (None, "b c d e f g")]
    s = pii.Surrogates(pii_key(spark))
    got = sorted(corpus_pipeline.pseudonymize(spark, given, str(tmp_path)).collect(), key=key)
    want = sorted((dict(zip(docs.columns, r, strict=True)) | {"text": r[1] and pii.find_and_replace(r[1], s)[0]} for r in rows), key=key)
    assert [(r["doc_id"], r["text"]) for r in got] == [(r["doc_id"], r["text"]) for r in want]
    # the whole run is the same again, whatever the partitions
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    first = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()))
    docs.repartition(2).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert first == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()))


def test_long_texts_take_little():
    scorer = toxicity.Scorer(toxicity.Lexicon(["scumbag"], [], frozenset(), 5), toxicity.Params())
    began = time.process_time()
    assert scorer.features('"scumbag" ' * 100_000)[3] > 0 and time.process_time() - began < 5


def test_mentions_of_names():
    s = pii.Surrogates("k")
    new = lambda w: s.text(w, "name", last=pii.LAST)
    john, smith = new("John"), new("Smith")
    text, found = pii.find_and_replace("Smith? Mr. John Smith said hello. Smith left, then John Smith came back. Smithson, smith, Smith_x and O'Smith.", s)
    assert text == f"{smith}? Mr. {john} {smith} said hello. {smith} left, then {john} {smith} came back. Smithson, smith, Smith_x and O'{smith}."
    assert [f[0] for f in found] == ["mention", "name", "mention", "mention", "mention", "mention"]
    again = "Smith? Mr. John Smith said hello. Smith left, then John Smith came back. Smithson, smith, Smith_x and O'Smith."
    assert all(again[a:b] != n for _, a, b, n in found) and text == "".join(p for _, p in pieces(again, found))
    # each document has its own names
    assert pii.find_and_replace("Smith left.", s) == ("Smith left.", [])
    a, b = pii.find_and_replace("Dear Anna Meier, Anna and a@b.org", s)[0].split(", ")
    assert b.split()[0] == a.split()[1] != "Anna"


def pieces(text, found):
    at = 0
    for _, start, end, new in found:
        yield "", text[at:start]
        yield "", new
        at = end
    yield "", text[at:]


def test_detection_against_a_plain_version():
    """Kinds whose form is unambiguous, each found by splitting at blanks and looking at the whole word."""
    rng = random.Random(3)

    def luhn(d):
        total = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        return [*d, -total % 10]

    def is_card(w):
        d = [int(c) for c in w]
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0

    made = [
        lambda: f"{rng.choice('abc')}.{rng.randint(1, 99)}@x{rng.randint(1, 9)}.org", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: "".join(map(str, luhn([rng.randint(1, 9) for _ in range(15)]))), lambda: str(rng.randint(10**14, 10**16)), lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        lambda: rng.choice(["word", "Word,", "12", "a@b", "x@y.", "1.2.3", "--"]),
    ]
    s = pii.Surrogates("k")
    for _ in range(300):
        words = [rng.choice(made)() for _ in range(rng.randint(1, 25))]
        want = []
        for w in words:
            local, _, domain = w.partition("@")
            if local and domain.count(".") == 1 and domain.partition(".")[2]:
                want.append(("email", w))
            elif re.fullmatch(r"\d+(\.\d+){3}", w) and all(int(x) < 256 for x in w.split(".")):
                want.append(("ip", w))
            elif w.isdigit() and 13 <= len(w) <= 19 and is_card(w):
                want.append(("card", w))
            elif re.fullmatch(r"\d{3}-\d{2}-\d{4}", w):
                want.append(("ssn", w))
        text = " | ".join(words)
        new, found = pii.find_and_replace(text, s)
        assert [(k, text[a:b]) for k, a, b, _ in found] == want
        assert new == "".join(p for _, p in pieces(text, found)) and all(text[a:b] != n for _, a, b, n in found)


@pytest.mark.parametrize("part", ["a", "a.", "7", "1-", "a@", "x@a.", "+1 ", "(12) 345-", "Mr. ", "Mr. Jo ", "AB12", "token=", " ", "\n", "Q"])
def test_entities_of_long_texts_take_little(part):
    text = "x=1 @ " + part * (600_000 // len(part))
    began = time.process_time()
    pii.find_and_replace(text, pii.Surrogates("k"))
    assert time.process_time() - began < 6
