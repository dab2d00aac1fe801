"""Surrogates for personal data: keyed, of the same kind and format, distinct and consistent.

An entity's replaceable characters, each with the alphabet it comes from (a digit, a vowel of a
script, ...), are the digits of one mixed-radix number. A keyed permutation of that number's range
without fixed points gives the surrogate. So equal entities get equal surrogates wherever they
occur (coreference), different ones get different surrogates (distinctness), and no table of
entities has to be kept, joined or sent around, at any corpus size. Alphabets are of one script, and
last letters that often mark gender stay, as titles do.

Names are found behind a title, or two capitalised words behind a greeting. Their words are then
found in the rest of that document, too: a whole word of the same case gets the same surrogate. A
name that has no title or greeting anywhere in its document isn't found, since nothing here knows
names from other capitalised words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, pick, place, tidied

#: Honorifics before a person's name, by gender.
HONORIFICS = {
    "m": ("Mr.", "Mr", "Sir", "Herr", "Herrn", "Monsieur", "M.", "Señor", "Sr.", "Don", "Господин"),
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Doña", "Госпожа"),
    "": ("Dr.", "Prof.", "Professor"),
}
#: Greetings before a given and a family name.
GREETINGS = {"m": ("Lieber", "Cher", "Querido", "Estimado"), "f": ("Liebe", "Chère", "Querida", "Estimada"), "": ("Dear",)}
TITLES = tuple(sorted((t for v in HONORIFICS.values() for t in v), key=len, reverse=True))
GREETED = tuple(sorted((t for v in GREETINGS.values() for t in v), key=len, reverse=True))
#: Letters that are exchanged among themselves.
ALPHABETS = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñßšžčđ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ")
CLASS = {c: a for a in ALPHABETS for c in a} | {c.upper(): a.upper() for a in ALPHABETS[1:] for c in a if len(c.upper()) == 1 and c.upper() != c}
#: Last letters that often mark gender. They stay, and no other letter becomes one of them.
ENDINGS = "aoая"
LAST = {c: "".join(x for x in a if x not in ENDINGS) for c, a in CLASS.items() if c not in ENDINGS}
#: Of secrets, letters of hexadecimal numbers stay apart from the others, so each kind of string keeps its kind.
SECRET = {c: a for a in ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ") for c in a}
ENTITY = re.compile(
    r"(?P<secret>\bAKIA[A-Z0-9]{16}\b|\b(?:password|passwd|pwd|secret|api_key|apikey|token)\s*[=:]\s*\"?[A-Za-z0-9+/_\-]{8,}\"?)"
    r"|(?P<email>(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d\-+])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{13,19})(?![\d\-]))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<phone>(?<![\d.])(?:\+\d{1,3}[ .\-]?)?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\d])|(?<!\w)\+\d[\d .\-()]{7,17}\d(?!\d))"
    r"|(?P<name>(?<!\w)(?:" + "|".join(map(re.escape, TITLES)) + r")\s+[^\W\d_]+(?:[\-'][^\W\d_]+)*(?!\w)(?:\s+[^\W\d_]+(?:[\-'][^\W\d_]+)*(?!\w))?)"
    r"|(?P<greeted>(?<!\w)(?:" + "|".join(map(re.escape, GREETED)) + r")[ \u00a0][^\W\d_]+(?:[\-'][^\W\d_]+)*[ \u00a0][^\W\d_]+(?:[\-'][^\W\d_]+)*(?!\w))"
)
DIGIT = re.compile(r"\d")


class Surrogates:
    """Keyed replacements; stateless but for a bounded memory of recent ones."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.replace = lru_cache(maxsize=50_000)(self._replace)

    def _round(self, tag: bytes, i: int, x: int) -> int:
        h = hashlib.blake2b(tag + bytes([i]) + x.to_bytes((x.bit_length() + 8) // 8, "big"), key=self.key, digest_size=64)
        return int.from_bytes(h.digest(), "big")

    def _permuted(self, n: int, x: int, tag: bytes, back: bool) -> int:
        """A keyed permutation of 0..n-1 (or its inverse): Feistel rounds on a pair, walked into range."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = x % a, x // a
            for i in range(8) if not back else reversed(range(8)):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tag, i, left)) % b
                else:
                    left = (left + sign * self._round(tag, i, right)) % a
            x = right * a + left
            if x < n:
                return x

    def number(self, n: int, x: int, tag: str) -> int:
        """Another number below n for each x; never x itself if n > 1."""
        if n < 2:
            return x
        key = f"{tag}|{n}".encode()
        return self._permuted(n, (self._permuted(n, x, key, True) + 1) % n, key, False)

    def text(self, s: str, tag: str, keep: frozenset[int] = frozenset(), kinds: dict[str, str] = CLASS, last: dict[str, str] | None = None) -> str:
        """Replace each character by one of its alphabet, but those at the places to keep; ``last``: the last one's alphabets."""
        alphabets = [kinds] * (len(s) - 1) + [kinds if last is None else last]
        places = [(k, kinds[c]) for k, (c, kinds) in enumerate(zip(s, alphabets)) if k not in keep and c in kinds]
        n, x = 1, 0
        for k, alphabet in places:
            x, n = x * len(alphabet) + alphabet.index(s[k]), n * len(alphabet)
        y, out = self.number(n, x, tag), list(s)
        for k, alphabet in reversed(places):
            y, r = divmod(y, len(alphabet))
            out[k] = alphabet[r]
        return "".join(out)

    def _replace(self, kind: str, s: str) -> str | None:
        """The surrogate, or None where the match is no such entity after all."""
        return getattr(self, "_" + kind)(s)

    def _secret(self, s: str) -> str:
        value = s.startswith("AKIA") and 4 or re.match(r"\w+\s*[=:]\s*\"?", s).end()
        return s[:value] + self.text(s[value:], "secret", kinds=SECRET)

    def _email(self, s: str) -> str:
        """At a domain under ``.example``, which is nobody's."""
        local, _, domain = s.lower().rpartition("@")
        return self.text(local, "email") + "@" + self.text(domain.rpartition(".")[0], "domain") + "." + domain.rpartition(".")[2] + ".example"

    def _ip(self, s: str) -> str:
        octets = [int(o) for o in s.split(".")]
        first = 223 if 1 <= octets[0] <= 223 else 1
        x = octets[1] << 16 | octets[2] << 8 | octets[3]
        y = self.number(first << 24, ((octets[0] - 1) << 24 | x) if first > 1 else x, f"ip{first > 1}")
        return ".".join(map(str, ((y >> 24) + 1 if first > 1 else octets[0], y >> 16 & 255, y >> 8 & 255, y & 255)))

    def _card(self, s: str) -> str | None:
        digits = [int(c) for c in s if c.isdigit()]
        if not 13 <= len(digits) <= 19:
            return None

        def luhn(d: list[int]) -> int:
            return -sum(x if k % 2 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10

        if digits[-1] != luhn(digits[:-1]):  # an order or a serial number
            return None
        head = [int(c) for c in self.text("".join(map(str, digits[:-1])), "card", frozenset({0}))]
        new = iter([*head, luhn(head)])
        return "".join(str(next(new)) if c.isdigit() else c for c in s)

    def _iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")

        def rest(x: str) -> int:
            return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

        if rest(plain) != 1:
            return None
        body = self.text(plain[4:], "iban" + plain[:2])
        new = iter(plain[:2] + f"{98 - rest(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in s)

    def _ssn(self, s: str) -> str:
        return self.text(s, "ssn")

    def _phone(self, s: str) -> str | None:
        if not 7 <= sum(c.isdigit() for c in s) <= 15:
            return None
        code = re.match(r"\+\d{1,3}(?=[ .\-(])", s)
        return self.text(s, "phone", frozenset(range(code.end() if code else 0)))

    def _greeted(self, s: str) -> str | None:
        """After a greeting, only two capitalised words are a name."""
        if not all(w[:1].isupper() and len(w) > 1 for w in s.split()[1:]):
            return None
        return self._name(s, GREETED)

    def _name(self, s: str, titles: tuple[str, ...] = TITLES) -> str | None:
        title = next(t for t in titles if s.startswith(t) and s[len(t)].isspace())
        words = re.split(r"(\s+|[\-'])", s[len(title) :].lstrip())
        if not words[0][:1].isupper():
            return None
        if len(words) > 2 and not words[-1][:1].isupper():  # the word after the name is no part of it
            words = words[: next(k for k, w in enumerate(words) if k % 2 == 0 and not w[:1].isupper()) - 1]
        # one permutation for a word, whatever its title is; -a and -o stay apart from other last letters
        new = [w if k % 2 else self.text(w, "name", last=LAST if len(w) > 2 else None) for k, w in enumerate(words)]
        gap = s[len(title) : len(s) - len(s[len(title) :].lstrip())]
        return title + gap + "".join(new) + s[len(title) + len(gap) + len("".join(words)) :]


def find_and_replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end, surrogate) of each entity in the given text."""
    if not DIGIT.search(text) and "@" not in text and not any(t in text for t in TITLES) and not any(t in text for t in GREETED) and "AKIA" not in text and "=" not in text and ":" not in text:
        return text, []
    parts, found, at = [], [], 0
    given: dict[tuple[str, str], str] = {}
    taken: set[tuple[str, str]] = set()
    for m in ENTITY.finditer(text):
        kind, original = m.lastgroup, m[0].lower() if m.lastgroup == "email" else m[0]
        new = given.get((kind, original))
        if new is None:
            new = first = surrogates.replace(kind, m[0])
            # another entity of the document has it: the surrogate's own surrogate, until one is free or all were seen
            while (kind, new) in taken or new == original != first:
                new = surrogates.replace(kind, new)
                if new is None or new == first:
                    new = first
                    break
            if new is not None:
                given[kind, original] = new
                taken.add((kind, new))
        if new is not None:
            parts += [text[at : m.start()], new]
            found.append((kind, m.start(), m.end(), new))
            at = m.end()
    if not found:
        return text, []
    parts.append(text[at:])
    if words := _name_words(text, found):
        return _mentions(text, found, words)
    return "".join(parts), found


WORD = re.compile(r"[^\W\d_]+")


def _name_words(text: str, found: list[tuple[str, int, int, str]]) -> dict[str, str]:
    """The words of the names found, titles aside, and their surrogates; initials and particles aren't names alone."""
    out: dict[str, str] = {}
    for kind, start, end, new in found:
        if kind in ("name", "greeted"):
            pairs = zip(WORD.findall(text[start:end]), WORD.findall(new), strict=True)
            out |= {a: b for a, b in list(pairs)[1:] if a != b and len(a) > 1 and a[0].isupper()}
    return out


def _mentions(text: str, found: list[tuple[str, int, int, str]], words: dict[str, str]) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates of what was found, and of the words of names wherever else they stand alone."""
    parts, every, at = [], [], 0
    for kind, start, end, new in [*found, ("", len(text), len(text), "")]:
        for m in WORD.finditer(text, at, start):
            alone = not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum() or "_" in text[max(0, m.start() - 1) : m.end() + 1])
            if alone and m[0] in words:
                parts += [text[at : m.start()], words[m[0]]]
                every.append(("mention", m.start(), m.end(), words[m[0]]))
                at = m.end()
        parts += [text[at:start], new]
        if kind:
            every.append((kind, start, end, new))
        at = end
    return "".join(parts), every


ENTITIES = "array<struct<kind: string, start: int, end: int, surrogate: string>>"


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with surrogates, the number of replaced entities, and what they were.

    Offsets are code points of the given text. A null text stays null with no entities; repeated
    rows stay and get equal surrogates; other columns are ignored; an empty table gives an empty one.
    Matches that fail the kind's own rules, such as check digits, stay as they are.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches(stream, 1000):
            done = [find_and_replace(t, surrogates) if t is not None else (None, []) for t in batch.column(1).to_pylist()]
            lists = [[dict(zip(("kind", "start", "end", "surrogate"), f, strict=True)) for f in found] for _, found in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for f in lists], pa.int64()), pa.array(lists, kind)], names=["doc_id", "text", "n_entities", "entities"])

    return pick(docs, "doc_id", "text").mapInArrow(tidied(run), f"doc_id long, text string, n_entities long, entities {ENTITIES}")


def replace_text(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns, with surrogates in ``text`` and ``n_chars`` of the new text.

    Null texts stay null, repeated rows stay equal, an empty table stays empty. Columns whose names
    differ from ``text`` by case only are another's.
    """
    text, chars = place(docs.columns, "text"), place(docs.columns, "n_chars") if "n_chars" in {n.lower() for n in docs.columns} else None

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in batches(stream, 1000):
            given = batch.column(text).to_pylist()
            new = [find_and_replace(t, surrogates)[0] if t is not None else None for t in given]
            columns = list(batch.columns)
            columns[text] = pa.array(new, pa.string())
            if chars is not None:
                old = batch.column(chars).to_pylist()
                columns[chars] = pa.array([n if a == b or a is None else len(b) for n, a, b in zip(old, given, new, strict=True)], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(tidied(run), docs.schema)


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """(kind, surrogate) that stand for more than one entity of the corpus; there should be none.

    Ids are taken to be of one text each. Mentions are left out, as they repeat a name's words. Null
    texts have none, and an empty table gives an empty one.
    """
    found = pseudonymize(docs, key).select(F.explode("entities").alias("e"), "doc_id").select("e.*", "doc_id").where("kind <> 'mention'")
    texts = pick(docs, "doc_id", "text")
    pairs = found.join(texts, "doc_id").select("kind", "surrogate", F.lower(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("original"))
    return pairs.groupBy("kind", F.lower("surrogate").alias("surrogate")).agg(F.min("original").alias("first"), F.max("original").alias("last")).where("first <> last")
