"""Chunk-wise token lookup that byte-level BPE operators share.

Byte-level BPE encodes each match of the pre-tokenizer pattern by itself. In a text whose white
space is single spaces and single line feeds, matches never cross a space or a line feed, so the
encoding of ``" word,"`` is the same wherever it stands and can be remembered. Such a text is cut
into chunks: ``word,`` stands for a space and the word, and ``\\nword,`` for a line feed and the word.
Other texts are matched whole by the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

#: Marks that, behind a letter, no match of the pattern shares with it.
MARKS = ".,!?;:%&*$#|"
ODD_SPACE = re.compile(r"[^\S \n]")


def plain(text: str) -> bool:
    """Whether white space occurs only as single spaces and line feeds between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not ("  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text) or ODD_SPACE.search(text))


def chunks(text: str) -> list[str]:
    """Of a plain text; the first one begins with a line feed that the text hasn't."""
    return ("\n" + text.replace("\n", " \n")).split(" ")


class _Numbers(dict):
    """Numbers keys as they come and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class ChunkTable:
    """Remembers the encodings of chunks in one Python worker.

    ``learn(new, table)`` gives the values of chunks that the table lacks, one list of them for each
    of the table's columns; it may look others up and give more chunks than it was asked for (that it
    adds), at the end. Beyond ``limit`` chunks, the half used least is forgotten, so memory is bounded
    on any input.
    """

    def __init__(self, learn: Callable[[list[str], ChunkTable], tuple[list, ...]], columns: int, limit: int):
        self.learn, self.limit = learn, limit
        self.numbers, self.columns, self.uses = _Numbers(), [[] for _ in range(columns)], np.zeros(0, np.int64)

    def add(self, chunk: str) -> None:
        """Another chunk that learn() gives values of."""
        self.numbers[chunk]

    def lookup(self, texts: Sequence[list[str]]) -> list[list[int]]:
        """The numbers of each text's chunks, valid until the next call."""
        if len(self.numbers) > self.limit:
            self._forget()
        number = self.numbers.__getitem__
        out = [list(map(number, parts)) for parts in texts]
        if self.numbers.new:
            new, self.numbers.new = self.numbers.new, []
            for column, values in zip(self.columns, self.learn(new, self), strict=True):
                column.extend(values)
            self.numbers.new = []
        self.uses = np.concatenate([self.uses, np.zeros(len(self.numbers) - len(self.uses), np.int64)])
        self.uses += np.bincount(np.fromiter(chain.from_iterable(out), np.int64), minlength=len(self.uses))
        return out

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        kept, names = keep.tolist(), list(self.numbers)
        self.columns = [[column[k] for k in kept] for column in self.columns]
        self.numbers = _Numbers()
        self.numbers.update((names[k], n) for n, k in enumerate(kept))
        self.uses = self.uses[keep] // 2
