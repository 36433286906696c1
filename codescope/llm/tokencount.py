"""Token counts by a linear longest-match automaton (operator 8).

Greedy word-piece splitting takes the longest piece that fits, again and again. The trie of the
pieces has failure links: where no letter follows, the link leads to what is left after the
pieces that greedy splitting would take off the front, and the number of those pieces is stored
beside it. A word is read once, and its pieces are counted but never built.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codescope.llm.encoding import BYTE_LETTERS

WORD = re.compile(r"[^\W\d_]+|\d|[^\w\s]+|_+")
REMEMBERED = 200_000
ROOT = 0


class Automaton:
    """``first`` are the pieces that start a word, ``later`` those that go on with it. A word that
    cannot be split counts as one unknown piece."""

    def __init__(self, first: set[str], later: set[str]):
        # Node 0 starts a word; node 1 stands after a taken piece.
        self.next: list[dict[str, int]] = [{}, {}]
        self.final = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        self.final.append(False)
                self.final[node] = bool(piece) or self.final[node]
        self._link()

    def _link(self) -> None:
        """Breadth first: a node's failure state and popped count follow from its parent's."""
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if self.final[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    state, pops = self.fail[node], self.popped[node]
                    while state >= 0 and c not in self.next[state]:
                        pops += self.popped[state]
                        state = self.fail[state]
                    if state >= 0:
                        self.fail[child], self.popped[child] = self.next[state][c], pops
                queue.append(child)

    def count(self, word: str) -> int:
        """The number of pieces of one word."""
        node, pieces = ROOT, 0
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return 1
                pieces += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node > 1:  # what was read last is taken off as well
            if self.fail[node] < 0:
                return 1
            pieces += self.popped[node]
            node = self.fail[node]
        return pieces


def word_end_vocabulary(path: str, end: str = "</w>") -> tuple[set[str], set[str]]:
    """The pieces of a ``tokenizers`` file whose pieces at a word's end carry a mark. Pieces are
    taken as they are, in the file's byte letters, with the mark as the letter ``\\n``."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = {p[: -len(end)] + "\n" if p.endswith(end) else p for p in vocabulary}
    return pieces, pieces


class Counter:
    """Counts pieces of whole texts; words met before are looked up, at most ``REMEMBERED``."""

    def __init__(self, path: str):
        self.automaton = Automaton(*word_end_vocabulary(path))
        self.letters = BYTE_LETTERS
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        return self.automaton.count("".join(self.letters[b] for b in word.encode("utf-8", "replace")) + "\n")

    def count(self, text: str) -> tuple[int, int]:
        """(words, pieces) of a text."""
        words, known, total = WORD.findall(text.lower()), self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[w] = self._word(w)
            total += n
        return len(words), total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def counts(text: Column, vocabulary: str | None = None) -> Column:
    """struct(n_words, n_pieces) of a text: lower-cased runs of letters, single digits, and runs of
    other signs are words. Null and empty texts have none. Whole texts are read."""
    path = vocabulary or default_path()

    @F.pandas_udf("n_words long, n_pieces long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = counter(path).count
        for some in texts:
            yield pd.DataFrame([of(t) for t in some], columns=["n_words", "n_pieces"])

    return count(F.coalesce(text, F.lit("")))


def with_counts(docs: DataFrame, text: str = "text", name: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the struct of ``counts`` under ``name`` (in place of a column of that name)."""
    return docs.withColumn(name, counts(F.col(f"`{text}`"), vocabulary))
