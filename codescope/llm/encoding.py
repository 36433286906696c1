"""Token ids of whole texts by a ``tokenizers`` file, with the words met before remembered.

Byte-level BPE never merges across the start of a space before a word, nor across a line
break before one, so a text's ids are those of its words one after the other. Text in words
repeats; most are looked up, and only new ones are encoded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizer's pattern sees it.
WIDE = f"{chr(0x85)}{chr(0xA0)}{chr(0x1680)}{chr(0x2000)}-{chr(0x200A)}{chr(0x2028)}{chr(0x2029)}{chr(0x202F)}{chr(0x205F)}{chr(0x3000)}"
SPACE = f"\t-\r {WIDE}"
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
# Anything but single spaces and line breaks between words, and none at the end.
IRREGULAR = f"[ \n][ \n]|[\t\x0b-\r{WIDE}]|[ \n]\\z"
# Letters below are letters in every version of Unicode.
LETTERS_END = chr(0x530)
WORDS_AT_ONCE = 20_000
ENDS = 10_000
TEXTS_AT_ONCE, BYTES_AT_ONCE = 4096, 1 << 24
ID = np.dtype("<u4")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 letters for
    themselves, the others from code 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
BREAK = BYTE_LETTERS[ord("\n")]
_LETTER_CODES = np.array([ord(BYTE_LETTERS[b]) for b in range(256)], "<u4")
# Letters, and a stop, commas or other signs behind them, which are a piece of their own.
ENDED = re.compile(rf"(.*[^\W\d_{LETTERS_END}-\U0010ffff])([.,;:!?#$%&*]+)", re.DOTALL)


def _spelled(texts: str) -> str:
    return _LETTER_CODES[np.frombuffer(texts.encode(), np.uint8)].tobytes().decode("utf-32-le")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers.

    Keys: ``word`` stands for the word after a space, ``\\nword`` for it after a line break.
    Two generations of at most ``limit`` words are kept, so memory stays bounded.
    """

    def __init__(self, path: str, limit: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words of letters, which are one piece for it: spelled in byte
        # letters beforehand, they need no splitting but at line breaks.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(BREAK, "isolated")
        self.limit = limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([IRREGULAR, *map(re.escape, self.special)])
        self.newline = self._direct("\n")
        self.young, self.old = self._known(), {}
        if len(self.newline) != ID.itemsize or self._direct("a\n b") != self._direct("a") + self.newline + self._direct(" b"):
            raise ValueError("words are only remembered for byte-level BPE with spaces before words")
        self.mark = int(np.frombuffer(self.newline, ID)[0])
        self.ends: dict[str, bytes] = {}

    def _known(self) -> dict[str, bytes]:
        return {"": b"", "\n": self.newline}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _learn(self, words: list[str]) -> None:
        letters, others = [], []
        for w in words:
            body = w[1:] if w[0] == "\n" else w
            (letters if body.isalpha() and (body.isascii() or max(body) < LETTERS_END) else others).append(w)
        for i in range(0, len(letters), WORDS_AT_ONCE):
            part = letters[i : i + WORDS_AT_ONCE]
            self._learn_by(self.words, part, _spelled(self._lines(part)))
        for i in range(0, len(others), WORDS_AT_ONCE):
            part = others[i : i + WORDS_AT_ONCE]
            self._learn_by(self.tokenizer, part, self._lines(part))

    @staticmethod
    def _lines(words: list[str]) -> str:
        return "\n".join([w[1:] if w[0] == "\n" else " " + w for w in words])

    def _learn_by(self, tokenizer, words: list[str], lines: str) -> None:
        ids = np.array(tokenizer.encode_batch_fast([lines], add_special_tokens=False)[0].ids, ID)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids)) * ID.itemsize
        if len(ends) != len(words):
            raise ValueError("a word's ids hold a line break")
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist()):
            self.young[word] = self.newline + raw[start:end] if word[0] == "\n" else raw[start:end]
            start = end + ID.itemsize

    def _recall(self, words: set[str]) -> set[str]:
        """Move what the older generation knows to the younger; the rest is new."""
        known = words & self.old.keys()
        for k in known:
            self.young[k] = self.old[k]
        return words - known

    def _lookup(self, keys: list[str]) -> list[bytes]:
        young = self.young
        values = list(map(young.get, keys))
        new = self._recall({k for k, v in zip(keys, values) if v is None})
        if new:
            parts = {k: m.groups() for k in new if not k[-1].isalpha() and (m := ENDED.fullmatch(k))}
            new.difference_update(parts)
            new |= self._recall({w for w, _ in parts.values() if w not in young})
            self._learn(list(new))
            for k, (word, end) in parts.items():
                if end not in self.ends:
                    self.ends[end] = self._direct(end)
                young[k] = young[word] + self.ends[end]
                if len(self.ends) > ENDS:
                    self.ends.clear()
        values = [young[k] if v is None else v for k, v in zip(keys, values)]
        if len(young) > self.limit:
            self.old, self.young = young, self._known()
        return values

    def _irregular(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # a special token parts the white space around it
            return self._direct(text)
        chunks, out = CHUNKS.findall(text), []
        keys = [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else "\n" + c for c in chunks]
        blank = [c.isspace() or any(x.isspace() for x in c[1:]) for c in chunks]
        values = iter(self._lookup([k for k, b in zip(keys, blank) if not b]))
        for chunk, key, b in zip(chunks, keys, blank):
            out.append(self._direct(chunk) if b else (v := next(values))[ID.itemsize if key[0] == "\n" else 0 :])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(column, self.irregular))
        # The line break before the first word, whose ids are cut off again, makes it one like others.
        regular = pc.binary_join_element_wise(pa.scalar("\n", column.type), column.filter(plain), pa.scalar("", column.type))
        words = pc.split_pattern(pc.replace_substring(regular, "\n", " \n"), " ")
        distinct = words.flatten().dictionary_encode()
        known = pa.array(self._lookup(distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids = known.take(distinct.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][words.offsets.to_numpy()]
        raw = memoryview(ids.buffers()[2] or b"")
        found = iter([bytes(raw[start + ID.itemsize : end]) for start, end in zip(at[:-1].tolist(), at[1:].tolist())])
        return [next(found) if whole else self._irregular(text) for text, whole in zip(texts, plain.to_pylist())]


def slices(batch: pa.RecordBatch, texts: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Rows to be encoded at once, up to ``texts`` and about ``BYTES_AT_ONCE`` bytes: of more rows,
    fewer words are looked up twice, but more memory is held."""
    step = min(texts, max(1, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The one of this Python worker, which outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
