"""Token ids of whole texts through the tokenizers library, with a bounded word memory.

The vocabulary's pre-tokenizer never joins text across ASCII white space, and its
normaliser lower-cases, so a text's ids are the concatenated ids of its white-space
separated words with A-Z lowered. Nor does it join a letter or digit with the ASCII marks
after it, so a word's closing marks have ids of their own. Each distinct word without them
is encoded once per worker, by the library, and looked up afterwards. Texts that could
hold special tokens go to the library whole, as do those of other vocabularies
(`by_word=False`).
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np

from lodestar.llm.memory import remembered

END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: words with and without closing marks that a worker remembers, in each of two generations
MEMORY, STEMS = 100_000, 150_000
#: bytes of a text that are split at a time
BLOCK = 1 << 22
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Recent(dict):
    """What was looked up of late: two generations of at most `limit` entries each.

    When the younger is full it becomes the older one, and what is still asked for moves
    back into the younger, so frequent words stay.
    """

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.older = limit, {}

    def make(self, word: bytes) -> bytes:
        raise NotImplementedError

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Stems(_Recent):
    """Ids of words; those of lower-case Latin letters alone are one piece, which goes to the library's model at once."""

    def __init__(self, tokenizer, limit: int) -> None:
        super().__init__(limit)
        self.encode, self.tokenize, self.letters = tokenizer.encode, tokenizer.model.tokenize, _byte_letters()

    def make(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters, lowered before
            return array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250" and text == text.lower():
            return array("I", [t.id for t in self.tokenize(word.decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", self.encode(text, None, False, False).ids).tobytes()


class _Words(_Recent):
    def __init__(self, stems: _Stems, limit: int) -> None:
        super().__init__(limit)
        self.stems = stems

    def make(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem and len(stem) < len(word) and (stem[-1:].isalnum() or stem.decode()[-1].lower()[-1].isalpha()):
            return self.stems[stem] + self.stems[word[len(stem) :]]
        return self.stems[word]


class Encoder:
    def __init__(self, path: str, by_word: bool = True, memory: int = MEMORY, stems: int = STEMS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        self.words = _Words(_Stems(self.tokenizer, stems), memory)

    def _split(self, raw: bytes, block: int) -> Iterator[list[bytes]]:
        """Words in blocks, so that a huge text isn't held as a list of all its words."""
        at = 0
        while at < len(raw):
            end = at + block
            if end < len(raw):
                cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
                end = cut if cut > at else end
                while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":  # one word longer than a block
                    end += 1
            yield raw[at:end].split()
            at = end

    def one(self, text: str | None, block: int = BLOCK) -> bytes:
        """The ids of a text, 4 bytes each, little-endian; null as the empty text."""
        if not text:
            return b""
        if not self.by_word or "<|" in text:
            return np.array(self.tokenizer.encode(text, None, False, False).ids, dtype="<u4").tobytes()
        ids, raw = self.words.__getitem__, text.encode().lower()
        if len(raw) <= block:
            return b"".join(map(ids, raw.split()))
        return b"".join(b"".join(map(ids, words)) for words in self._split(raw, block))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(text) for text in texts]


@remembered(2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process. Without a path: the public word-BPE vocabulary."""
    if path is None:
        import public_tokenizers

        return Encoder(public_tokenizers.path(VOCABULARY))
    return Encoder(path, by_word=False)
