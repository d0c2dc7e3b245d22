"""Exact subword ids at corpus speed: the tokenizers library encodes each word
once in a worker, repeats come from a bounded memory.

Both vocabularies split text before merging, and no token crosses such a split,
so ids of a text are the ids of its words joined.  A text in which a split can't
be told from the word alone (runs of blanks, unusual white space) goes to the
library whole.
"""

from __future__ import annotations

import array
import functools

import numpy as np

from .common import MEMO_BYTES, Memo

_MARKS = ".,;:!?$%&*#"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TABLE = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


#: What a blank is there.
_BLANK = " ".translate(_TABLE)


class _Odd(Exception):
    """This text can't be split by single blanks."""


class Encoder:
    """Ids of texts under a tokenizers file, with add_special_tokens=False."""

    def __init__(self, path: str, budget: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        wide = self.tokenizer.get_vocab_size() > 65536
        self.code, self.dtype = ("I", np.uint32) if wide else ("H", np.uint16)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        #: Whether white space vanishes and case is folded, or blanks begin words.
        self.drops_space = ids("a b") == ids("a") + ids("b")
        self.folds = ids("AB") == ids("ab")
        #: word -> bytes of its ids (native unsigned ints of the encoder's width).
        self.memory = Memo(self.miss, budget)
        #: Runs of marks are few.
        self.marks = Memo(self.whole, 1 << 20)
        self.newline = b"" if self.drops_space else self.whole("\n")

    def pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, text: str) -> bytes:
        """A word that the vocabulary splits no further: straight to its merges."""
        letters = text.encode().decode("latin-1").translate(_TABLE) if not text.isascii() else _BLANK + text[1:] if text[0] == " " else text
        return array.array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def miss(self, word: str) -> bytes:
        if not word:
            return b"" if self.drops_space else self.whole(" ")
        base = word.rstrip(_MARKS)
        begins = not self.drops_space and word[0] == "\n"
        bare = base[1:] if begins else base
        if bare.isalpha() and (bare.isascii() or max(bare) < "Ā"):
            if base != word:
                # Marks after a letter are a split of their own.
                return self.memory[base] + self.marks[word[len(base):]]
            if begins:
                return self.newline + self.word(bare)
            if not self.drops_space:
                return self.word(" " + bare)
            if self.folds and (low := bare.lower()) != bare:
                return self.memory[low]
            return self.word(bare)
        if not self.drops_space:
            if word != "\n" and any(c.isspace() for c in word[len(word) > 1:]):
                raise _Odd
            if base and base != word and base[-1] < "Ā" and base[-1].isalpha():
                return self.memory[base] + self.marks[word[len(base):]]
            return self.whole(word if begins else " " + word)
        if base and base != word and base[-1] < "Ā" and base[-1].isalpha():
            return self.memory[base] + self.marks[word[len(base):]]
        return self.whole(word)

    def raw(self, text: str | None) -> bytes:
        """The ids as native unsigned ints of the encoder's width; null is an empty text."""
        if not text:
            return b""
        get = self.memory.__getitem__
        if self.drops_space:
            return b"".join(map(get, text.replace("\n", " ").split(" ")))
        if "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text:
            first, *rest = text.replace("\n", " \n").split(" ")
            try:
                return b"".join([self.whole(first) if first else b"", *map(get, rest)])
            except _Odd:
                pass
        return self.whole(text)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids; null is an empty text."""
        return np.frombuffer(self.raw(text), self.dtype)


@functools.lru_cache(maxsize=4)
def encoder(path: str, budget: int = MEMO_BYTES) -> Encoder:
    """One for each Python worker, file and size of its memory."""
    return Encoder(path, budget)
