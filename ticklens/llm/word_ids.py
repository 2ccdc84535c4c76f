"""Token ids of the word-level BPE vocabulary, by the tokenizers library, with a cache of words.

The vocabulary drops white space and never merges across it, so the ids of a text are those of
its white-space separated words in turn.  Frequent words are then looked up and only new ones go
through the library.  A text that holds any other separator than ASCII white space goes through
the library whole.  ``tests/llm`` compares both ways.
"""
from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: Characters that some libraries take for white space and others don't.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: Latin letters, which marks may follow, a part of their own: lower-casing is letter by letter and
#: composition changes nothing.  An apostrophe is none, it may begin a part with letters.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds(dict):
    """Maps a word to its ids (unsigned 32-bit, in the machine's order: little-endian); fills itself, up
    to ``most`` words."""

    def __init__(self, path: str, most: int = 1_250_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.most = most
        # the vocabulary spells bytes as printable characters, 188 of them as themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        """A lower-case Latin word that is one part of a text."""
        spelt = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        if letters.isascii() and letters.isalpha() or LATIN.fullmatch(letters):
            low = letters.lower()
            if low != word:  # letters are looked up alone, then the marks; new ones are kept without them
                got, mark = self.get(low), word[len(letters) :]
                new = got is None
                if new:
                    got = self.keep(low, self.part(low))
                if mark:
                    got += self[mark]
                if new:
                    return got
            else:
                got = self.part(word)
        else:
            got = self.whole(word)
        return self.keep(word, got)

    def keep(self, word: str, got: bytes) -> bytes:
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, without special tokens."""
        if ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per vocabulary file and Python worker."""
    return WordIds(path)
