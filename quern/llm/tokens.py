"""Whole-text encoding with public tokenizers, sped up by remembering the ids of words.

Both vocabularies cut a text at white space before they merge anything, so the ids of a text are those of its words in
turn (a byte-level vocabulary takes a word with the blank before it). A worker keeps the ids of words it has met. A new
word is cut at plain punctuation, as the tokenizers cut it too, and its runs of Latin letters go straight to the
library's merging model; all else goes through the library's whole chain. Texts with controls, unusual white space, runs of
blanks or a special token's string go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of Latin letters before white space or plain punctuation stands alone; punctuation then starts a piece.
_PIECES = re.compile(rf" ?[{_LETTERS}]+(?![^ \n.,;:!?|#%&$*()])| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_RUN = re.compile(rf" ?[{_LETTERS}]+")
#: Words remembered by a worker in each of two generations; results don't depend on it.
REMEMBERED = 300_000
#: Pieces of other words remembered.
PIECES = 50_000
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The printable letters that stand for bytes in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """lower: the vocabulary lower-cases and drops white space; else a blank belongs to the word after it."""

    def __init__(self, path: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer


        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.tokenize = self.tokenizer.model.tokenize
        self.kind, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, text: str) -> bytes:
        """The ids of a run of Latin letters, maybe after a blank, straight from the merging model."""
        text = text.lower() if self.lower else text
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        elif text[0] == " ":
            text = self.blank + text[1:]
        return array(self.code, [t.id for t in self.tokenize(text)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            got = self.pieces[piece] = self._run(piece) if _RUN.fullmatch(piece) else self._whole(piece)
        return got

    def _letters(self, word: str) -> bytes:
        """The ids of a word of Latin letters after a blank, which is remembered as a word."""
        got = self.words.get(word) or self.older.get(word)
        if got is None:
            got = self.words[word] = self._run(word if self.lower else " " + word)
        return got

    def _word(self, word: str) -> bytes:
        """The ids of a word after a blank, from the older generation or made anew."""
        got = self.older.get(word)
        if got is None:
            head = word[:-1]
            if word.isalpha() and (word.isascii() or _RUN.fullmatch(word)):
                return self._letters(word)
            if word[-1:] in _MARKS and head.isalpha() and (head.isascii() or _RUN.fullmatch(head)):
                got = self._letters(head) + self._piece(word[-1])
            else:
                got = b"".join([self._piece(p) for p in _PIECES.findall(word if self.lower else " " + word)])
        self.words[word] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as add_special_tokens=False gives them."""
        if "  " in text and not self.lower or "<|" in text or not text.replace("\n", " ").isprintable():
            return np.frombuffer(self._whole(text), self.kind)
        if len(self.words) > REMEMBERED:
            self.words, self.older = {}, self.words
        parts = text.split() if self.lower else text.split(" ")
        found = list(map(self.words.get, parts))
        if not self.lower:
            found[0] = b"".join([self._piece(p) for p in _PIECES.findall(parts[0])])
        if None in found:
            word, at = self._word, -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    found[at] = word(parts[at])
            except ValueError:
                pass
        return np.frombuffer(b"".join(found), self.kind)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, lower: bool) -> Encoder:
    """One encoder a worker and vocabulary: Spark reuses workers, and so the remembered words."""
    key = (path, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, lower)
    return _ENCODERS[key]
