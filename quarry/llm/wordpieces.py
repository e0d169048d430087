"""Token ids of whole texts by the tokenizers library, with the ids of repeated words kept.

Both pre-tokenisers used here never join what stands on the two sides of a chosen cut, so a text
is cut there and each piece is encoded once per worker: prose repeats its words.

The string of a special token that stands in a text, such as <|endoftext|>, becomes its id, as is the library's
default. No such string holds white space, so each stands in one piece. With special_as_text it is text like any
other and forges no id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

from tokenizers import Tokenizer

from .common import worker_state

#: Pieces kept per worker; when full, the worker starts anew.
KEPT_PIECES = 900_000
#: Characters of text between two calls of the tokenizer.
GROUP_CHARS = 1 << 20
#: White space that does not simply stand between two words or lines: such a text is encoded whole.
_UNEVEN = re.compile(r" (?:\s|\Z)|\n(?:\s|\Z)")
#: A word of Latin-1 letters, with or without one sign behind it: each part is one pre-token, so the library's model takes it as it is.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(_OTHERS)}
_SPACE_SIGN = _SIGNS[0x20]
_BYTES = str.maketrans({chr(b): sign for b, sign in _SIGNS.items()})


class PieceIds(dict):
    """word -> its ids as unsigned 32-bit integers, with the space before it where that counts.

    (text,) stands for a text as it is, such as the first word. What was not met before gets an empty buffer
    and a place in a list; a group of texts later, the tokenizer takes the list at once and fills the buffers.
    """

    def __init__(self, vocabulary: bytes, drops_space: bool, special_as_text: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = special_as_text
        self.drops_space = drops_space
        self.model = self.tokenizer.model
        self.line_end = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.new: list[str | tuple[str]] = []
        self.signs: dict[str, bytes] = {}

    def _word(self, word: str, lead: str) -> bytes:
        if self.drops_space:
            word = word.lower()
        if word.isascii():
            word = _SPACE_SIGN + word if lead else word
        else:
            word = (lead + word).encode("utf-8").decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _sign(self, sign: str) -> bytes:
        if sign not in self.signs:
            self.signs[sign] = array("I", [t.id for t in self.model.tokenize(sign)]).tobytes()
        return self.signs[sign]

    def __missing__(self, piece: str | tuple[str]) -> bytes | bytearray:
        text, lead = (piece[0], "") if isinstance(piece, tuple) else (piece, "" if self.drops_space else " ")
        if len(text) <= 100 and (plain := _PLAIN.fullmatch(text)):
            word, sign = plain.groups()
            if sign:
                found = self[(word,) if isinstance(piece, tuple) else word] + self._sign(sign)
            else:
                found = self._word(word, lead)
            self[piece] = found
            return found
        self.new.append(piece)
        self[piece] = buffer = bytearray()
        return buffer

    def _pieces(self, text: str) -> list[bytes | bytearray]:
        get = self.__getitem__
        if self.drops_space:
            return list(map(get, text.replace("\n", " ").split(" ")))
        if _UNEVEN.search(text):
            return [get((text,))]
        found = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            found += [get((first,)), *map(get, rest), self.line_end]
        return found[:-1]

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        found = [self._pieces(text) for text in texts]
        lead = "" if self.drops_space else " "
        new = [x[0] if isinstance(x, tuple) else lead + x for x in self.new]
        for piece, ids in zip(self.new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            buffer = self[piece]
            buffer += array("I", ids.ids).tobytes()
            if len(buffer) <= 400:
                self[piece] = bytes(buffer)
            else:
                del self[piece]
        self.new.clear()
        yield from map(b"".join, found)
        if len(self) >= KEPT_PIECES:
            self.clear()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


def piece_ids(vocabulary: bytes, drops_space: bool, special_as_text: bool = False) -> PieceIds:
    """One per worker process and vocabulary.

    drops_space: the tokenizer drops white space and never looks across it. Otherwise it must be a
    byte-level one that takes a single space with the word behind it.
    """
    return worker_state((hash(vocabulary), drops_space, special_as_text), lambda: PieceIds(vocabulary, drops_space, special_as_text))
