"""Token ids of whole texts by the tokenizers library, with remembered words.

A text whose white space is single spaces and line feeds is cut into lines and
words.  Both vocabularies begin a new piece at such a space and around such a
line feed whatever the characters beside them are, so the ids of the text are
those of its words in order, and a word seen before needs no second encoding.
A word of Latin letters with closing punctuation is one or two pieces for
either vocabulary and goes straight to the library's BPE model; every other
word, and every text with other white space, takes the library's whole path.
The memory holds a bounded number of words.  Many texts at once (``ids_of``) are
cut by Arrow, which numbers their different words: each is looked up once, and
its ids are taken as often as the word occurs.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that each of a worker's tables holds at most.
REMEMBERED = 600_000
#: Characters of texts cut at once; a longer text is cut alone.
TOGETHER = 8 << 20
#: Letters that are letters, precomposed and of simple case in every Unicode version.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-þ]+").fullmatch

#: Closing punctuation: a run of it is one piece after letters, and no special string has it only.
_MARKS = ".,;:!?*%$#&"


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabulary files."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Memory(dict):
    """A bounded table that computes what it lacks; the older half goes when it is full."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class TextEncoder:
    """``ids(text)``: little-endian uint32 ids as bytes, equal to the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(Path(path).read_text())
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        # a normaliser in lower case comes with a splitter that drops white space
        self.lower = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.letters = _byte_letters()
        self.first = _Memory(lambda word: self._word("", word))  # words at the start of a line
        self.later = self.first if self.lower else _Memory(lambda word: self._word(" ", word))
        self.marks = lru_cache(4096)(self._piece)  # closing punctuation
        self.feed = self.whole("\n")

    def _piece(self, piece: str) -> bytes:
        mapped = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(
            self.letters)
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _word(self, space: str, word: str) -> bytes | None:
        """None for what is no word: nothing, or other white space inside."""
        core = word.rstrip(_MARKS)
        if not core or not _PLAIN(core):
            return self.whole(space + word) if word.split() == [word] else None
        marks = word[len(core):]
        if self.lower:
            core = core.lower()
        if marks or core != word:  # the bare word has a place of its own
            bare = (self.later if space else self.first)[core]
            return bare + self.marks(marks) if marks else bare
        return self._piece(core if self.lower else space + core)

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def ids_of(self, texts: Iterable[str], together: int | None = None) -> Iterator[bytes]:
        """``ids`` of each text, in order; ``together`` (``TOGETHER``) characters are cut at once."""
        held, chars, together = [], 0, together or TOGETHER
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= together:
                yield from self._together(held)
                held, chars = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[bytes]:
        # a word that begins with a line feed is the first of its line
        words = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        numbered = words.flatten().dictionary_encode()
        first, later, feed = self.first, self.later, self.feed
        table = []
        for w in numbered.dictionary.to_pylist():
            if w[:1] == "\n":
                ids = first[w[1:]]
                table.append(None if ids is None else feed + ids)
            else:
                table.append(later[w])
        ids = pa.array(table, pa.large_binary()).take(numbered.indices)
        at = words.offsets.to_numpy()
        odd = np.concatenate([[0], np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))])[at]
        data = ids.buffers()[2]
        data = data.to_pybytes() if data else b""
        ends = np.frombuffer(ids.buffers()[1], np.int64)[at].tolist()
        skip = len(feed)  # no feed before the first line
        return [data[a + skip:b] if s else self.whole(t)
                for t, s, a, b in zip(texts, (odd[1:] == odd[:-1]).tolist(), ends, ends[1:], strict=False)]

    def ids(self, text: str) -> bytes:
        if text.replace("\n", " ").split(" ") != text.split():
            return self.whole(text)
        out = []
        later = self.later.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]])
            out += map(later, words[1:])
            out.append(self.feed)
        out.pop()
        return b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    return TextEncoder(path)
