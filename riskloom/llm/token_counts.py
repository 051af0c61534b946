"""Token counts by a compiled finite-state transducer.

Two machines are compiled from the vocabulary file, state by state as texts
need them.  The splitter reads characters by class (letter, number, white
space, other; the classes are asked of the library's own splitter) and tells
where pieces begin.  Inside a piece, the merge machine reads bytes: the last
token of a merged prefix is the one token that ends there and stays apart from
the last token before it, so a state is the longest suffix that may still grow
into a token, with the last token and relative count at each place inside it.
Every transition carries the change of the number of tokens; a merge that a
byte completes makes it negative.

A text is cut into chunks.  The map of a chunk (its count and end state for
any state it is entered in) is constant from its first place where a piece
begins whatever came before; only the characters before that place depend on
the entry state.  Maps compose associatively, and a scan by pairs joins them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_of
from .tokens import _PLAIN, _byte_letters, _Memory, vocabulary

CHUNK = 1 << 16
#: Compiled states that a worker holds at most; beyond, compilation starts anew.
STATES = 400_000
LETTER, NUMBER, OTHER, SPACE = range(4)


class MergeMachine:
    """Bytes of one piece -> number of tokens, by transitions with count changes."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], tokens: set[bytes]):
        self.merges, self.tokens = merges, tokens
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t))}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        #: state 0 is the start of a piece; a state's key is (suffix, ((length, last token, relative count), ...)): what
        #: stands before each ending of the suffix that may grow into a token
        self.keys = [(b"", ((0, b"", 0),))]
        self.numbers = {self.keys[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def merge(self, data: bytes) -> list[bytes]:
        """Merge by rank from single bytes; for compiling only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: bytes, token: bytes) -> bool:
        """May ``token`` follow the last token ``before`` (empty: start of the piece)?"""
        if token not in self.tokens:
            return False
        if token not in self.whole:
            self.whole[token] = self.merge(token) == [token]
        if not before or not self.whole[token]:
            return self.whole[token]
        pair = (before, token)
        if pair not in self.apart:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            self.apart[pair] = self.merge(before + token) == [before, token]
        return self.apart[pair]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count), compiled on first use."""
        known = self.steps[state].get(byte)
        if known:
            return known
        suffix, marks = self.keys[state]
        grown = suffix + bytes([byte])
        for k, last, count in marks:
            token = grown[len(suffix) - k:]
            if self._fits(last, token):
                break
        else:
            raise ValueError("the vocabulary does not cover every byte")
        change = count + 1
        start = 0
        while start < len(grown) and grown[start:] not in self.prefixes:
            start += 1
        suffix = grown[start:]
        marks = ((0, token, 0), *((k + 1, u, c - change) for k, u, c in marks
                                  if k < len(suffix) and grown[len(grown) - k - 1:] in self.prefixes))
        key = (suffix, marks)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        self.steps[state][byte] = (number, change)
        return number, change

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        steps, total = self.steps, 0
        for byte in data:
            got = steps[state].get(byte) or self.step(state, byte)
            state = got[0]
            total += got[1]
        return state, total


#: Splitter states: (mode, merge state, pending text).  Pending text is not counted yet.
START = ("start", 0, "")
_MODES = {LETTER: "letters", NUMBER: "numbers", OTHER: "others"}
_SYNC = re.compile(r"(?<=\S)(?= )")


class Transducer:
    """Counts tokens of whole texts as the library does, without calling it per text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.loads(Path(path).read_text())
        back = {c: b for b, c in _byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = MergeMachine({(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)},
                                  {raw(t) for t in model["vocab"]})
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.at_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.classes: dict[str, int] = {}
        self.first = _Memory(lambda word: self._whole_piece(word))
        self.later = _Memory(lambda word: self._whole_piece(" " + word))

    def kind(self, ch: str) -> int:
        """Class of a character, as the library's splitter treats it."""
        got = self.classes.get(ch)
        if got is None:
            got = next((k for k, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if len(self.split(before + ch)) == 1),
                       SPACE)
            self.classes[ch] = got
        return got

    def _enter(self, lead: str, ch: str) -> tuple[tuple, int]:
        """Begin a piece with ``lead`` (nothing or one space) and ``ch``."""
        kind = self.kind(ch)
        if kind == SPACE:
            return ("space", 0, ch), 0
        if ch == "'" and not lead:
            return ("quote", 0, ch), 0
        state, n = self.merge.run(0, (lead + ch).encode())
        return (_MODES[kind], state, ""), n

    def next(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """One character: (state, change of the count)."""
        mode, merged, pending = state
        if mode == "start":
            return self._enter("", ch)
        kind = self.kind(ch)
        if mode == "space":  # a run of white space: all but its last character are one piece
            if kind == SPACE:
                merged, n = self.merge.run(merged, pending.encode())
                return ("space", merged, ch), n
            if pending == " ":
                return self._enter(" ", ch)
            n = self.merge.run(0, pending.encode())[1]
            new, m = self._enter("", ch)
            return new, n + m
        if mode == "quote":
            whole = pending + ch
            if whole in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                return START, self.merge.run(0, whole.encode())[1]
            if whole in ("'r", "'v", "'l"):
                return ("quote", 0, whole), 0
            if len(pending) == 1 and kind == OTHER:
                merged, n = self.merge.run(0, whole.encode())
                return ("others", merged, ""), n
            total, state = 0, START
            if len(pending) == 2:
                total = self.merge.run(0, b"'")[1]
                merged, n = self.merge.run(0, pending[1:].encode())
                state, total = ("letters", merged, ""), total + n
                new, n = self.next(state, ch)
                return new, total + n
            total = self.merge.run(0, b"'")[1]
            new, n = self._enter("", ch)
            return new, total + n
        if _MODES.get(kind) == mode:
            merged, n = self.merge.run(merged, ch.encode())
            return (mode, merged, ""), n
        return self._enter("", ch)

    def close(self, state: tuple) -> int:
        """Count of what is pending when the text, or a piece for certain, ends here."""
        mode, merged, pending = state
        if mode == "space":
            return self.merge.run(merged, pending.encode())[1]
        if mode == "quote":
            return sum(self.merge.run(0, p.encode())[1] for p in pending)
        return 0

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for ch in text:
            state, n = self.next(state, ch)
            total += n
        return state, total

    def _whole_piece(self, text: str) -> int:
        core = text.rstrip(".,;:!?")
        if _PLAIN(core[text.startswith(" "):]):  # letters, then marks: two pieces at most
            n = self.merge.run(0, core.encode())[1] + self.merge.run(0, text[len(core):].encode())[1]
            if len(self.merge.keys) > STATES:
                self.merge.reset()
            return n
        state, n = self.run(START, text)
        if len(self.merge.keys) > STATES:
            n += self.close(state)
            self.merge.reset()
            return n
        return n + self.close(state)

    def chunk_map(self, chunk: str) -> tuple[str, int, tuple | None]:
        """(characters before the first certain place, count from there, end state or None without such a place)."""
        at = _SYNC.search(chunk)
        if not at:
            return chunk, 0, None
        lead, rest = chunk[:at.start()], chunk[at.start():]
        cut = rest.rfind(" ")  # the last word stays open
        if cut > 0 and not rest[cut - 1].isspace() and rest[:cut].replace("\n", " ").split(" ")[1:] == rest[:cut].split():
            first, *lines = rest[1:cut].split("\n")
            words = first.split(" ")
            total = sum(map(self.later.__getitem__, words))
            for line in lines:
                words = line.split(" ")
                # a line feed by itself is a piece, and a token
                total += 1 + self.first[words[0]] + sum(map(self.later.__getitem__, words[1:]))
            state, n = self.run(START, rest[cut:])
            return lead, total + n, state
        state, n = self.run(START, rest)
        return lead, n, state

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + n, state
        return a[0], a[1] + n + self.close(state) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """Composition of all maps, by pairs of neighbours."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def _count(self, text: str) -> int:
        if not text:
            return 0
        lead, n, state = self.scan([self.chunk_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)])
        entry, m = self.run(START, lead)
        return m + self.close(entry) + (n + self.close(state) if state is not None else 0)

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special string is one token and parts the text, as the library does by default."""
        if self.at_special and self.at_special.search(text):
            parts = self.at_special.split(text)
            return sum(map(self._count, parts)) + len(parts) - 1
        return self._count(text)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One machine for each worker process and vocabulary."""
    return Transducer(path)


def token_counts(docs: DataFrame, vocab: str | None = None, limit: int = 1024, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null text counts as empty: 0 tokens.  Repeated rows are counted each; an empty table gives no rows; other
    columns are ignored.  ``vocab`` is a byte-level BPE file of the tokenizers library.  No shuffle.
    """
    path = vocab or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            counts = [machine.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    body = text_of(docs, text)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), body.alias("text"),
                       F.octet_length(body).cast("long").alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
