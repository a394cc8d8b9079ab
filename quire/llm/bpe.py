"""Encoding with a public byte-level BPE vocabulary in linear time.

Bytes are mapped one to one to Latin-1 characters, so that a string automaton can find
every vocabulary entry. A piece is encoded by taking the longest entry at each place and
stepping back to shorter ones whenever two neighbours could not stand side by side in a
real merge result. That compatibility of neighbours is memoised. The outcome equals the
outcome of running the merges one by one, but no piece ever costs more than linear time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of the caches of a worker; a full cache is emptied, results do not depend on it.
CACHE_ENTRIES = 400_000
#: Pieces longer than this are encoded each time, so that the cache stays small.
CACHED_PIECE = 64


def parse_ranks(raw: bytes) -> list[bytes]:
    """Entries in order of their id from the ``base64 id`` lines of a rank file."""
    rows = sorted((int(number), base64.b64decode(word)) for word, number in (line.split() for line in raw.splitlines() if line))
    if [number for number, _ in rows] != list(range(len(rows))):
        raise ValueError("the ids of a rank file must run from 0 without gaps")
    return [word for _, word in rows]


class Encoder:
    """Encoder for one vocabulary: ``encode(text)`` gives the ids of a text."""

    def __init__(self, entries: list[bytes], pattern: str = PATTERN):
        self.words = entries
        self.sizes = [len(word) for word in entries]
        self.ids = {word: number for number, word in enumerate(entries)}
        self.pieces = regex.compile(pattern).findall
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._learn_merges()
        self.shorter = [self._prefix(word) for word in entries]
        self.automaton = ahocorasick.Automaton()
        for number, word in enumerate(entries):
            self.automaton.add_word(word.decode("latin-1"), number)
        self.automaton.make_automaton()

    def _learn_merges(self) -> None:
        """Find for each entry the two entries whose merge makes it."""
        for number, word in enumerate(self.words):
            self.halves.append((number, number))
            for at in range(1, len(word)):
                left, right = self.ids.get(word[:at]), self.ids.get(word[at:])
                if left is None or right is None or left >= number or right >= number:
                    continue
                if self._adjacent(left, right):
                    self.merged[left, right] = number
                    self.halves[number] = (left, right)
                    break

    def _prefix(self, word: bytes) -> int | None:
        for size in range(len(word) - 1, 0, -1):
            if (number := self.ids.get(word[:size])) is not None:
                return number
        return None

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether merging could leave ``left`` and ``right`` as neighbours.

        The two are taken apart step by step, the later merge first. If the inner ends
        would have merged with each other before, they are no neighbours.
        """
        limit = len(self.words)
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = self.halves[left][1]
                if left != limit:
                    continue
                limit = right + 1
                right = self.halves[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit = right + 1
                right = self.halves[right][0]
                if right + 1 != limit:
                    continue
                limit = left
                left = self.halves[left][1]
                if left == limit:
                    return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pair_ok.get((left, right))
        if known is None:
            if len(self.pair_ok) >= CACHE_ENTRIES:
                self.pair_ok.clear()
            known = self.pair_ok[left, right] = self._adjacent(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest: list[int] = [-1] * size
        sizes = self.sizes
        for end, number in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - sizes[number]
            if longest[start] < 0 or sizes[number] > sizes[longest[start]]:
                longest[start] = number
        reachable = bytearray(b"\x01" * (size + 1))
        out: list[int] = []
        at, candidate = 0, longest[0]
        while at < size:
            end = at + sizes[candidate]
            if reachable[end] and (not out or self.compatible(out[-1], candidate)):
                out.append(candidate)
                at = end
                if at < size:
                    candidate = longest[at]
                continue
            step = self.shorter[candidate]
            if step is None:  # nothing fits here: the entry before it was a wrong turn
                reachable[at] = 0
                candidate = out.pop()
                at -= sizes[candidate]
            else:
                candidate = step
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= CACHED_PIECE:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out.extend(ids)
        return out

    def count(self, text: str) -> int:
        return len(self.encode(text))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(raw: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(raw), pattern)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    """The rank file as a broadcast; its size is fixed by the vocabulary (under 1 MB here)."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``ids array<int>`` of every row, without special tokens.

    A null text has null ids, an empty text has an empty list; special-token strings in
    a text are ordinary text. Repeated keys or texts keep one row each. Other columns of
    ``df`` are not read. An empty table gives an empty result.
    """
    raw = _vocabulary(df, path)
    source = spread(df.select(df[key].alias("key"), df[text].alias("text")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value, pattern)
        for batch in batches:
            ids = [None if value is None else encoder.encode(value) for value in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``n_tokens int`` of every row; null for a null text, 0 for an empty one."""
    raw = _vocabulary(df, path)
    source = spread(df.select(df[key].alias("key"), df[text].alias("text")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value, pattern)
        for batch in batches:
            counts = [None if value is None else encoder.count(value) for value in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int32())], names=["key", "n_tokens"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens int").withColumnRenamed("key", key)
