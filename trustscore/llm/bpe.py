"""Byte-level BPE: encoding with a contiguous rank array per word, and decoding.

A text is split at special tokens, then into words by the pattern of the vocabulary. A short word is held as
part ids and the ranks of adjacent pairs; the smallest rank is scanned for, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank. Words over ``SHORT`` bytes take the same merges from a
heap, because scanning them would be quadratic. Words come from a bounded cache of each Python worker.

The vocabulary is a file of the ``tokenizers`` library that every executor can read at the given path.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored by ``encode`` unless named in ``keep``.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trustscore.llm.words import SLICE_BYTES

SHORT = 96
CACHED_WORDS = 100_000
NONE = 1 << 30
#: Fixed value: how byte-level vocabularies of this family split words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable bytes themselves, others from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


class Encoder(dict):
    """Word -> ids as little-endian 32-bit numbers; computes and keeps what it has not seen."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters, vocabulary = byte_letters(), told["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in told["added_tokens"]}
        self.pieces: dict[int, bytes] = {number: bytes(letters[c] for c in piece) for piece, number in vocabulary.items()}
        self.pieces |= {number: content.encode() for content, number in self.special.items()}
        single = {piece: number for number, piece in self.pieces.items() if len(piece) == 1}
        self.bytes = [single[bytes([byte])] for byte in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 20 | vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            raw = word.encode()
            ids = self.merge(raw) if len(raw) <= SHORT else self.merge_long(raw)
            found = np.array(ids, dtype="<u4").tobytes()
            if len(raw) > SHORT:
                return found
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def merge(self, word: bytes) -> list[int]:
        """Contiguous rank array: scan for the smallest rank, delete its boundary, refresh both neighbours."""
        rank_of, merged = self.ranks.get, self.merged
        parts = [self.bytes[byte] for byte in word]
        ranks = [rank_of(left << 20 | right, NONE) for left, right in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | parts[at], NONE)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 20 | parts[at + 1], NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges in the same order, from a heap over linked parts."""
        rank_of, merged = self.ranks.get, self.merged
        parts = [self.bytes[byte] for byte in word]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                key = parts[at] << 20 | parts[after[at]]
                if (rank := rank_of(key)) is not None:
                    heapq.heappush(heap, (rank, at, key))

        for at in range(len(parts)):
            offer(at)
        while heap:
            rank, at, key = heapq.heappop(heap)
            following = after[at]
            if parts[at] < 0 or following < 0 or parts[at] << 20 | parts[following] != key:
                continue
            parts[at] = merged[rank]
            after[at] = after[following]
            if after[at] >= 0:
                before[after[at]] = at
            parts[following] = -1
            offer(before[at])
            offer(at)
        return [part for part in parts if part >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        find = self.__getitem__
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.extend(map(find, self.words(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with its ``ids`` (little-endian 32-bit numbers) and their ``decoded`` text."""
    fields = [documents.schema[name] for name in keep]
    if {"ids", "decoded"} & set(keep) or "text" in keep:
        raise ValueError("kept columns must not be named text, ids or decoded")
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            column, start = batch.column("text"), 0
            while start < batch.num_rows:
                ids, texts, held = [], [], 0
                while start + len(ids) < batch.num_rows and (not ids or held < SLICE_BYTES):
                    text = column[start + len(ids)].as_py() or ""
                    ids.append(known.encode(text))
                    texts.append(known.decode(ids[-1]))
                    held += len(text)
                kept = [batch.column(name).slice(start, len(ids)) for name in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=[*keep, "ids", "decoded"]
                )
                start += len(ids)

    return documents.select(*keep, "text").mapInArrow(run, f"{schema}, ids binary, decoded string")
