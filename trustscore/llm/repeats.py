"""Substring de-duplication of word windows, level by level.

Windows repeated at one length alone are taken on to about twice that length:

1. *Anchors.* Every window of ``length`` words holds the same smallest-hash sequence of ``length // 2``
   words, wherever it occurs. Only these anchors (about two in ``length // 2 + 3`` words) are compared
   over all documents; a window whose anchor occurs in one document alone cannot repeat.
2. *Stretches.* An anchor that repeats is extended to everything its windows cover (up to twice the
   window less the anchor). A stretch that also stands in a document with a smaller id settles all its
   windows at once: that covers the inside of copies, one entry for several windows.
3. *Windows.* Only anchors with several stretches, where not settled, are cut into single windows; each goes
   if it also starts in a document with a smaller id. The smallest document of any stretch is never settled
   in step 2, so every window keeps its witness here.

Each level compares entries (key, content hash, document) in two places. A block of documents first settles what
its own documents decide, so a passage in a third of all documents leaves one entry per block. The rest is packed
per key range (sorted keys, compressed) and decided range by range; the number of ranges follows the size of the
table. What is decided returns to its document. Texts move compressed, once to find the stretches and once to cut.

Defined cases: null text has no words; a null doc_id counts as the largest id; rows that share a doc_id
are judged each by its own text (they are no smaller than each other); texts shorter than ``length`` keep
all words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustscore.llm.words import RollingHash, Words, mix, repeat_ranges, sliced_words
from trustscore.session import materialized

LARGEST = (1 << 63) - 1
KEY_BITS = 48
BLOCK_ENTRIES = 500_000  # entries that a task holds before it settles and sends them
RANGE_BYTES = 2_000_000  # bytes of text for each key range
SETTLED, UNDECIDED = 0, 1
PACKED = "p long, local boolean, level string, blob binary"
DECIDED = "d long, key long, hash long, state tinyint"


class _Anchors:
    """Anchors of some texts and the run of windows each stands for."""

    def __init__(self, words: Words, length: int):
        short = length // 2
        self.words, self.length = words, length
        count = len(words.hashes)
        last = np.repeat(words.first[1:], np.diff(words.first)) if count else np.zeros(0, np.int64)
        grams = max(0, count - short + 1)
        at = np.arange(grams)
        rolled = RollingHash(words.hashes, 0)
        self._rolled = (rolled, RollingHash(mix(words.hashes + np.uint64(1)), 1))
        key = rolled.windows(at, at + short)
        smallest, place = key, at
        span, wanted = 1, length - short + 1
        while span < wanted and len(smallest):
            step = min(span, wanted - span)
            left, right = smallest[: len(smallest) - step], smallest[step:]
            later = right < left
            place = np.where(later, place[step:], place[: len(left)])
            smallest = np.where(later, right, left)
            span += step
        starts = np.arange(len(smallest))
        whole = starts + length <= last[: len(smallest)]
        starts, place = starts[whole], place[whole]
        row = words.row[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        self.row = row[begin]
        self.key = (key[place[begin]] >> np.uint64(64 - KEY_BITS)).astype(np.int64)
        self.start = starts[begin]
        self.windows = np.diff(np.append(begin, len(starts)))
        self.stop = self.start + self.windows - 1 + length

    def stretches(self) -> np.ndarray:
        """(anchor key, hash of all words its windows cover): together they name a stretch."""
        return np.stack([self.key.view(np.uint64), self._rolled[0].windows(self.start, self.stop)], axis=1)

    def single_windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, name) of the windows of the chosen anchors; two hashes name a window."""
        start = repeat_ranges(self.start[chosen], self.windows[chosen])
        first, second = (rolled.windows(start, start + self.length) for rolled in self._rolled)
        names = np.stack([first >> np.uint64(64 - KEY_BITS), second], axis=1)
        return np.repeat(self.row[chosen], self.windows[chosen]), start, names


def _pairs(values: np.ndarray) -> np.ndarray:
    """(n, 2) hashes as n comparable 16-byte values."""
    return np.ascontiguousarray(values).view([("a", np.uint64), ("b", np.uint64)]).ravel()


def _within(row: np.ndarray, keys: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Whether each key is in the list of its row; keys are grouped by row."""
    found = np.zeros(len(keys), dtype=bool)
    bounds = np.searchsorted(row, np.arange(len(lists) + 1))
    for number, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:])):
        if stop > start and len(lists[number]):
            found[start:stop] = np.isin(keys[start:stop], lists[number])
    return found


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Run number of each row of columns sorted together."""
    new = np.zeros(len(sorted_columns[0]), dtype=np.int64)
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when neighbours are close."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


class Entries:
    """Entries (key, content hash, document, mark) and their packed form."""

    def __init__(self, keys: np.ndarray, hashes: np.ndarray, d: np.ndarray, marks: np.ndarray):
        self.keys, self.hashes, self.d, self.marks = keys, hashes, d, marks

    def __getitem__(self, chosen: np.ndarray | slice) -> "Entries":
        return Entries(self.keys[chosen], self.hashes[chosen], self.d[chosen], self.marks[chosen])

    def packed(self) -> bytes:
        steps = np.diff(self.keys, prepend=0)
        raw = _planes(steps) + _planes(self.hashes) + _planes(self.d) + self.marks.tobytes()
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @staticmethod
    def unpacked(blobs: list[bytes]) -> "Entries":
        press, parts = zstandard.ZstdDecompressor(), [[], [], [], []]
        for blob in blobs:
            raw = np.frombuffer(press.decompress(blob), dtype=np.uint8)
            count = len(raw) // 25
            numbers = [
                np.ascontiguousarray(raw[8 * count * i : 8 * count * (i + 1)].reshape(8, count).T).view(np.int64).ravel()
                for i in range(3)
            ]
            for part, column in zip(parts, [np.cumsum(numbers[0]), numbers[1], numbers[2], raw[24 * count :].view(np.int8)]):
                part.append(column)
        return Entries(*[np.concatenate(part) for part in parts])

    def table(self) -> pa.Table:
        return pa.table({"d": self.d, "key": self.keys, "hash": self.hashes, "state": self.marks})


def _settle(entries: Entries, level: str) -> tuple[np.ndarray, np.ndarray]:
    """What entries sorted by (key, hash, document) decide among themselves.

    Returns the state of each entry (-1: not decided here) and whether its key is known to go on. An entry with a
    negative mark stands for a whole block that knows this already.
    """
    count = len(entries.keys)
    state = np.full(count, -1, dtype=np.int8)
    if not count:
        return state, np.zeros(0, dtype=bool)
    told = entries.marks < 0
    by_key = _runs(entries.keys)
    if level == "anchors":
        spread = np.zeros(by_key[-1] + 1, dtype=bool)
        np.logical_or.at(spread, by_key, told)
        spread |= np.bincount(by_key) > 1
        state[spread[by_key] & ~told] = UNDECIDED
        return state, spread[by_key]
    by_content = _runs(entries.keys, entries.hashes)
    first = np.full(by_content[-1] + 1, LARGEST, dtype=np.int64)
    np.minimum.at(first, by_content[~told], entries.d[~told])
    settled = ~told & (first[by_content] < entries.d)
    state[settled] = SETTLED
    spread = np.zeros(by_key[-1] + 1, dtype=bool)
    if level == "stretches":
        np.logical_or.at(spread, by_key, told)
        starts = np.concatenate([[True], by_content[1:] != by_content[:-1]])
        spread |= np.bincount(by_key[starts & ~told], minlength=len(spread)) > 1
        state[~settled & ~told & spread[by_key]] = UNDECIDED
    return state, spread[by_key]


def _send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], level: str, ranges: int) -> Iterator[pa.RecordBatch]:
    """Settle a block and pack what it decides (for its documents) and what it asks (for the key ranges)."""
    keys, hashes, d = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((d, hashes, keys))
    keys, hashes, d = keys[order], hashes[order], d[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (hashes[1:] != hashes[:-1]) | (d[1:] != d[:-1])])[: len(keys)]
    block = Entries(keys[new], hashes[new], d[new], np.zeros(int(new.sum()), dtype=np.int8))
    state, spread = _settle(block, level)
    rows: list[tuple[int, bool, bytes]] = []
    local = state >= 0
    if local.any():
        done = block[local]
        done.marks = state[local]
        blob = done.packed()
        rows.append((xxhash.xxh64_intdigest(blob) >> 1, True, blob))  # a group of its own: it is decided already
    # A key that goes on is told once by the block, all others ask with their smallest document.
    first_of_key = np.concatenate([[True], block.keys[1:] != block.keys[:-1]])[: len(block.keys)]
    ask = block[(~local & ~spread) | (spread & first_of_key)]
    ask.marks = -spread[(~local & ~spread) | (spread & first_of_key)].astype(np.int8)
    place = (ask.keys * ranges) >> KEY_BITS if ranges < 1 << (63 - KEY_BITS) else (ask.keys >> 24) * ranges >> (KEY_BITS - 24)
    bounds = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        rows.append((int(place[start]), False, ask[start:stop].packed()))
    if rows:
        p, here, blobs = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int64()), pa.array(here), pa.array([level] * len(rows)), pa.array(blobs, pa.binary())],
            names=["p", "local", "level", "blob"],
        )


def _in_blocks(entries: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], level: str, ranges: int):
    parts, held = [], 0
    for part in entries:
        parts.append(part)
        held += len(part[0])
        if held >= BLOCK_ENTRIES:
            yield from _send(parts, level, ranges)
            parts, held = [], 0
    if parts:
        yield from _send(parts, level, ranges)


def _decide(key: tuple, table: pa.Table) -> pa.Table:
    """Arrow function of one key range (or of what one block decided alone): its decided entries."""
    entries = Entries.unpacked(table.column("blob").to_pylist())
    if not key[1].as_py():
        order = np.lexsort((entries.d, entries.hashes, entries.keys))
        entries = entries[order]
        state, _ = _settle(entries, table.column("level")[0].as_py())
        entries = entries[state >= 0]
        entries.marks = state[state >= 0]
    return entries.table()


def _decided(packed: DataFrame) -> DataFrame:
    """Decided entries of every document: ``d`` and three parallel lists."""
    answers = packed.groupBy("p", "local").applyInArrow(_decide, DECIDED)
    lists = [F.collect_list(name).alias(lists) for name, lists in (("key", "keys"), ("hash", "hashes"), ("state", "states"))]
    return answers.repartition("d").groupBy("d").agg(*lists)


def _anchor_entries(length: int, ranges: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for start, stop, words in sliced_words(batch.column("text")):
                anchors = _Anchors(words, length)
                yield anchors.key, np.zeros(len(anchors.key), dtype=np.int64), ids[start:stop][anchors.row]

    return lambda batches: _in_blocks(entries(batches), "anchors", ranges)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: texts compressed for the one time they move."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [press.compress((text or "").encode()) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("d"), pa.array(texts, pa.binary())], names=["doc_id", "d", "packed"]
        )


def _unpacked(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(value) for value in column.to_pylist()], pa.large_binary())


def _blocks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _long_lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    none = np.zeros(0, np.int64)
    return [values[a:b] if there else none for a, b, there in zip(offsets[:-1], offsets[1:], present)]


def _named(batch: pa.RecordBatch, prefix: str, wanted: int) -> list[np.ndarray]:
    """Per row, the names decided with one state."""
    columns = [_long_lists(batch.column(f"{prefix}_{name}")) for name in ("keys", "hashes", "states")]
    found = []
    for keys, hashes, states in zip(*columns):
        chosen = states == wanted
        found.append(_pairs(np.stack([keys[chosen], hashes[chosen]], axis=1).astype(np.int64).view(np.uint64)))
    return found


def _stretch_entries(length: int, ranges: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in _blocks(whole):
                hits, ids = _long_lists(batch.column("keys")), batch.column("d").to_numpy()
                for start, stop, words in sliced_words(_unpacked(batch.column("packed"))):
                    anchors = _Anchors(words, length)
                    live = _within(anchors.row, anchors.key, hits[start:stop])
                    names = anchors.stretches()[live].view(np.int64)
                    yield names[:, 0], names[:, 1], ids[start:stop][anchors.row[live]]

    return lambda batches: _in_blocks(entries(batches), "stretches", ranges)


def _window_entries(length: int, ranges: int):
    def entries(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in _blocks(whole):
                undecided, ids = _named(batch, "stretch", UNDECIDED), batch.column("d").to_numpy()
                for start, stop, words in sliced_words(_unpacked(batch.column("packed"))):
                    anchors = _Anchors(words, length)
                    live = _within(anchors.row, _pairs(anchors.stretches()), undecided[start:stop])
                    row, _, names = anchors.single_windows(np.flatnonzero(live))
                    names = names.view(np.int64)
                    yield names[:, 0], names[:, 1], ids[start:stop][row]

    return lambda batches: _in_blocks(entries(batches), "windows", ranges)


def _removed(length: int):
    """Arrow function: kept text and counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _blocks(whole):
                done, undecided = (_named(batch, "stretch", state) for state in (SETTLED, UNDECIDED))
                gone = _named(batch, "window", SETTLED)
                for start, stop, words in sliced_words(_unpacked(batch.column("packed"))):
                    anchors = _Anchors(words, length)
                    stretches = _pairs(anchors.stretches())
                    over = _within(anchors.row, stretches, done[start:stop])
                    live = _within(anchors.row, stretches, undecided[start:stop])
                    row, at, hashes = anchors.single_windows(np.flatnonzero(live))
                    single = at[_within(row, _pairs(hashes), gone[start:stop])]
                    change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                    np.add.at(change, anchors.start[over], 1)
                    np.add.at(change, anchors.stop[over], -1)
                    np.add.at(change, single, 1)
                    np.add.at(change, single + length, -1)
                    kept = np.cumsum(change)[:-1] == 0
                    content = words.data.tobytes()
                    texts, lost = [], []
                    for number in range(stop - start):
                        low, high = words.first[number], words.first[number + 1]
                        picked = np.flatnonzero(kept[low:high]) + low
                        lost.append(high - low - len(picked))
                        texts.append(
                            b" ".join(content[a:b] for a, b in zip(words.starts[picked].tolist(), words.ends[picked].tolist()))
                        )
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(start, stop - start),
                            pa.array(np.diff(words.first).astype(np.int64)),
                            pa.array(np.array(lost, dtype=np.int64)),
                            pa.array(texts, pa.binary()).cast(pa.string()),
                        ],
                        names=["doc_id", "n_words", "n_removed", "kept_text"],
                    )

    return run


def remove_repeats(documents: DataFrame, length: int = 13) -> DataFrame:
    """Drop every word covered by a window of ``length`` words that also starts in a document with a smaller id.

    Takes ``doc_id`` and ``text``; returns ``doc_id, n_words, n_removed, kept_text`` (words joined by one space).
    """
    if length < 4:
        raise ValueError("windows must have at least four words")
    rows = documents.select("doc_id", F.coalesce("doc_id", F.lit(LARGEST)).alias("d"), "text")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))

    def renamed(decided: DataFrame, prefix: str) -> DataFrame:
        return decided.select("d", *[F.col(name).alias(f"{prefix}_{name}") for name in ("keys", "hashes", "states")])

    hits = _decided(rows.select("d", "text").mapInArrow(_anchor_entries(length, ranges), PACKED)).select("d", "keys")
    packed = rows.mapInArrow(_packed, "doc_id long, d long, packed binary")
    stretches = packed.join(hits, "d").mapInArrow(_stretch_entries(length, ranges), PACKED)
    marked = packed.join(materialized(renamed(_decided(stretches), "stretch"), "stretches"), "d", "left")
    windows = marked.where(F.array_contains("stretch_states", F.lit(UNDECIDED).cast("tinyint"))).mapInArrow(
        _window_entries(length, ranges), PACKED
    )
    return marked.join(renamed(_decided(windows), "window"), "d", "left").mapInArrow(
        _removed(length), "doc_id long, n_words long, n_removed long, kept_text string"
    )
