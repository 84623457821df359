"""Back-to-back repetition of token blocks inside one text.

A stretch of ``L`` positions with ``token[i] == token[i + size]`` repeats the block at its start ``L // size + 1``
times. Stretches are found without comparing every position at every block size: a block three times in a row
contains, at some multiple of its size, two equal neighbouring blocks, and there are only n log n of those;
equality is one comparison of window hashes, and the stretch around a hit is measured by bisection. A stretch that
covers most of the text holds the same middle part whatever its size, so one comparison per size finds it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from trustscore import constants as C

LONG_BLOCK = 4  # tokens from which two repeats can count
COVERED_PERCENT = 80  # share of all tokens the two repeats must cover
_ANCHORS = 1 << 20  # pairs of neighbouring blocks compared at once

REPETITION = StructType([StructField("triple", BooleanType()), StructField("covering", BooleanType())])


class _Windows:
    """Hashes of windows of a code sequence modulo two primes: no sequence defeats them as it would a power of two."""

    MODULI = (2_147_483_647, 2_147_483_629)
    BASES = (1_103_515_245, 1_664_525_007)

    def __init__(self, codes: np.ndarray):
        self.sums, self.powers = [], []
        for modulus, base in zip(self.MODULI, self.BASES):
            powers = np.ones(len(codes) + 1, dtype=np.int64)
            done = 1
            while done < len(powers):
                step = min(done, len(powers) - done)
                powers[done : done + step] = powers[:step] * pow(base, done, modulus) % modulus
                done += step
            values = (codes + 1) % modulus * powers[:-1] % modulus
            # At most 2**32 values below 2**31: the running sum cannot overflow.
            self.sums.append(np.concatenate([[0], np.cumsum(values)]) % modulus)
            self.powers.append(powers)

    def equal(self, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the windows at ``left`` and ``right`` (not before ``left``) agree."""
        same = np.ones(len(left), dtype=bool)
        for modulus, sums, powers in zip(self.MODULI, self.sums, self.powers):
            one = (sums[left + length] - sums[left]) % modulus * powers[right - left] % modulus
            same &= one == (sums[right + length] - sums[right]) % modulus
        return same

    def agreement(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """How many positions agree from (``left``, ``right``) on, or before them, ``limit`` at most."""
        low, high = np.zeros(len(left), dtype=np.int64), limit.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            fits = self.equal(left - shift, right - shift, middle)
            low = np.where(fits, middle, low)
            high = np.where(fits, high, middle - 1)
        return low

    def stretch(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the stretch of period ``size`` through each position (length 0: none there)."""
        count = len(self.sums[0]) - 1
        ahead = self.agreement(at, at + size, count - at - size)
        behind = np.where(ahead > 0, self.agreement(at, at + size, at, back=True), 0)
        return at - behind, ahead + behind


def _spans(codes: np.ndarray, start: int, size: int) -> int:
    """Length of the stretch from ``start``, position by position."""
    differs = codes[start:-size] != codes[start + size :]
    return int(differs.argmax()) if differs.any() else len(differs)


def _single_tokens(codes: np.ndarray, tokens: list[str]) -> bool:
    """A token of at least two characters three times in a row."""
    thrice = np.flatnonzero((codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:]))
    return any(len(tokens[at]) >= 2 for at in thrice[np.unique(codes[thrice], return_index=True)[1]])


def _thrice(codes: np.ndarray, windows: _Windows) -> bool:
    """Some block of two or more tokens three times in a row."""
    count, size = len(codes), 2
    while 3 * size <= count:
        # As many sizes as have about _ANCHORS neighbouring blocks together.
        upto = size + 1
        held = count // size
        while 3 * upto <= count and held < _ANCHORS:
            held += count // upto
            upto += 1
        sizes = np.arange(size, upto)
        blocks = count // sizes - 1
        period = np.repeat(sizes, blocks)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * period
        likely = codes[at] == codes[at + period]
        at, period = at[likely], period[likely]
        same = windows.equal(at, at + period, period)
        at, period = at[same], period[same]
        starts, lengths = windows.stretch(at, period)
        for hit in np.flatnonzero(lengths >= 2 * period):
            if _spans(codes, int(starts[hit]), int(period[hit])) >= 2 * period[hit]:
                return True
        size = upto
    return False


def _covers(codes: np.ndarray, windows: _Windows) -> bool:
    """Some block of ``LONG_BLOCK`` tokens or more whose repeats fill ``COVERED_PERCENT`` of the tokens."""
    count = len(codes)
    sizes = np.arange(LONG_BLOCK, count // 2 + 1)
    if not len(sizes):
        return False
    # Whatever covers that much of the text starts before and ends after this middle part.
    spare = count - -(-COVERED_PERCENT * count // 100)
    first, last = spare, count - spare
    middle = np.full(len(sizes), first)
    inside = last - first - sizes
    sizes, middle = sizes[inside > 0], middle[inside > 0]
    same = windows.equal(middle, middle + sizes, last - first - sizes)
    sizes, middle = sizes[same], middle[same]
    starts, lengths = windows.stretch(middle, sizes)

    def enough(length, size):
        return (length >= size) & ((length // size + 1) * size * 100 >= COVERED_PERCENT * count)

    return any(enough(_spans(codes, int(starts[hit]), int(sizes[hit])), sizes[hit]) for hit in np.flatnonzero(enough(lengths, sizes)))


def block_repetition(tokens: list[str]) -> tuple[bool, bool]:
    """(some block of at least two characters three times in a row, a long block twice covering most tokens)."""
    count = len(tokens)
    if count < 3:
        return False, False
    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(token, len(numbers)) for token in tokens), dtype=np.int64, count=count)
    if len(numbers) == count:
        return False, False
    windows = _Windows(codes)
    return bool(_single_tokens(codes, tokens) or _thrice(codes, windows)), bool(_covers(codes, windows))


@F.pandas_udf(REPETITION)
def token_repetition(text: pd.Series) -> pd.DataFrame:
    """Both repetition flags of a text, tokens compared case-folded."""
    found = [block_repetition(C.TOKEN.findall((value or "").casefold())) for value in text]
    return pd.DataFrame(found, columns=["triple", "covering"], dtype=bool)
