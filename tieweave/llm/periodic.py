"""Periodic runs of words: stretches that repeat one block of words over and over.

A run is a stretch of consecutive words with smallest period q, of ``min_length`` words
and ``min_exponent`` times q or more, that no word beside it extends. All runs of a text
are found over a harmonic grid: for each period p the words 0, p, 2p, ... are grid points,
n / p of them, so a text of n words has about n ln n pairs of period and grid point. A run
of period p covers ``min_exponent`` grid points in a row, whose words are equal; pairs
where they are not go at once. For all that are left, binary searches over prefix hashes
find, side by side in arrays, how far the stretch agrees with itself moved by p words,
to the right and to the left (the longest common extensions). A stretch that several
periods or grid points find is kept once, with the least period.

Hashes only say where to look: every run's words are compared before it counts, and a pair
that a clash of hashes has misled is measured again word by word. So results are exact. Memory
is in proportion to one text: pairs are worked on in blocks of PAIRS.

Nothing is shuffled. A text is one row's work, n ln n steps for n words, whatever it says.

Defined results: a null, empty or blank text has no words and no runs, and its collapsed
text is empty; a very long text is searched whole; rows that repeat and null ids are each
searched on their own; runs that tie are told apart by start, then period; an empty table
gives no rows; other columns of the input are not read. An id column that has the name of a
result comes back with ``_id`` after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Pairs of period and grid point that are worked on at one time (more if one period has more).
PAIRS = 1 << 16
#: So many of the longest runs found so far are kept from being found again by multiples of their periods.
LONGEST = 16
#: An odd multiplier of the prefix hashes, which are taken modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))


class PrefixHashes:
    """Hashes of all stretches of ``codes``, by sums of word values times powers of BASE."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        steps = np.full(n + 1, BASE)
        steps[0] = 1
        self.powers = np.cumprod(steps)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed * self.powers[:n], out=self.sums[1:])

    def extension(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, side: int) -> np.ndarray:
        """How many words from ``at`` on (side 1) or before it (side -1) equal those ``period`` further, ``limit`` at most."""
        low, high = np.zeros_like(limit), limit.copy()
        shift, other = self.powers[period], at + period
        own_at, other_at = self.sums[at], self.sums[other]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            step = side * middle
            # Both differences change their sign together on the left side.
            same = (self.sums[at + step] - own_at) * shift == self.sums[other + step] - other_at
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def grid(n: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(periods, points) of all pairs whose ``exponent`` grid points from there on lie in n words, in blocks of rising periods."""
    periods = np.arange(1, n // exponent + 1)
    counts = -(-n // periods) - (exponent - 1)
    ends = np.cumsum(counts)
    low = 0
    while low < len(periods):
        before = ends[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        own = counts[low:high]
        period = np.repeat(periods[low:high], own)
        yield period, (np.arange(len(period)) - np.repeat(ends[low:high] - own - before, own)) * period
        low = high


def _measured(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """Start and end of the stretch of ``period`` around ``at``, word by word."""
    apart = np.flatnonzero(codes[:-period] != codes[period:])
    place = int(np.searchsorted(apart, at))
    return (int(apart[place - 1]) + 1 if place else 0, int(apart[place]) + period if place < len(apart) else len(codes))


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. ``min_exponent`` is two or more."""
    n = len(codes)
    if n < max(min_length, min_exponent):
        return []
    hashes: PrefixHashes | None = None
    least: dict[tuple[int, int], list[int]] = {}
    for period, at in grid(n, min_exponent):
        for k in range(1, min_exponent):
            alike = np.flatnonzero(codes[at + (k - 1) * period] == codes[at + k * period])
            period, at = period[alike], at[alike]
            if not len(at):
                break
        # A pair with one period inside a known run, whose period divides its own, gives that run again.
        for start, end in sorted(least, key=lambda x: x[0] - x[1])[:LONGEST]:
            if not len(at):
                break
            new = (at < start) | (at + period > end) | (period % min(least[start, end]) != 0)
            period, at = period[new], at[new]
        if not len(at):
            continue
        hashes = hashes or PrefixHashes(codes)
        start = at - hashes.extension(at, period, at, -1)
        end = at + period + hashes.extension(at, period, n - at - period, 1)
        long = np.flatnonzero(end - start >= np.maximum(min_length, min_exponent * period))
        if len(long):
            _verify(codes, np.stack([period, start, end, at])[:, long], min_length, min_exponent, least)
    return sorted((start, end - start, min(periods)) for (start, end), periods in least.items())


def _verify(codes: np.ndarray, rows: np.ndarray, min_length: int, min_exponent: int, least: dict[tuple[int, int], list[int]]) -> None:
    """Adds to ``least`` the periods of the stretches that words confirm. rows: period, start, end, grid point, by period, then point."""
    cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
    for same in np.split(rows, cuts, axis=1):  # the grid points of one period in one stretch
        period, start, end = same[:3, 0].tolist()
        if any(period % q == 0 for q in least.get((start, end), ())):
            continue
        if np.array_equal(codes[start : end - period], codes[start + period : end]):
            least.setdefault((start, end), []).append(period)
            continue
        reached = -1
        for at in same[3].tolist():
            if at > reached:
                start, end = _measured(codes, at, period)
                reached = end - period - 1
                if end - start >= max(min_length, min_exponent * period):
                    least.setdefault((start, end), []).append(period)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in no run, or in its first period only."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """One row for each row: id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are what ASCII space and the control characters 9 to 13 leave. ``collapsed`` has
    of each run its first period alone; its words are joined by one space.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be two or more")
    long, parts = T.LongType(), ("start", "length", "period")
    run = T.StructType([T.StructField(c, long) for c in parts])
    fields = [T.StructField("n_words", long), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in parts])), pa.string()]

    def one(text: str | None) -> tuple[int, list[dict[str, int]], str]:
        words = (text or "").encode().split()
        runs = find_runs(word_codes(words), min_length, min_exponent)
        left = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))] if runs else words
        return len(words), [dict(zip(parts, r)) for r in runs], b" ".join(left).decode()

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            columns = zip(*(one(t) for t in texts.to_pylist()))
            return [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]

        return work

    return map_text(docs, make, fields, id_col=id_col, text_col=text_col)


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in one document of ten, by its id's hash, the words from some place on repeat one block.

    With h the CRC-32 of the decimal id and g = h // 10, where h % 10 is 0, each word from
    a = g % n on becomes the word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Words of such a
    text are joined by one space. Other texts, and those of a null id, are as they were.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    chosen = h % 10 == 0
    own = docs.select(F.col(id_col), F.col(text_col), F.when(chosen, words).alias("_tw_words"), F.floor(h / 10).alias("_tw_g"))
    n, g = F.size("_tw_words"), F.col("_tw_g")
    a = F.pmod(g, n).cast("int")
    block = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_tw_words", a + 1, block), F.ceil((n - a) / block).cast("int")))
    planted = F.array_join(F.concat(F.slice("_tw_words", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return own.select(F.col(id_col), F.when(n > 0, planted).otherwise(F.col(text_col)).alias(text_col))


def longest() -> Column:
    """Of ``runs`` the longest (then of least start, then of least period) as a struct with less, the negative length, start and period."""
    return F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))


def runs_text() -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return F.array_join(F.transform("runs", line), "")
